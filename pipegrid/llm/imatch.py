"""Document fingerprints by I-Match, in DataFrame operations only.

The lexicon holds the terms (lower-case runs of letters and digits) whose document frequency over the whole corpus lies within
a band; texts of equal sketch (copies and most near copies) count once together, with the terms of all of them, so that a text
of many copies keeps its terms and no text is left out. Of each text the distinct terms in the lexicon are kept as 64-bit hashes and sorted; the terms of each of several
randomised subsets of the lexicon are hashed together, and the fingerprint is the list of these hashes. Subsets are drawn at
three rates (one term in 4, 32 and 256), so that likeness, the share of subsets that agree among those that hold a term of
either text, falls gradually.

The band's lower end is a share of the documents, so the lexicon has at most (terms per document) / share terms whatever the
size of the corpus. Up to ``most_terms``, which is checked, it is looked up in place as one row of buckets; a larger one
is joined with the texts' terms by hash. Of a text without a lexicon term all terms are kept.

Null text is empty. The next document is the next lower doc_id (after the last, the first); a null doc_id counts as the
lowest, repeated doc_ids follow each other by the hash of their text, a single document is its own next, and an empty table
gives an empty table. Rows of one doc_id (or none) and one text are gathered into one with their number before anything is
joined, and dealt out again at the end: all but the last of them are followed by themselves. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipegrid.llm.common import cut, table, texts

_LEAST = -(1 << 63)


def term_hashes(text: Column) -> Column:
    """The distinct terms of a text as hashes; the empty term before, after or in place of all others is one of them."""
    return F.array_distinct(F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w)))


def sketch(terms: Column) -> Column:
    """The smallest four term hashes, which near copies have in common, as one hash."""
    return F.xxhash64(F.slice(F.array_sort(terms), 1, 4))


def frequencies(docs: DataFrame) -> DataFrame:
    """Each term hash h of all texts and in how many sketches any text has it (df); the null h has the number of sketches.

    Texts are dealt by sketch, so that only (h, df) is shuffled after that.
    """
    own = docs.select(term_hashes(F.col("text")).alias("t")).select(sketch(F.col("t")).alias("s"), "t")
    dealt = own.repartition("s").select("s", F.explode(F.concat("t", F.array(F.lit(None).cast("long")))).alias("h"))
    return dealt.distinct().groupBy("h").agg(F.count(F.lit(1)).alias("df"))


def lexicon(docs: DataFrame, low: float, high: float, least: int) -> DataFrame:
    """The term hashes h whose frequency is at least max(least, low * n) and at most high * n, of n sketches."""
    found = cut(frequencies(docs))
    n = next((r["df"] for r in found.where("h is null").collect()), 0)  # a row at most
    return cut(found.where(F.col("h").isNotNull() & (F.col("df") >= max(least, low * n)) & (F.col("df") <= high * n)).select("h"))


def lookup(kept: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The n hashes of a lexicon as a single row, arrays of hashes by bucket, and the number of buckets."""
    size = 1 << max(0, n - 1).bit_length()
    by = kept.groupBy(F.pmod("h", F.lit(size)).cast("int").alias("b")).agg(F.collect_list("h").alias("some"))
    every = kept.sparkSession.range(size).select(F.col("id").cast("int").alias("b")).join(by, "b", "left")
    rows = F.struct("b", F.coalesce("some", F.array().cast("array<bigint>")).alias("some"))
    return every.agg(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["some"]).alias("buckets")), size


def with_terms(df: DataFrame, key: list[str], kept: DataFrame, most: int) -> DataFrame:
    """df (whose rows key tells apart) with text_terms and edited_terms, the terms of both texts that the lexicon keeps."""
    n = kept.count()
    if n <= most:  # one row of proven size; joined by broadcast, it is read in place and goes no further
        words, size = lookup(kept, n)
        known = lambda c: F.filter(term_hashes(F.col(c)), lambda h: F.array_contains(F.get("buckets", F.pmod(h, F.lit(size)).cast("int")), h))
        return df.join(F.broadcast(words)).select(*df.columns, *(numbers(term_hashes(F.col(c)), known(c)).alias(f"{c}_terms") for c in ("text", "edited")))
    for c in ("text", "edited"):
        own = df.select(*key, F.explode(term_hashes(F.col(c))).alias("term")).join(kept.withColumnRenamed("h", "term"), "term").groupBy(*key).agg(F.collect_list("term").alias("found"))
        df = df.join(own, key, "left").withColumn(f"{c}_terms", numbers(term_hashes(F.col(c)), F.coalesce("found", F.array().cast("array<bigint>")))).drop("found")
    return df


def numbers(hashes: Column, known: Column) -> Column:
    """The known terms sorted, all where none is known, as numbers spread evenly over 64 bits."""
    known = F.get(F.transform(F.array(known), lambda k: F.when(F.size(k) > 0, k).otherwise(hashes)), F.lit(0))  # found once
    return F.array_sort(F.transform(known, lambda h: F.xxhash64(h, F.lit(1))))


def with_fingerprint(df: DataFrame, text: str, terms: str, out: str) -> DataFrame:
    """df with the hash of each subset's terms (array of long, null where the subset holds no term of the text) as out.

    Subsets are ranges of the terms' numbers: 4 hold one term in 4, 8 one in 32 and 16 one in 256. A range of a sorted list
    is sorted, so its hash is that of its sorted distinct terms.
    """
    names = df.columns
    eighth, small = ([f"{out}_{kind}{k}" for k in range(8)] for kind in ("eighth", "small"))
    own = lambda c, shift, many, of: F.filter(c, lambda x: F.shiftright(x, shift).bitwiseAND(F.lit(many - 1)) == of)
    parts = df.select(*names, *(own(F.col(terms), 61, 8, k).alias(e) for k, e in enumerate(eighth)))
    parts = parts.select(*names, *eighth, *(own(F.col(e), 59, 4, 0).alias(x) for e, x in zip(eighth, small, strict=True)))
    hashed = lambda c: F.when(F.size(c) > 0, F.xxhash64(c))
    found = [hashed(F.concat(a, b)) for a, b in zip(eighth[::2], eighth[1::2], strict=True)]
    found += [hashed(F.col(c)) for c in small] + [hashed(own(F.col(c), 56, 8, k)) for c in small for k in (0, 1)]
    return parts.select(*names, F.when(F.size(terms) > 0, F.array(*found)).otherwise(F.array(F.xxhash64(text))).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """The share of entries that agree among those that either fingerprint has (1 if neither has any and they are equal)."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise((x.eqNullSafe(y)).cast("int")))
    told = F.filter(both, lambda x: x.isNotNull())
    same = F.aggregate(told, F.lit(0), lambda s, x: s + x)
    share = F.when(F.size(told) > 0, same / F.size(told)).otherwise((F.to_json(a) == F.to_json(b)).cast("double"))
    return F.when(F.size(a) == F.size(b), share).otherwise(F.lit(0.0))


def shown(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.coalesce(F.lower(F.hex(x)), F.lit("-"))), ",")


def following(keys: DataFrame) -> DataFrame:
    """keys (k and h, no pair twice, and more) with nk and nh, the row after each by k descending, then h; the last row's is the first."""
    order = [F.desc("k"), F.asc("h")]
    dealt = cut(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part").orderBy(*order)
    firsts = dealt.groupBy("part").agg(F.max_by(F.struct("k", "h"), F.struct("k", F.bitwise_not("h"))).alias("first"))
    parts = Window.orderBy("part")  # a row per partition
    nexts = firsts.withColumn("after", F.coalesce(F.lead("first").over(parts), F.first("first").over(parts))).select("part", "after")
    told = dealt.withColumn("next", F.lead(F.struct("k", "h")).over(own)).join(F.broadcast(nexts), "part")
    found = F.coalesce("next", "after")
    return told.select(*keys.columns, found["k"].alias("nk"), found["h"].alias("nh"))


_KEY = ["k", "h", "nk", "nh"]


def edits(docs: DataFrame, low: float, high: float, least: int, most_terms: int) -> DataFrame:
    """k, h, nk and nh (a text's and the next one's), many (rows that this holds for), doc_id, text, edited, n_chars, fp and edited_fp."""
    plain = texts(docs)
    kept = lexicon(plain, low, high, least)
    keyed = plain.select(F.coalesce("doc_id", F.lit(_LEAST)).alias("k"), F.xxhash64("text").alias("h"), "text")
    rows = keyed.groupBy("k", "h").agg(F.first("text").alias("text"))
    keys = keyed.select("k", "h", F.length("text").alias("n")).groupBy("k", "h").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("m"))
    after = cut(following(keys))
    alone = (F.col("nk") == F.col("k")) & (F.col("nh") == F.col("h"))
    last = after.select("k", "h", "n", "nk", "nh", F.when(alone, F.col("m")).otherwise(1).alias("many"))
    rest = after.where((F.col("m") > 1) & ~alone).select("k", "h", "n", F.col("k").alias("nk"), F.col("h").alias("nh"), (F.col("m") - 1).alias("many"))
    pairs = last.unionByName(rest)
    tails = rows.withColumnsRenamed({"k": "nk", "h": "nh"}).join(pairs, ["nk", "nh"])
    tails = tails.select(*_KEY, "n", "many", F.substr("text", F.lit(1), F.floor(F.col("n") / 2).cast("int")).alias("tail"))
    head = F.substr("text", F.lit(1), F.col("n") - F.floor(F.col("n") / 2).cast("int"))
    both = rows.join(tails, ["k", "h"]).withColumn("edited", F.concat(head, "tail"))
    both = both.select(*_KEY, "many", F.expr(f"nullif(k, {_LEAST + 1} - 1)").alias("doc_id"), "text", "edited", F.col("n").alias("n_chars"))
    known = with_terms(both, _KEY, kept, most_terms)
    return with_fingerprint(with_fingerprint(known, "text", "text_terms", "fp"), "edited", "edited_terms", "edited_fp").drop("text_terms", "edited_terms")


def dealt(df: DataFrame) -> DataFrame:
    """As many of each row as its column many says."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many")))).drop("many")


def fingerprints(docs: DataFrame, low: float = 0.0005, high: float = 0.2, least: int = 2, most_terms: int = 250_000) -> DataFrame:
    """doc_id, text, edited (its second half replaced by the next document's beginning) and both fingerprints of every row."""
    return dealt(edits(docs, low, high, least, most_terms)).select("doc_id", "text", "edited", "n_chars", "fp", "edited_fp")


def op3_imatch(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def digests(docs: DataFrame, low: float = 0.0005, high: float = 0.2, least: int = 2, most_terms: int = 250_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints as text, and their likeness to the edited text's and the next row's."""
    found = edits(docs, low, high, least, most_terms)
    told = cut(found.select(*_KEY, "many", "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", "edited_fp"))
    # every text has one row whose next is not more of the same, if there is any other text
    one = told.groupBy("k", "h").agg(F.first("fp").alias("afp")).withColumnsRenamed({"k": "nk", "h": "nh"})
    both = told.join(one, ["nk", "nh"]).select(
        "many", "doc_id", "n_chars", "edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("afp")).alias("near_next"),
    )
    return dealt(both).drop("copy")
