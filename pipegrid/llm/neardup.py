"""MinHash near-duplicates with fast similarity sketching.

A document's set holds its distinct shingles of five words (of all its words, if fewer). Texts with equal sets form a class.
Sketch: in round i every shingle goes to one hashed bin with a value that later rounds cannot beat; rounds go on until all
bins hold a value, and after as many rounds as there are bins each further round places all shingles in one bin, so that
every coordinate fills whatever the size of the set, and the share of agreeing coordinates concentrates about the similarity.
Bands of coordinates give candidate buckets. Within a bucket the members are compared with a centre (first per partition, then
among the partitions' centres, so that a bucket of any size costs as many comparisons as it has members); all candidates
are confirmed on the full sets. Where the members of a bucket then still lie in several components, they meet the members of
other components with which they share one of their rarest shingles (which any link takes).
With 48 bands of 5 coordinates a pair of similarity 0.75 misses all buckets with probability 2.3e-6, which
is the only way to lose a link.

Null text is empty; documents without words have an empty set and are linked with nothing. A null doc_id is linked with nothing
and its component is null (kept). Rows that repeat a doc_id are documents of their own that share the id. An empty table
gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.llm.common import blocks, buckets, cut, spread, table, texts, utf8
from pipegrid.llm.graph import components

BINS, ROWS = 240, 5
_BLOCK = 1 << 20

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _seeds(n: int, start: int) -> np.ndarray:
    return mix(np.arange(start, start + n, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(0x9E3779B97F4A7C15))


_LETTER, _PLACE, _ROUND = _seeds(256, 1000), _seeds(8, 2000) | _U(1), _seeds(1 << 12, 3000)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts in data, lower-cased, and the number of words of each text."""
    n = len(offsets) - 1
    low = _LOWER[data]
    blank = _BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    inner = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    begins[inner] = ~blank[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(n, np.int64)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if place is None:
        place = np.zeros(len(data), np.int64)
        place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = np.ones(int(place.max()) + 1, _U)
    powers[1:] = _U(0x9E3779B97F4A7C15) | _U(1)
    powers = np.multiply.accumulate(powers)
    value = _LETTER[low] * powers[place]
    value[blank] = 0
    words = mix(np.add.reduceat(value, starts))
    return words, np.diff(np.searchsorted(starts, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, many = word_hashes(data, offsets)
    if len(words) >= 5:
        n = len(words) - 4
        five = mix(sum(words[j : n + j] * _PLACE[j] for j in range(5)))
    out, first = [], 0
    for k in many.tolist():
        if k >= 5:
            out.append(np.unique(five[first : first + k - 4]))
        elif k:
            out.append(mix((words[first : first + k] * _PLACE[:k]).sum(dtype=_U, keepdims=True) + _U(k)))
        else:
            out.append(np.zeros(0, _U))
        first += k
    return out


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A sketch of bins values for each (not empty) set."""
    lens = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, _U)
    out = np.full((len(sets), bins), ~_U(0))
    empty = np.ones((len(sets), bins), bool)
    first = np.cumsum(lens) - lens
    left = np.flatnonzero(lens)
    for i in range(2 * bins):
        if not len(left):
            break
        x = flat[spread(first[left], lens[left])]
        own = np.repeat(left, lens[left])
        h = mix(x ^ _ROUND[i])
        at = (h >> _U(33)).astype(np.int64) % bins if i < bins else np.full(len(x), i - bins)
        new = empty[own, at]
        place, value = own[new] * bins + at[new], mix(h[new] + _ROUND[i])
        # the smallest value of each bin that no earlier round filled
        order = np.lexsort((value, place))
        place, value = place[order], value[order]
        head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        out.ravel()[place[head]] = value[head]
        empty.ravel()[place[head]] = False
        left = left[empty[left].any(axis=1)]
    return out


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A key for each band of rows values; keys of different bands differ."""
    parts = sketch.reshape(len(sketch), -1, rows)
    total = (parts * _PLACE[:rows]).sum(axis=2, dtype=_U)
    return mix(total + _ROUND[: parts.shape[1]])


def class_of(own: np.ndarray) -> int:
    """A signed 64-bit name of a set, from a cryptographic digest of it."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(batches):
    for t in blocks(batches, _BLOCK):
        sets = shingle_sets(*utf8(t.column("text")))
        keys = bands(sketches(sets)).astype(np.int64)
        keys = [x.tolist() if len(s) else [] for x, s in zip(keys, sets, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [t.column("doc_id").combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "c", "bands"],
        )


def _centres(keys: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by key: key, member, the smallest member with that key, and the number of members."""
    order = np.lexsort((members, keys))
    keys, members = keys[order], members[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (members[1:] != members[:-1])
    keys, members = keys[fresh], members[fresh]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    group = np.cumsum(head) - 1
    return keys, members, members[head][group], np.bincount(group, minlength=1)[group] if len(keys) else np.zeros(0, np.int64)


_BUCKET = "key long, c long, centre long, local boolean"


def _bucket_rows(keys, members, centres, local):
    n = len(keys)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(members, pa.int64()), pa.array(centres, pa.int64()), pa.array(np.full(n, local))], names=["key", "c", "centre", "local"])


def _within(batches):
    """Per partition: members and centre of each bucket with several, and the centre of each bucket, to be compared on."""
    keys, members = [], []
    for b in batches:
        lists = b.column("bands")
        keys.append(np.asarray(lists.flatten(), np.int64))
        members.append(np.repeat(np.asarray(b.column("c"), np.int64), np.asarray(lists.value_lengths(), np.int64)))
    if keys:
        k, m, centre, many = _centres(np.concatenate(keys), np.concatenate(members))
        yield _bucket_rows(k[many > 1], m[many > 1], centre[many > 1], True)
        own = m == centre
        yield _bucket_rows(k[own], m[own], m[own], False)


def _across(batches):
    """Per partition of keys: the local centres of every bucket that has several, with the smallest of them."""
    got = [(np.asarray(b.column("key"), np.int64), np.asarray(b.column("c"), np.int64)) for b in batches]
    if got:
        k, m, centre, many = _centres(np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got]))
        yield _bucket_rows(k[many > 1], m[many > 1], centre[many > 1], False)


def _unzipped(column) -> list[np.ndarray]:
    raw = [zstandard.decompress(x) for x in column.to_pylist()]
    return shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


def _confirm(least: int):
    def run(members: pa.Table, centre: pa.Table) -> pa.Table:
        own = _unzipped(centre.column("own").slice(0, 1))[0] if centre.num_rows else np.zeros(0, _U)
        a, b = [], []
        for k in range(0, members.num_rows, 256):
            part = members.slice(k, 256)
            for c, x in zip(part.column("c").to_pylist(), _unzipped(part.column("body")), strict=True):
                both = np.intersect1d(own, x, assume_unique=True).size
                if len(own) and 100 * both >= least * (len(own) + len(x) - both):
                    a.append(centre.column("of")[0].as_py()), b.append(c)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def confirmed(pairs: DataFrame, bodies: DataFrame, least: int, group: int = 512) -> DataFrame:
    """The pairs (c, centre) whose sets are similar enough; a centre with many partners is dealt to several tasks."""
    counts = pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts"))
    dealt = pairs.join(counts, "centre").select("centre", "c", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part"))
    members = dealt.join(bodies, "c").select("centre", "part", "c", "body")
    centres = counts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(bodies.withColumnRenamed("c", "centre"), "centre").select(F.col("centre").alias("of"), F.col("part").alias("share"), F.col("body").alias("own"))
    return members.groupBy("centre", "part").cogroup(centres.groupBy("of", "share")).applyInArrow(_confirm(least), "a long, b long")


def _body(batches):
    for t in blocks(batches, _BLOCK):
        sets = shingle_sets(*utf8(t.column("text")))
        c = np.array([class_of(s) if len(s) else 0 for s in sets], np.int64)
        good = np.flatnonzero(c == np.asarray(t.column("c"), np.int64))
        text = t.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(c[good]), pa.array([zstandard.compress(text[i].encode(), 3) for i in good], pa.binary())], names=["c", "body"])


_SHARE = "block long, bucket int, body binary, members array<long>, low array<long>"


def _share_rows(block, bucket, body, members, labels):
    lists = lambda x: pa.array(x, pa.list_(pa.int64()))
    return [pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(body, pa.binary()), lists(members), lists(labels)]


_SHARE_NAMES = ["block", "bucket", "body", "members", "low"]


_ANSWER = 1 << 24  # added to the bucket of an answer


def _shares(n: int):
    """A block's members, and for each bucket of shingles the 32-bit shingles with the number of the member."""

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        sets = [np.unique(x >> _U(32)) for x in _unzipped(t.column("body"))]
        number = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        h = np.concatenate(sets)
        order = np.argsort(h, kind="stable")
        h, number = h[order], number[order]
        edges = np.searchsorted((h * _U(n) >> _U(32)).astype(np.int64), np.arange(n + 1)).tolist()
        labels = t.column("label").to_pylist()
        rows = [(block, k, zstandard.compress(h[x:y].astype("<u4").tobytes() + number[x:y].astype("<u4").tobytes(), 1), [], labels) for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if x < y]
        rows.append((block, -1, b"", t.column("c").to_pylist(), t.column("enough").to_pylist()))
        return pa.table(_share_rows(*zip(*rows, strict=True)), names=_SHARE_NAMES)

    return run


def _pairs_of(body: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(body), "<u4").reshape(2, -1).astype(np.int64)


def _meet(t: pa.Table) -> pa.Table:
    """For each shingle that a bucket was told: twice the number of members that have it, and one if several components do."""
    shingle, label, sizes = [], [], []
    for body, labels in zip(t.column("body").to_pylist(), t.column("low").to_pylist(), strict=True):
        h, member = _pairs_of(body)
        shingle.append(h), label.append(np.array(labels, np.int64)[member]), sizes.append(len(h))
    shingle, label = np.concatenate(shingle), np.concatenate(label)
    order = np.argsort(shingle, kind="stable")
    starts = np.flatnonzero(np.diff(shingle[order], prepend=-1))
    many = np.diff(np.append(starts, len(order)))
    several = np.minimum.reduceat(label[order], starts) < np.maximum.reduceat(label[order], starts)
    told = np.empty(len(order), np.int64)
    told[order] = np.repeat(2 * many + several, many)
    body = [zstandard.compress(x.astype("<u4").tobytes(), 1) for x in np.split(told, np.cumsum(sizes)[:-1])]
    none = [[]] * t.num_rows
    return pa.table(_share_rows(t.column("block").to_pylist(), [x + _ANSWER for x in t.column("bucket").to_pylist()], body, none, none), names=_SHARE_NAMES)


def _prefix(t: pa.Table) -> pa.Table:
    """The rarest shingles of each member of a block, as many as a link cannot do without, of those that several components have."""
    rows = sorted(zip(t.column("bucket").to_pylist(), t.column("body").to_pylist(), strict=True))
    own = t.filter(pc.less(t.column("bucket"), 0)).to_pylist()[0]
    asked = [_pairs_of(body) for b, body in rows if 0 <= b < _ANSWER]
    h, member = np.concatenate(asked, axis=1) if asked else np.zeros((2, 0), np.int64)
    told = np.concatenate([np.frombuffer(zstandard.decompress(body), "<u4").astype(np.int64) for b, body in rows if b >= _ANSWER] or [np.zeros(0, np.int64)])
    order = np.lexsort((h, told >> 1, member))
    h, member, told = h[order], member[order], told[order]
    size = np.bincount(member, minlength=len(own["members"]))
    place = np.arange(len(member)) - (np.cumsum(size) - size)[member]
    # two more than needed, for shingles of a text that are equal in 32 bits
    good = (place < (size - np.array(own["low"]) + 3)[member]) & (told & 1 == 1)
    return pa.table({"c": pa.array(np.array(own["members"], np.int64)[member[good]], pa.int64()), "h": pa.array(h[good], pa.int64())})


def _confirm_block(least: int):
    """Members against a block of others: a link (a, b) to each component in which a member of the block is similar enough."""

    def run(some: pa.Table, block: pa.Table) -> pa.Table:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if some.num_rows and block.num_rows:
            sets = _unzipped(block.column("body"))
            size, label, c = np.array([len(x) for x in sets]), np.asarray(block.column("label")), np.asarray(block.column("c"))
            flat, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(flat, kind="stable")
            flat, member = flat[order], member[order]
            for own, mine, x in zip(some.column("x").to_pylist(), some.column("of").to_pylist(), _unzipped(some.column("own")), strict=True):
                first = np.searchsorted(flat, x)
                both = np.bincount(member[spread(first, np.searchsorted(flat, x, side="right") - first)], minlength=len(sets))
                good = np.flatnonzero((100 * both >= least * (len(x) + size - both)) & (label != mine))
                good = good[np.unique(label[good], return_index=True)[1]]
                a.append(np.full(len(good), own)), b.append(c[good])
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return run


def across_components(sized: DataFrame, bodies: DataFrame, least: int, group: int = 1024) -> DataFrame | None:
    """The links (a, b) that join components (None if there can be none), of the members (key, c, n, label) of buckets that lie in several.

    Sets of sizes n and m have a similarity of least per cent only if they share least * (n + m) / (100 + least) shingles. So
    with m the smallest size in a member's buckets (at least least per cent of n) it may lack but few of its shingles, and
    two linked sets share one of these few rarest of both (prefix filtering, which loses no link). Of the members that have a
    rare shingle all but its largest component meet the blocks of members that have it, a block at a time.
    """
    mixed = sized.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("n").alias("m")).where("a <> b").select("key", "m")
    size = F.greatest("m", F.ceil(F.col("n") * least / 100))
    need = cut(sized.join(mixed, "key").groupBy("c").agg(F.first("label").alias("label"), F.min(F.ceil((F.col("n") + size) * least / (100 + least))).alias("enough")))
    many = need.count()
    if not many:
        return None
    parts = -(-many // group)
    opened = cut(need.join(bodies, "c").withColumn("block", F.pmod(F.xxhash64("c"), F.lit(parts))))
    told = cut(opened.groupBy("block").applyInArrow(_shares(buckets(sized)), _SHARE))
    met = told.where("bucket >= 0").groupBy("bucket").applyInArrow(_meet, _SHARE)
    rows = told.unionByName(met).groupBy("block").applyInArrow(_prefix, "c long, h long").join(opened.select("c", "label", "block"), "c")
    rows = cut(rows)
    # told apart by shingle and component, so that the many members of a shingle's largest component meet nothing by shingle alone
    counts = cut(rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("many")))
    most = counts.groupBy("h").agg(F.max_by("label", F.struct("many", "label")).alias("most"))
    few = rows.join(counts.join(most, "h").where("label <> most").select("h", "label"), ["h", "label"]).select("h", F.col("c").alias("x"))
    meets = few.join(rows.select("h", "block").distinct(), "h").select("x", "block").distinct()
    counts = meets.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("shares"))
    some = meets.join(counts, "block").select("x", "block", F.pmod(F.xxhash64("x"), F.col("shares")).cast("int").alias("share"))
    some = some.join(opened.select(F.col("c").alias("x"), F.col("label").alias("of"), F.col("body").alias("own")), "x")
    whole = opened.join(counts, "block").select("c", "label", "body", F.col("block").alias("at"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("turn"))
    return some.groupBy("block", "share").cogroup(whole.groupBy("at", "turn")).applyInArrow(_confirm_block(least), "a long, b long")


def near_duplicates(docs: DataFrame, least: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the documents it is linked with, directly or not), kept."""
    plain = texts(docs)
    rows = cut(plain.mapInArrow(_sketch, "doc_id long, n_shingles long, c long, bands array<long>"))
    known = rows.where("c is not null and doc_id is not null")
    classes = cut(known.groupBy("c").agg(F.min("doc_id").alias("m"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")))
    local = cut(classes.select("c", "bands").mapInArrow(_within, _BUCKET))
    ends = cut(local.where("not local").select("key", "c").repartition("key").mapInArrow(_across, _BUCKET))
    members = local.where("local").unionByName(ends)
    pairs = cut(members.where("c <> centre").select("c", "centre").distinct())
    if pairs.isEmpty():
        return _answer(rows, classes, None)
    needed = pairs.select(F.explode(F.array("c", "centre")).alias("c")).distinct().join(classes.select("c", "m"), "c")
    bodies = plain.join(needed.withColumnRenamed("m", "doc_id"), "doc_id").select("text", "c").mapInArrow(_body, "c long, body binary")
    bodies = cut(bodies.groupBy("c").agg(F.first("body").alias("body")))
    links = cut(confirmed(pairs, bodies, least))
    label = components(links)

    # what may still have a link meets the members of other components
    sizes = members.select("key", "c").distinct().join(classes.select("c", "n"), "c")
    labelled = sizes.join(label.withColumnRenamed("node", "c"), "c", "left").select("key", "c", "n", F.coalesce("label", "c").alias("label"))
    last = across_components(cut(labelled), bodies, least)
    if last is not None and not (last := cut(last)).isEmpty():
        label = components(links.unionByName(last))
    return _answer(rows, classes, label)


def _answer(rows: DataFrame, classes: DataFrame, label: DataFrame | None) -> DataFrame:
    """The result, of the rows by class, the classes' smallest doc_ids and the components' labels (None: no links)."""
    found = classes.select("c", F.col("m").alias("low"))
    if label is not None:
        named = classes.select("c", "m").join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
        lowest = named.groupBy("label").agg(F.min("m").alias("low"))
        found = named.join(lowest, "label").select("c", "low")
    out = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("c")).join(found, "c", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
