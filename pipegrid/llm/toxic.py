"""Toxicity by the nearest labelled examples.

A text's terms are its words (runs of ASCII letters and digits and of bytes above 127, letters of Latin-1 lower-cased) and the first
four and six bytes of longer words. Examples are a sample of the labelled documents, at most ``most_toxic`` and ``most_clean`` of each
label, those with the smallest hashes of their doc_id. The vocabulary holds the terms of at least three examples that tell the
labels apart best, by rank of chi-square over the examples: as many as chance would hardly give (a chi-square that one term in
all would reach by chance), or one for every 3,500 pairs of examples if these are more (further terms help where examples
are many), at least five and at most ``most_terms``. Their document frequencies are counted over the whole corpus. A text's vector is TF-IDF over the
vocabulary, of length one, and its evidence the k examples of the largest exact cosine.

The examples stand in an inverted index by blocks of 64. For each term and block the largest weight is known, which bounds a
text's cosine with any example of a block (summed over the text's own terms, so the vocabulary's size costs nothing). The
blocks with the highest bounds are scored first; then only blocks whose bound reaches the k-th best cosine, so the result is exact. Votes are weighted by cosine and calibrated on the examples themselves
(each scored without itself) by a logistic regression that weighs labels as they occur among all labelled rows.

Null text is empty. A text without a vocabulary term has the smoothed share of toxic ones among such examples as its
score. Labels of a doc_id that repeat are averaged (half counts as toxic); null labels are left out; of the texts of
an example's doc_id that repeats the smallest is the example. Without examples every
score is 0. A null doc_id is scored and not held out. Repeated rows stay repeated, equal texts get equal scores, an empty
table gives an empty table, and columns besides doc_id and text are ignored: the score depends on the text alone.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipegrid.llm.common import blocks, cut, rewrite, spread, table, texts, utf8
from pipegrid.llm.neardup import _LETTER, _LOWER, _U, mix

_BLOCK = 1 << 20
_OUTSIDE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_PREFIXES = (4, 6)
#: Texts that are searched for at once, and the least cosine that counts (cosines have nine places).
_TEXTS, _NEAR = 256, 1e-9
_TAG = 0xD1B54A32D192ED03


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term hashes of the texts in data, and the number of the text that each is from."""
    outside = _OUTSIDE[data]
    begins = ~outside
    begins[1:] &= outside[:-1]
    inner = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    begins[inner] = ~outside[inner]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    place = np.zeros(len(data), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    powers = np.full(int(place.max()) + 1, 0x9E3779B97F4A7C15, _U)
    powers[0] = 1
    low = _LOWER[data]
    low[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)] += 32  # capital letters of Latin-1
    value = _LETTER[low] * np.multiply.accumulate(powers)[place]
    value[outside] = 0
    sizes = np.add.reduceat((~outside).astype(np.int64), starts)
    text = np.searchsorted(offsets, starts, side="right") - 1
    words = mix(np.add.reduceat(value, starts))
    out = [(words, text)]
    for size in reversed(_PREFIXES):
        value[place >= size] = 0
        long = sizes > size
        out.append((mix(np.add.reduceat(value, starts) ^ _U(_TAG * size % (1 << 64)))[long], text[long]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def counted(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of text number, term and frequency, by text; with a vocabulary (sorted hashes) a term is its number in it."""
    term, text = terms(data, offsets)
    if vocabulary is not None:
        if not len(vocabulary):
            return (np.zeros(0, np.int64),) * 3
        k = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
        good = vocabulary[k] == term
        term, text = k[good], text[good]
    order = np.lexsort((term, text))
    term, text = term[order], text[order]
    head = np.ones(len(term), bool)
    head[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(head)
    return text[starts], term[starts], np.diff(np.append(starts, len(term)))


class Index:
    """A block-max inverted index of examples and the search for a text's nearest."""

    SIZE = 64

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, rows: list[tuple[int, int, list[int], list[int]]]):
        """rows: doc_id, label, terms (numbers in the vocabulary) and frequencies of each example."""
        self._made = None
        self.vocabulary, self.idf = vocabulary, idf
        leading = [max(zip(idf[r[2]].tolist(), r[2], strict=True))[1] if r[2] else -1 for r in rows]
        order = sorted(range(len(rows)), key=lambda i: (leading[i], rows[i][1], rows[i][0], i))  # alike examples share blocks
        rows = [rows[i] for i in order]
        self.ids, self.labels = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        many = np.array([len(r[2]) for r in rows], np.int64)
        example = np.repeat(np.arange(len(rows)), many)
        term = np.array([x for r in rows for x in r[2]], np.int64)
        weight = self.weigh(example, term, np.array([x for r in rows for x in r[3]], np.int64), len(rows))
        self.example_rows = (example, term, weight)
        self.n_blocks = max(1, -(-len(rows) // self.SIZE))
        key = term * self.n_blocks + example // self.SIZE
        order = np.lexsort((example, key))
        self.example, self.weight = example[order], weight[order]
        self.start = np.searchsorted(key[order], np.arange(len(vocabulary) * self.n_blocks + 1))
        self.most = np.zeros((len(vocabulary), self.n_blocks))
        np.maximum.at(self.most, (term, example // self.SIZE), weight)

    def weigh(self, row: np.ndarray, term: np.ndarray, frequency: np.ndarray, n: int) -> np.ndarray:
        w = (1 + np.log(np.maximum(frequency, 1))) * self.idf[term]
        norm = np.sqrt(np.bincount(row, w * w, minlength=n))
        return w / np.maximum(norm[row], 1e-300)

    def _blocks(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each block's terms and their weights by example of the block, made once where they are used."""
        if self._made is None:
            term = np.repeat(np.arange(len(self.vocabulary)), np.diff(self.start[:: self.n_blocks]))
            place, own = np.argsort(self.example // self.SIZE, kind="stable"), []
            edges = np.searchsorted((self.example // self.SIZE)[place], np.arange(self.n_blocks + 1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                terms_, at = np.unique(term[place[a:b]], return_inverse=True)
                weights = np.zeros((len(terms_), self.SIZE))
                weights[at, self.example[place[a:b]] % self.SIZE] = self.weight[place[a:b]]
                own.append((terms_, weights))
            self._made = own
        return self._made

    def _some(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bound, own = np.zeros((n, self.n_blocks)), np.zeros((n, len(self.vocabulary)))
        own[row, term] = weight
        if len(row):  # sums over a text's own terms alone, whatever the vocabulary's size
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            bound[row[starts]] = np.add.reduceat(self.most[term] * weight[:, None], starts, axis=0)
        cosine, least = np.zeros((n, self.n_blocks * self.SIZE)), np.full(n, _NEAR)
        ahead = np.argsort(-bound, axis=1, kind="stable")[:, : max(2, -(-k // self.SIZE))]
        asked = np.zeros(bound.shape, bool)
        np.put_along_axis(asked, ahead, True, axis=1)
        asked &= bound > 0
        done = asked
        for step in (0, 1):
            for b in np.flatnonzero(asked.any(axis=0)).tolist():
                texts_, (terms_, weights) = np.flatnonzero(asked[:, b]), self._blocks()[b]
                cosine[texts_, b * self.SIZE : (b + 1) * self.SIZE] = np.round(own[np.ix_(texts_, terms_)] @ weights, 9)
            known = cosine if step else np.take_along_axis(cosine.reshape(n, self.n_blocks, -1), ahead[:, :, None], axis=1).reshape(n, -1)
            if k < known.shape[1]:
                least = np.maximum(_NEAR, np.partition(known, -k, axis=1)[:, -k])
            asked = (bound + _NEAR >= least[:, None]) & (bound > 0) & ~done
        i, example = np.nonzero(cosine >= least[:, None])
        order = np.lexsort((example, -cosine[i, example], i))
        i, example = i[order], example[order]
        good = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[good], example[good], cosine[i[good], example[good]]

    def nearest(self, row: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, example, cosine to nine places) of the k nearest examples of positive cosine of n texts, best first, ties by place.

        row, term and weight: the texts' terms, by text.
        """
        edges = np.searchsorted(row, np.arange(0, n + _TEXTS, _TEXTS)).tolist()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a, x, y in zip(range(0, n, _TEXTS), edges, edges[1:], strict=False):
            i, example, cosine = self._some(row[x:y] - a, term[x:y], weight[x:y], min(_TEXTS, n - a), k)
            found.append((i + a, example, cosine))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def votes(self, found, n: int) -> np.ndarray:
        """Per text: the toxic share of the cosines, the best cosine, and whether there is any neighbour."""
        i, example, score = found
        total, toxic = np.bincount(i, score, minlength=n), np.bincount(i, score * self.labels[example], minlength=n)
        best = np.zeros(n)
        np.maximum.at(best, i, score)
        return np.stack([toxic / np.maximum(total, 1e-300), best, total > 0], axis=1)


def _design(votes: np.ndarray) -> np.ndarray:
    v, best = votes[:, 0], votes[:, 1]
    return np.stack([np.ones(len(v)), v, best, v * best], axis=1)


def calibrate(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic weights over the votes, and the score of texts without a neighbour."""
    lone = votes[:, 2] == 0
    rest = (weights[lone] * labels[lone]).sum() + 0.5
    share = rest / (weights[lone].sum() + 2 + rest)
    x, y, w = _design(votes[~lone]), labels[~lone].astype(float), weights[~lone]
    beta = np.zeros(x.shape[1])
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        beta += np.linalg.solve(hessian, x.T @ (w * (y - p)) - 0.05 * beta)
    return beta, float(share)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _features(vocabulary):
    def run(batches):
        for t in blocks(batches, _BLOCK):
            text, term, frequency = counted(*utf8(t.column("text")), vocabulary)
            ends = np.searchsorted(text, np.arange(t.num_rows + 1)).tolist()
            cells = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int64)))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), t.column("toxic").combine_chunks(), cells(term), cells(frequency)], names=["doc_id", "toxic", "terms", "many"])

    return run


def _frequencies(vocabulary):
    def run(batches):
        total = np.zeros(len(vocabulary), np.int64)
        for t in blocks(batches, _BLOCK):
            total += np.bincount(counted(*utf8(t.column("text")), vocabulary)[1], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    return run


class Model:
    """An index with its calibration."""

    def __init__(self, index: Index, beta: np.ndarray, lone: float, k: int):
        self.index, self.beta, self.lone, self.k = index, beta, lone, k

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, tuple]:
        n = len(offsets) - 1
        if not len(self.index.ids):
            return np.zeros(n), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        row, term, frequency = counted(data, offsets, self.index.vocabulary)
        found = self.index.nearest(row, term, self.index.weigh(row, term, frequency, n), n, self.k)
        votes = self.index.votes(found, n)
        p = 1 / (1 + np.exp(-np.clip(_design(votes) @ self.beta, -30, 30)))
        return np.where(votes[:, 2] > 0, p, self.lone), found


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = 2000, most_clean: int = 4000, most_terms: int = 2000, least: float = 0.0, k: int = 15) -> Model:
    """A model from the labelled rows (doc_id, toxic) that are not held out; see the module for what the bounds bound."""
    told = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    told = cut(told.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")))
    many = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [told.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y, most in ((1, most_toxic), (0, most_clean))]
    sample = F.broadcast(cut(chosen[0].unionByName(chosen[1])))  # at most most_toxic + most_clean rows
    own = texts(docs).join(sample, "doc_id").select("doc_id", "text", "toxic")
    # of an id that repeats with several texts the first in order counts, so that no id is more than one example
    own = cut(own.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("doc_id", "text", "toxic").mapInArrow(_features(None), "doc_id long, toxic int, terms array<long>, many array<long>"))
    size = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    found = own.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("ab"))
    a, b = F.col("a"), F.col("ab") - F.col("a")
    c, d = n1 - a, n0 - b
    chi = (n1 + n0) * F.pow(a * d - b * c, F.lit(2)) / ((a + b) * (c + d) * F.lit(float(max(n1, 1))) * F.lit(float(max(n0, 1))))
    picked = found.where("ab >= 3").withColumn("chi", F.when(c + d > 0, chi).otherwise(0.0)).where(F.col("chi") >= least)
    picked = cut(picked.select("term", "chi"))
    rare = NormalDist().inv_cdf(1 - 0.5 / max(2, picked.count())) ** 2
    wanted = min(most_terms, max(5, picked.where(F.col("chi") >= rare).count(), (n1 + n0) ** 2 // 3500))
    vocabulary = np.array(sorted(r["term"] & ((1 << 64) - 1) for r in picked.orderBy(F.desc("chi"), "term").limit(wanted).collect()), dtype=_U)
    df = np.zeros(len(vocabulary))
    plain = texts(docs)
    for r in plain.mapInArrow(_frequencies(vocabulary), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    idf = np.log((1 + plain.count()) / (1 + df)) + 1
    number = {int(v): i for i, v in enumerate(vocabulary.astype(np.int64).tolist())}
    kept = own.mapInArrow(_restrict(number), "doc_id long, toxic int, terms array<long>, many array<long>")
    rows = [tuple(r) for r in kept.orderBy("doc_id").collect()]
    index = Index(vocabulary, idf, rows)
    if not rows:
        return Model(index, np.zeros(4), 0.0, k)
    row, term, weight = index.example_rows
    votes = np.concatenate([_own_votes(index, a, min(a + 512, len(rows)), row, term, weight, k) for a in range(0, len(rows), 512)])
    weights = np.where(index.labels == 1, many.get(1, 0) / max(n1, 1), many.get(0, 0) / max(n0, 1))
    beta, lone = calibrate(votes, index.labels, weights)
    return Model(index, beta, lone, k)


def _own_votes(index: Index, a: int, b: int, row, term, weight, k: int) -> np.ndarray:
    """The votes on examples a to b, each without itself."""
    some = (row >= a) & (row < b)
    found = index.nearest(row[some] - a, term[some], weight[some], b - a, k + 1)
    i, example, score = found
    other = example != i + a
    i, example, score = i[other], example[other], score[other]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return index.votes((i[place < k], example[place < k], score[place < k]), b - a)


def _restrict(number: dict[int, int]):
    def run(batches):
        for batch in batches:
            terms_, many = [], []
            for t, m in zip(batch.column("terms").to_pylist(), batch.column("many").to_pylist(), strict=True):
                good = sorted((number[x], y) for x, y in zip(t, m, strict=True) if x in number)
                terms_.append([x for x, _ in good]), many.append([y for _, y in good])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(terms_, pa.list_(pa.int64())), pa.array(many, pa.list_(pa.int64()))], names=["doc_id", "toxic", "terms", "many"])

    return run


_SCORED = "doc_id long, score double, evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>"


def _apply(model):
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        own = model.value
        for t in blocks(batches, _BLOCK):
            score, (i, example, cosine) = own.score(*utf8(t.column("text")))
            ends = np.searchsorted(i, np.arange(t.num_rows + 1))
            fields = [pa.array(own.index.ids[example]), pa.array(cosine), pa.array(own.index.labels[example].astype(np.int32))]
            near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["doc_id", "cosine", "toxic"])).cast(kind)
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(score), near], names=["doc_id", "score", "evidence"])

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and evidence (the nearest examples with cosine and label) of every row."""
    return texts(docs).mapInArrow(_apply(docs.sparkSession.sparkContext.broadcast(model)), _SCORED)


def keep_clean(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """The rows of docs, with all columns (a null text as empty), whose score is under least."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rewrite(docs, lambda t: t.filter(pa.array(shared.value.score(*utf8(t.column("text")))[0] < least)), _BLOCK)


def op6_toxicity(spark, sf_dir: str, least: float = 0.7) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
