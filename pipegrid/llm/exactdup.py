"""Repeated passages across documents, by merging Burrows-Wheeler transforms.

Every window of ``width`` bytes has an anchor: the leftmost of its ``gram``-byte strings with the smallest hash, which depends on
the window alone, so equal windows have equal anchors at equal places. The windows of a document that share an anchor form a
context (at most 2 * width - gram bytes), and repeated windows can only lie in contexts whose anchor occurs in several
documents. That splits the corpus into independent buckets of anchors:

1. each block of documents tells each bucket its distinct (anchor, context hash) with the smallest doc_id;
2. a bucket drops anchors of a single document. An anchor whose contexts are all equal (by 40 bits of the anchor's hash and 64
   of the context's) is one string, with nothing to merge. Of the others the bucket asks one block for the bytes of each
   distinct context;
3. the bucket deals its contexts (the anchor as a single symbol) to shards, builds the shards' transforms and merges them by
   interleave refinement; the blocks of suffixes with a common prefix of a window's length are the repeated intervals, and each
   gives the smallest doc_id in which the window occurs. Whole anchors are merged together, up to a number of contexts at
   once; the contexts of an anchor that has more are split into windows, dealt by the anchor's place in them and by hash;
4. the blocks of documents get these back and remove every byte that a window covers which occurs in a smaller doc_id.

A passage or document that a third of all rows share is one context per block and bucket, so hot groups are aggregated before
they are shuffled. Null text is empty; texts shorter than a window stay whole. A null doc_id counts as larger than any other;
rows that repeat a doc_id do not remove from each other. An empty table gives an empty table; other columns are ignored.
Matches are judged on the input, and overlapping windows count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.llm.bwt import repeated
from pipegrid.llm.common import spread, table, utf8, with_text
from pipegrid.llm.neardup import _LETTER, _U, mix

WIDTH, GRAM = 50, 25
_SLICE = 1 << 19
_NULL = (1 << 63) - 1
_FACTOR = 0x9E3779B97F4A7C15
_SHARDS = 4
#: Bytes of text of a block of documents, and of all documents per bucket of anchors.
_BLOCK, _BUCKET = 4 << 20, 16 << 20
#: Contexts whose transforms are merged at once.
_MERGE = 32_000
_ANCHOR, _END = 255, 0  # no UTF-8 text holds byte 255; bytes are raised by one, so 0 is free for the end


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_FACTOR, pow(_FACTOR, -1, 1 << 64)):
        x = np.full(n, base, _U)
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Entries:
    """The contexts of a block of documents: occurrences (document, first window, windows, anchor) and the distinct ones."""

    def __init__(self, t: pa.Table, width: int = WIDTH, gram: int = GRAM):
        self.data, self.offsets = utf8(t.column("text"))
        raw = t.column("doc_id").to_pylist()
        self.ids = raw
        self.order_ids = np.array([_NULL if i is None else i for i in raw], np.int64)
        parts = []
        lens = np.diff(self.offsets)
        part = (np.cumsum(lens) - lens) // _SLICE if len(lens) else lens
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lens)]
        longest = max((self.offsets[b] - self.offsets[a] for a, b in zip(edges, edges[1:], strict=False)), default=0)
        power, inverse = _powers(int(longest) + 1)
        for a, b in zip(edges, edges[1:], strict=False):
            if self.offsets[b] - self.offsets[a] >= width:
                parts.append(self._scan(a, b, width, gram, power, inverse))
        none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, _U)] * 2
        self.doc, self.first, self.count, self.place, anchor, context = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else none
        # distinct (anchor, context) in order; `which` is the number of each occurrence's entry
        self.smallest, self.many = np.zeros(0, np.int64), np.zeros(0, bool)
        # by 40 bits of the anchor and 24 of the context; should these be equal for two contexts, an entry may occur twice
        by = np.argsort(((anchor >> _U(24)) << _U(24)) | (context >> _U(40)), kind="stable")
        head = np.ones(len(by), bool)
        if len(by):
            head[1:] = (anchor[by][1:] != anchor[by][:-1]) | (context[by][1:] != context[by][:-1])
            starts = np.flatnonzero(head)
            ids = self.order_ids[self.doc[by]]
            self.smallest = np.minimum.reduceat(ids, starts)
            self.many = np.maximum.reduceat(ids, starts) > self.smallest
            self.anchor, self.context, self.sample = anchor[by][starts], context[by][starts], by[starts]
        else:
            self.anchor, self.context, self.sample = np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64)
        self.which = np.empty(len(by), np.int64)
        self.which[by] = np.cumsum(head) - 1

    def _scan(self, a, b, width, gram, power, inverse):
        base = self.offsets[a]
        data = self.data[base : self.offsets[b]]
        n = len(data)
        sums = np.zeros(n + 1, _U)
        np.cumsum(_LETTER[data] * power[:n], out=sums[1:])
        hashed = (sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1] * _U(0xBF58476D1CE4E5B9)
        hashed ^= hashed >> _U(29)
        # the smallest hash of each run of `run` hashes, by doubling
        run, size = width - gram + 1, 1
        low = hashed
        while size < run:
            step = min(size, run - size)
            low = np.minimum(low[step:], low[:-step])
            size += step
        # pieces of windows with one smallest hash, within a document
        bounds = self.offsets[a : b + 1] - base
        head = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=head[1:])
        ends = bounds[1:] - width + 1
        head[bounds[:-1][bounds[:-1] < len(low)]] = True
        head[ends[(ends >= 0) & (ends < len(low))]] = True
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(low)))
        doc = np.searchsorted(bounds, first, side="right") - 1
        good = first < ends[doc]
        first, count, doc = first[good], count[good], doc[good]
        anchor = self._leftmost(hashed, first, low[first], run)
        again = np.flatnonzero(first + count - 1 > anchor)
        if len(again):  # a repeated string: the windows beyond its first place have a later one as their anchor
            first, count, doc, anchor = self._repeated(hashed, low, run, first, count, doc, anchor, again)
        doc = doc + a
        end = first + count - 1 + width
        context = mix((sums[end] - sums[first]) * inverse[first] + (count * 64 + anchor - first).astype(_U))
        return doc, first + base, count, anchor + base, mix(hashed[anchor]), context

    @staticmethod
    def _leftmost(hashed: np.ndarray, first: np.ndarray, value: np.ndarray, run: int) -> np.ndarray:
        """The first place of value in the run of hashes from each first."""
        out = np.empty(len(first), np.int64)
        for k in range(0, len(first), 1 << 15):
            part = first[k : k + (1 << 15)]
            out[k : k + (1 << 15)] = part + (hashed[part[:, None] + np.arange(run)] == value[k : k + (1 << 15), None]).argmax(axis=1)
        return out

    @staticmethod
    def _repeated(hashed, low, run, first, count, doc, anchor, again):
        """Pieces cut where the leftmost place of their smallest hash changes; again: the pieces in which it does."""
        rest = np.setdiff1d(np.arange(len(first)), again)
        windows, owner = spread(first[again], count[again]), np.repeat(doc[again], count[again])
        piece = np.repeat(again, count[again])
        place = Entries._leftmost(hashed, windows, low[windows], run)
        head = np.ones(len(windows), bool)
        head[1:] = (place[1:] != place[:-1]) | (piece[1:] != piece[:-1])
        starts = np.flatnonzero(head)
        many = np.diff(np.append(starts, len(windows)))
        return tuple(np.concatenate(x) for x in ((first[rest], windows[starts]), (count[rest], many), (doc[rest], owner[starts]), (anchor[rest], place[starts])))

    def bucket_edges(self, n: int) -> np.ndarray:
        """Where the entries of each of n buckets begin; buckets are equal ranges of the anchor's first 32 bits."""
        return np.searchsorted(_bucket(self.anchor, n), np.arange(n + 1))


def _bucket(anchor: np.ndarray, n: int) -> np.ndarray:
    return ((anchor >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers as compressed byte planes."""
    return zstandard.compress(b"".join(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in arrays), 1)


def _unzip(raw: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(n, 8, -1)
    return [np.ascontiguousarray(x.T).view("<i8").ravel() for x in planes]


_MAIL = "target int, source int, kind string, body binary"


def _mail(rows: list[tuple]) -> pa.Table:
    a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.table([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.string()), pa.array(d, pa.binary())], names=["target", "source", "kind", "body"])


def _tell(n: int, part: str):
    def run(t: pa.Table) -> pa.Table:
        e, own = Entries(t), t.column(part)[0].as_py()
        edges = e.bucket_edges(n).tolist()
        # 40 bits of the anchor, as steps, and the whole context: more anchors than one under a name do no harm
        anchor, context = (e.anchor >> _U(24)).astype(np.int64), e.context.view(np.int64)
        rows = []
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            if a < b:
                rows.append((k, own, "entries", _zip(np.diff(anchor[a:b], prepend=0), context[a:b], e.smallest[a:b], e.many[a:b])))
        return _mail(rows)

    return run


def _meet(parts: int):
    """A bucket's verdicts to blocks (kind single), requests for bytes (kind want), and what it must remember (kind keep)."""

    def run(t: pa.Table) -> pa.Table:
        bucket, got = t.column("target")[0].as_py(), []
        for source, body in sorted(zip(t.column("source").to_pylist(), t.column("body").to_pylist(), strict=True)):
            step, context, low, many = _unzip(body, 4)
            got.append((np.cumsum(step), context, low, many > 0, np.full(len(step), source), np.arange(len(step))))
        anchor, context, low, many, source, index = (np.concatenate(x) for x in zip(*got, strict=True))
        short = (anchor & 0xFFFFFFFF).astype(_U) << _U(32) | (context & 0xFFFFFFFF).astype(_U)
        order = np.argsort(short, kind="stable")
        same = short[order][1:] == short[order][:-1]
        if (same & ((anchor[order][1:] != anchor[order][:-1]) | (context[order][1:] != context[order][:-1]))).any():
            order = np.lexsort((context, anchor))
        anchor, context, low, many, source, index = (x[order] for x in (anchor, context, low, many, source, index))
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = anchor[1:] != anchor[:-1]
        starts, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
        shared = np.logical_or.reduceat(many, starts) | (np.minimum.reduceat(low, starts) < np.maximum.reduceat(low, starts))
        new = fresh.copy()
        new[1:] |= context[1:] != context[:-1]
        several = np.add.reduceat(new.astype(np.int64), starts) > 1
        lowest = np.minimum.reduceat(low, np.flatnonzero(new))[np.cumsum(new) - 1]
        rows = []
        single = np.flatnonzero((shared & ~several)[group])
        rows += _deal("single", bucket, source[single], index[single], lowest[single])
        open_ = np.flatnonzero((shared & several)[group])
        if len(open_):
            asked = open_[new[open_]]
            rows += _deal("want", bucket, source[asked], index[asked])
            number = np.cumsum(new[open_]) - 1
            rows.append((parts + bucket, bucket, "keep", _zip(number, source[open_], index[open_], lowest[open_], group[open_])))
        return _mail(rows)

    return run


def _deal(kind: str, bucket: int, source: np.ndarray, *arrays: np.ndarray) -> list[tuple]:
    """A row for each block (source) with its share of the arrays, in the order of the first."""
    order = np.lexsort((arrays[0], source))
    source, arrays = source[order], [x[order] for x in arrays]
    edges = np.flatnonzero(np.diff(source, prepend=-1, append=-1)) if len(source) else np.zeros(0, np.int64)
    return [(int(source[a]), bucket, kind, _zip(*(x[a:b] for x in arrays))) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]


def _send(n: int, parts: int, part: str):
    """A block's bytes for the contexts that buckets asked for."""

    def run(t: pa.Table, mail: pa.Table) -> pa.Table:
        asked = [r for r in mail.to_pylist() if r["kind"] == "want"]
        if not asked or not t.num_rows:
            return _mail([])
        e, own, rows = Entries(t), t.column(part)[0].as_py(), []
        edges = e.bucket_edges(n)
        for r in asked:
            (index,) = _unzip(r["body"], 1)
            some = e.sample[edges[r["source"]] + index]
            lens = e.count[some] + WIDTH - 1
            body = zstandard.compress(e.data[spread(e.first[some], lens)].tobytes(), 1)
            head = _zip(index, e.count[some], e.place[some] - e.first[some])
            rows.append((parts + r["source"], own, "bytes", len(head).to_bytes(4, "little") + head + body))
        return _mail(rows)

    return run


def _solve():
    """Merge the transforms of a bucket's contexts, and tell each block the smallest doc_id of every window (kind runs)."""

    def run(t: pa.Table) -> pa.Table:
        mail = t.to_pylist()
        kept = [r for r in mail if r["kind"] == "keep"]
        if not kept:
            return _mail([])
        number, source, index, low, group = _unzip(kept[0]["body"], 5)
        bucket = kept[0]["source"]
        at = {}
        for r in mail:
            if r["kind"] == "bytes":
                size = int.from_bytes(r["body"][:4], "little")
                some, count, rel = _unzip(r["body"][4 : 4 + size], 3)
                body = np.frombuffer(zstandard.decompress(r["body"][4 + size :]), np.uint8)
                lens = count + WIDTH - 1
                starts = np.cumsum(lens) - lens
                at[r["source"]] = (some, count, rel, body, starts)
        asked = np.flatnonzero(np.diff(number, prepend=-1))
        doc = low[asked]
        count, rel, texts_ = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), np.zeros((len(asked), 2 * WIDTH - GRAM), np.uint8)
        for s, (some, c, r, body, starts) in at.items():
            own = np.flatnonzero(source[asked] == s)
            k = np.searchsorted(some, index[asked][own])
            count[own], rel[own] = c[k], r[k]
            lens = c[k] + WIDTH - 1
            rows = np.repeat(own, lens)
            texts_[rows, spread(np.zeros(len(lens), np.int64), lens)] = body[spread(starts[k], lens)]
        lowest = solve_parts(texts_, count, rel, doc, group[asked])
        # per context the runs of windows with the same smallest doc_id
        ends = np.cumsum(count)
        context = np.repeat(np.arange(len(count)), count)
        head = np.ones(len(lowest), bool)
        head[1:] = (lowest[1:] != lowest[:-1]) | (context[1:] != context[:-1])
        begin = np.flatnonzero(head)
        length = np.diff(np.append(begin, len(lowest)))
        offset = begin - (ends - count)[context[begin]]
        runs = np.bincount(context[begin], minlength=len(count))
        first = np.cumsum(runs) - runs
        many = runs[number]
        pick = spread(first[number], many)
        return _mail(_deal("runs", bucket, np.repeat(source, many), np.repeat(index, many), offset[pick], length[pick], lowest[begin[pick]]))

    return run


def solve_parts(texts_: np.ndarray, count: np.ndarray, rel: np.ndarray, doc: np.ndarray, name: np.ndarray, most: int = _MERGE) -> np.ndarray:
    """solve_contexts of about most contexts at a time."""
    out = np.empty(int(count.sum()), np.int64)
    begin = np.cumsum(count) - count
    starts = np.flatnonzero(np.diff(name, prepend=-1))
    sizes = np.diff(np.append(starts, len(name)))
    few = sizes <= most
    part = np.repeat((np.cumsum(np.where(few, sizes, 0)) - 1) // most, sizes)
    usual = np.flatnonzero(np.repeat(few, sizes))
    edges = np.flatnonzero(np.diff(part[usual], prepend=-1, append=-2))
    for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
        own = usual[a:b]
        out[spread(begin[own], count[own])] = solve_contexts(texts_[own], count[own], rel[own], doc[own], name[own])
    for a, size in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
        group = np.arange(a, a + size)
        for place in range(WIDTH - GRAM + 1):  # equal windows have the anchor at the same place
            at = rel[group] - place
            own = group[(at >= 0) & (at < count[group])]
            at = rel[own] - place
            windows = texts_[own[:, None], at[:, None] + np.arange(WIDTH)]
            deal = (mix((_LETTER[windows] * _powers(WIDTH)[0]).sum(axis=1, dtype=_U)) % _U(max(1, -(-len(own) // most)))).astype(np.int64)
            for k in np.unique(deal):
                x = np.flatnonzero(deal == k)
                one = np.ones(len(x), np.int64)
                out[begin[own[x]] + at[x]] = solve_contexts(windows[x], one, one * 0 + place, doc[own[x]], one)
    return out


def solve_contexts(texts_: np.ndarray, count: np.ndarray, rel: np.ndarray, doc: np.ndarray, name: np.ndarray) -> np.ndarray:
    """The smallest doc of each window of each context (rows of bytes, with count windows and the anchor at rel).

    name: equal for equal anchors, one after the other; checked here, since it comes from a hash.
    """
    n = len(count)
    place = np.arange(GRAM)
    grams = np.ascontiguousarray(texts_[np.arange(n)[:, None], rel[:, None] + place])
    if ((name[1:] == name[:-1]) & (grams[1:] != grams[:-1]).any(axis=1)).any():
        _, name = np.unique(grams, axis=0, return_inverse=True)
    lens = count + WIDTH - GRAM
    column = np.arange(texts_.shape[1])
    keep = (column < (count + WIDTH - 1)[:, None]) & ~((column > rel[:, None]) & (column < (rel + GRAM)[:, None]))
    symbols = texts_ + np.uint8(1)
    symbols[np.arange(n), rel] = _ANCHOR
    depth = WIDTH - GRAM + 1
    # neighbours in the order of anchors go to different shards
    shard = np.empty(n, np.int64)
    shard[np.argsort(name, kind="stable")] = np.arange(n) % _SHARDS
    own = [np.flatnonzero(shard == s) for s in range(min(_SHARDS, n))]
    z, suffix, block = repeated([symbols[x][keep[x]] for x in own], [lens[x] for x in own], depth)
    lowest = np.zeros(int(count.sum()), np.int64)
    begin = np.cumsum(count) - count
    string, offset, blocks_ = [], [], []
    for s, x in enumerate(own):
        ends = np.cumsum(lens[x] + 1)
        here = np.flatnonzero(z == s)
        k = np.searchsorted(ends, suffix[here], side="right")
        off = suffix[here] - (ends - lens[x] - 1)[k]
        good = off < count[x][k]
        string.append(x[k[good]]), offset.append(off[good]), blocks_.append(block[here[good]])
    string, offset, blocks_ = (np.concatenate(v) for v in (string, offset, blocks_))
    order = np.lexsort((doc[string], name[string], blocks_))
    string, offset, blocks_ = string[order], offset[order], blocks_[order]
    head = np.ones(len(string), bool)
    head[1:] = (blocks_[1:] != blocks_[:-1]) | (name[string][1:] != name[string][:-1])
    starts = np.flatnonzero(head)
    lowest[begin[string] + offset] = doc[string][starts][np.cumsum(head) - 1]
    return lowest


def _covered(t: pa.Table, mail: pa.Table, n: int) -> tuple[Entries, np.ndarray]:
    """The block's entries, and for each of its bytes whether it goes."""
    e = Entries(t)
    edges = e.bucket_edges(n)
    entry, offset, length, low = [], [], [], []
    for r in mail.to_pylist():
        if r["kind"] == "single":
            index, lowest = _unzip(r["body"], 2)
            index = index + edges[r["source"]]
            entry.append(index), offset.append(np.zeros(len(index), np.int64)), length.append(e.count[e.sample[index]]), low.append(lowest)
        elif r["kind"] == "runs":
            index, off, size, lowest = _unzip(r["body"], 4)
            entry.append(index + edges[r["source"]]), offset.append(off), length.append(size), low.append(lowest)
    cover = np.zeros(len(e.data) + 1, np.int32)
    if entry:
        entry, offset, length, low = (np.concatenate(x) for x in (entry, offset, length, low))
        order = np.argsort(entry, kind="stable")
        entry, offset, length, low = entry[order], offset[order], length[order], low[order]
        first = np.searchsorted(entry, np.arange(len(e.anchor) + 1))
        many = np.diff(first)[e.which]
        occurrence = np.repeat(np.arange(len(e.which)), many)
        run = spread(first[:-1][e.which], many)
        gone = e.order_ids[e.doc[occurrence]] > low[run]
        occurrence, run = occurrence[gone], run[gone]
        begin = e.first[occurrence] + offset[run]
        np.add.at(cover, begin, 1)
        np.subtract.at(cover, begin + length[run] + WIDTH - 1, 1)
    return e, np.cumsum(cover[:-1], dtype=np.int32) > 0


def _remove(n: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(t: pa.Table, mail: pa.Table) -> pa.Table:
        e, gone = _covered(t, mail, n) if t.num_rows else (None, None)
        ids, size, spans, kept = [], [], [], []
        if e:
            for a, b in zip(e.offsets[:-1].tolist(), e.offsets[1:].tolist(), strict=True):
                own = gone[a:b]
                turn = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist() if own.any() else []
                spans.append([{"start": x, "end": y} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                kept.append((e.data[a:b][~own] if turn else e.data[a:b]).tobytes())
            ids, size = e.ids, np.diff(e.offsets)
        return pa.table([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return run


def _rewrite(n: int, names: list[str]):
    def run(t: pa.Table, mail: pa.Table) -> pa.Table:
        if not t.num_rows:
            return t.select(names)
        e, gone = _covered(t, mail, n)
        kept = [e.data[a:b][~gone[a:b]].tobytes().decode(errors="ignore") for a, b in zip(e.offsets[:-1].tolist(), e.offsets[1:].tolist(), strict=True)]
        return with_text(t, kept).select(names)

    return run


def _judged(docs: DataFrame, last, schema) -> DataFrame:
    """Every block of docs (doc_id, text and more) with the verdicts of all buckets, through last.

    Which block a row is in makes no difference, so rows that share a doc_id, or have none, are dealt by their text as well,
    and equal rows by the partition that they are read in.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    n, parts = max(4, -(-size // _BUCKET)), max(8, -(-size // _BLOCK))
    part = "part"
    while part in {c.lower() for c in docs.columns}:
        part += "_"
    plain = docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    blocks = plain.withColumn(part, F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(parts)).cast("int")).groupBy(part)
    told = blocks.applyInArrow(_tell(n, part), _MAIL)
    met = told.groupBy("target").applyInArrow(_meet(parts), _MAIL)
    fresh = lambda df: df.select(F.col("target").alias("to"), F.col("source").alias("source"), F.col("kind").alias("kind"), F.col("body").alias("body"))
    sent = blocks.cogroup(fresh(met).groupBy("to")).applyInArrow(_send(n, parts, part), _MAIL)
    solved = met.where("kind = 'keep'").unionByName(sent).groupBy("target").applyInArrow(_solve(), _MAIL)
    back = met.where("kind = 'single'").unionByName(solved)
    return blocks.cogroup(fresh(back).groupBy("to")).applyInArrow(last(n), schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of the removed bytes) and kept (the remaining bytes) of every row."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _judged(own, _remove, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the same columns (among them doc_id, a long, and text), each text without repeated passages."""
    return _judged(docs, lambda n: _rewrite(n, docs.columns), docs.schema)


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
