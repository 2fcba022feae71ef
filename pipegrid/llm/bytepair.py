"""Byte-level BPE by merge replay over the corpus's distinct words.

Blocks of documents number their pre-tokens and tell each bucket of words their distinct ones, so that every distinct word of
the corpus is encoded once, in one bucket. The words of a bucket lie one after the other as a linked list of symbols. An
inverted index goes from each merged token's rank to the positions of the pairs that would make it. Ranks are replayed in order:
all positions of a rank merge at once, and only the pairs with their left and right neighbours enter the index anew. A word in
which a merge made a pair of a lower rank than the one being replayed (possible in rank files that no merge list made) is
encoded again by itself, pair by pair, in n log n steps. Words that are a token as a whole take it directly, as the library
does. The ids go back to the blocks by name, where documents gather theirs.

Null text is empty (no ids). A null doc_id is a row like any other, repeated rows stay repeated, an empty table gives an
empty table, and columns besides doc_id and text are ignored. Blocks are bounded by bytes, so memory does not follow the input.
They are named by partition and place, so a partition that is read again after a loss has to come in the same order, as files
do; write anything else to a table first.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.llm.common import blocks, buckets, spread, table, texts
from pipegrid.llm.tokens import numbers, zipped

#: Bytes of text that share one list of numbered words.
BLOCK = 8 << 20


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Rank by token of a .tiktoken file's bytes."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class MergeReplay:
    """Ids of words by ranks; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.single < 0).any():
            raise ValueError("a byte has no rank")
        pairs = {(ranks[t[:k]] << 32 | ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pair = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.pair.tolist()], dtype=np.int64)
        lens = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.flat, self.length, self.start = np.frombuffer(b"".join(self.tokens), np.uint8), lens, np.cumsum(lens) - lens

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that a pair merges into, or -1."""
        key = left << 32 | right
        k = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[k] == key, self.made[k], -1)

    def one(self, word: bytes) -> list[int]:
        """The ids of a word by itself: always the lowest rank, the leftmost first."""
        parts: list[bytes] = [bytes([b]) for b in word]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i in range(n - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            if not parts[i] or (j := after[i]) >= n or self.ranks.get(parts[i] + parts[j]) != r:
                continue  # what stood here has merged since
            parts[i], parts[j], after[i] = parts[i] + parts[j], b"", after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := self.ranks.get(parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(queue, (r, k))
        return [self.ranks[p] for p in parts if p]

    def encode(self, some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one word after the other, and the number of ids of each word."""
        whole = np.array([self.ranks.get(w, -1) for w in some], dtype=np.int64)
        rest = np.flatnonzero(whole < 0)
        count = np.ones(len(some), np.int64)
        ids, odd = self._replay([some[i] for i in rest], own := np.zeros(len(rest), np.int64))
        count[rest] = own
        out = np.zeros(int(count.sum()), np.int64)
        first = np.cumsum(count) - count
        out[first[whole >= 0]] = whole[whole >= 0]
        out[spread(first[rest], own)] = ids
        if odd:
            parts = {int(rest[i]): self.one(some[rest[i]]) for i in odd}
            lists = [parts[i] if i in parts else out[a : a + c] for i, (a, c) in enumerate(zip(first, count, strict=True))]
            count = np.array([len(x) for x in lists], np.int64)
            out = np.concatenate([np.asarray(x, np.int64) for x in lists])
        return out, count

    def _replay(self, some: list[bytes], count: np.ndarray) -> tuple[np.ndarray, list[int]]:
        lens = np.array([len(w) for w in some], dtype=np.int64)
        symbol = self.single[np.frombuffer(b"".join(some), np.uint8)]
        n = len(symbol)
        if not n:
            return symbol, []
        word = np.repeat(np.arange(len(some)), lens)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(lens)
        after[ends - 1], before[ends - lens] = -1, -1
        odd: set[int] = set()
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(at: np.ndarray) -> np.ndarray:
            """Put the pairs that begin at these positions into the index."""
            rank = self._rank(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if len(at):
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
                edges = np.flatnonzero(np.diff(rank)) + 1
                for r, part in zip(rank[np.concatenate([[0], edges])].tolist(), np.split(at, edges), strict=True):
                    if r not in index:
                        index[r] = []
                        heapq.heappush(queue, r)
                    index[r].append(part)
            return rank

        add(np.flatnonzero(after >= 0))
        while queue:
            r = heapq.heappop(queue)
            at = np.concatenate(found) if len(found := index.pop(r)) > 1 else found[0]
            at = at[(symbol[at] >= 0) & (after[at] >= 0)]
            at = at[self._rank(symbol[at], symbol[after[at]]) == r]
            if len(at) > 1:
                at = np.unique(at)
                meets = after[at[:-1]] == at[1:]
                if meets.any():  # a a a: pairs that share a symbol; from the left, every second of a run goes
                    run = np.arange(len(at)) - np.maximum.accumulate(np.where(np.concatenate([[True], ~meets]), np.arange(len(at)), 0))
                    at = at[run % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            nxt = after[gone]
            has = nxt >= 0
            # what a merge makes with its right neighbour before that merges in turn
            early = self._rank(np.full(int(has.sum()), r), symbol[nxt[has]])
            odd.update(word[at[has][(early >= 0) & (early < r)]].tolist())
            symbol[at], symbol[gone] = r, -1
            after[at] = nxt
            before[nxt[has]] = at[has]
            left = before[at]
            new = np.unique(np.concatenate([at[has], left[left >= 0]]))
            lower = add(new)
            if len(lower) and lower.min() < r:
                rank = self._rank(symbol[new], symbol[after[new]])
                odd.update(word[new[(rank >= 0) & (rank < r)]].tolist())
        alive = symbol >= 0
        count[:] = np.bincount(word[alive], minlength=len(some))
        return symbol[alive], sorted(odd)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.flat[spread(self.start[ids], self.length[ids])].tobytes()


@lru_cache(maxsize=2)
def _replay(raw: bytes) -> MergeReplay:
    """A Python worker's tables, kept from group to group."""
    return MergeReplay(read_ranks(raw))


_MAIL = "dest string, source string, n long, body binary, ids array<long>"


def _mail(rows: list[tuple]) -> pa.Table:
    dest, source, n, body, ids = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.table([pa.array(dest, pa.string()), pa.array(source, pa.string()), pa.array(n, pa.int64()), pa.array(body, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=["dest", "source", "n", "body", "ids"])


def _pack(n: int, pattern: str):
    """Per block of documents: to itself every document's words by number, and to each bucket (word-k) the block's words."""

    def run(batches):
        import regex

        split, part = regex.compile(pattern), TaskContext.get().partitionId()
        for k, t in enumerate(blocks(batches, BLOCK)):
            block, vocabulary, which = f"{part}-{k}", {}, []
            for text in t.column("text").to_pylist():
                which.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in split.findall(text)], dtype=np.int64))
            raw = [w.encode() for w in vocabulary]
            at = np.array([zlib.crc32(w) for w in raw], dtype=np.uint32) % n
            order = np.argsort(at, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            ends = np.searchsorted(at[order], np.arange(n + 1)).tolist()
            body = np.concatenate([np.array([len(x) for x in which], np.int64), place[np.concatenate(which)]])
            rows = [(block, "", len(raw), zipped(body), t.column("doc_id").to_pylist())]
            for b in range(n):
                if ends[b] < ends[b + 1]:
                    some = [raw[i] for i in order[ends[b] : ends[b + 1]]]
                    sizes = np.array([len(w) for w in some], "<u4").tobytes()
                    rows.append((f"word-{b}", block, len(some), zstandard.compress(sizes + b"".join(some), 1), []))
            yield from _mail(rows).to_batches()

    return run


def _encode(ranks):
    """A bucket's words, each encoded once, back to the blocks that have them."""

    def run(t: pa.Table) -> pa.Table:
        if not t.column("dest")[0].as_py().startswith("word-"):
            return _mail([])
        number: dict[bytes, int] = {}
        rows = []
        for r in t.to_pylist():
            raw = zstandard.decompress(r["body"])
            ends = (np.cumsum(np.frombuffer(raw, "<u4", r["n"]), dtype=np.int64) + 4 * r["n"]).tolist()
            words = [raw[a:b] for a, b in zip([4 * r["n"], *ends], ends, strict=False)]
            rows.append((r, np.array([number.setdefault(w, len(number)) for w in words], np.int64)))
        ids, count = _replay(ranks.value).encode(list(number))
        first, bucket = np.cumsum(count) - count, t.column("dest")[0].as_py()
        return _mail([(r["source"], bucket, len(x), zipped(np.concatenate([count[x], ids[spread(first[x], count[x])]])), []) for r, x in rows])

    return run


def _gather(ranks, back: bool):
    """A block's documents with the ids of their words one after the other, and the bytes that these stand for."""

    def run(t: pa.Table, mail: pa.Table) -> pa.Table:
        docs = [] if not t.num_rows or t.column("dest")[0].as_py().startswith("word-") else t.to_pylist()
        ids, coded, decoded = [], [], []
        for block in docs:
            counts, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r in sorted(mail.to_pylist(), key=lambda r: int(r["source"].removeprefix("word-"))):
                x = numbers(r["body"])
                counts.append(x[: r["n"]]), flat.append(x[r["n"] :])
            count, flat = np.concatenate(counts), np.concatenate(flat)
            first, body, n = np.cumsum(count) - count, numbers(block["body"]), len(block["ids"])
            ends = np.cumsum(body[:n]) + n
            for a, b in zip((ends - body[:n]).tolist(), ends.tolist(), strict=True):
                own = flat[spread(first[body[a:b]], count[body[a:b]])]
                coded.append(own.astype("<u4").tobytes())
                if back:
                    decoded.append(_replay(ranks.value).decode(own))
            ids += block["ids"]
        columns = {"doc_id": pa.array(ids, pa.int64()), "ids": pa.array(coded, pa.binary())} | ({"decoded": pa.array(decoded, pa.binary())} if back else {})
        return pa.table(columns)

    return run


def _decode(ranks):
    def run(batches):
        replay = _replay(ranks.value)
        for b in batches:
            found = [np.frombuffer(x, "<u4").astype(np.int64) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([replay.decode(x) for x in found], pa.binary())], names=[*b.schema.names, "decoded"])

    return run


def _shared(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, pattern: str, back: bool = False) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of every row, by a .tiktoken file and its split pattern.

    back: also decoded, the bytes that the ids stand for, in the same Python workers.
    """
    ranks = _shared(docs, vocabulary)
    # both groupings read one exchange of the packed blocks, in which nothing is filtered
    packed = texts(docs).mapInArrow(_pack(buckets(docs), pattern), _MAIL)
    found = packed.groupBy("dest").applyInArrow(_encode(ranks), _MAIL).toDF("at", "source", "n", "body", "ids")
    return packed.groupBy("dest").cogroup(found.groupBy("at")).applyInArrow(_gather(ranks, back), "doc_id long, ids binary" + ", decoded binary" * back)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded (with a binary column ids) with the column decoded, the bytes that the ids stand for."""
    schema = ", ".join(f"`{c}` {kind}" for c, kind in encoded.dtypes)
    return encoded.mapInArrow(_decode(_shared(encoded, vocabulary)), f"{schema}, decoded binary")


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, back=True)
    size = (F.length("ids") / 4).cast("long")
    return both.select("doc_id", size.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
