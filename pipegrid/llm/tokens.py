"""Token counts: pieces are counted once per distinct pre-token and joined to per-document frequencies.

The pre-tokens are the words between white space, which is right for tokenizers that drop white space (such as
``word_bpe_49k.json``). A first pass packs every block of documents into per-document frequencies of numbered words and,
by hash bucket, the block's distinct words. Each bucket then counts the pieces of each of its words once; the counts go
back to the blocks by block number, where frequencies times counts are summed. No ids are kept.

Null text counts as empty (0 tokens). A null doc_id is a row like any other, repeated rows stay repeated, an empty table
gives an empty table, and columns besides doc_id and text are ignored. Texts are never cut; a very long word is one word.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipegrid.llm.common import blocks, buckets, cut, spread, texts

#: Bytes of text that share one list of numbered words.
BLOCK = 8 << 20

_BLANK = re.compile(r"[ \t\n\r\v\f]+")
_ODD = re.compile("[\x1c-\x1f]")


def words(text: str) -> list[str]:
    """The words between white space. Separators that str.split() knows and the tokenizer doesn't stay inside words."""
    return [w for w in _BLANK.split(text) if w] if _ODD.search(text) else text.split()


class WordEncoder:
    """Ids of words by the tokenizers library, many words in one call."""

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t for t in json.loads(vocabulary)["added_tokens"]]
        plain = [t for t in special if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.between = plain[0] if plain else None
        self.special = re.compile("|".join(re.escape(t["content"]) for t in special)) if special else None

    def one(self, word: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, new: list[str]) -> list[np.ndarray]:
        """The ids of each word. A special token that no word contains stands between words and marks where each ends."""
        if self.between is None:
            return [self.one(w) for w in new]
        out, mark = [None] * len(new), self.between["content"]
        plain = [i for i, w in enumerate(new) if not self.special.search(w)]
        for i in set(range(len(new))).difference(plain):
            out[i] = self.one(new[i])
        for k in range(0, len(plain), 4000):
            some = plain[k : k + 4000]
            ids = np.array(self.tokenizer.encode(mark.join([new[i] for i in some]), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.between["id"])
            for i, a, b in zip(some, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True):
                out[i] = ids[a:b]
        return out


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes) -> WordEncoder:
    """A Python worker's encoder, kept from group to group."""
    return WordEncoder(vocabulary)


def zipped(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of their first, second, third and fourth bytes."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def numbers(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _pack(n: int, ordered: bool):
    """Per block of documents: a row with every document's words by number, and a row with the words of each bucket.

    ordered: the words of a document in their order; otherwise its distinct words and their frequencies.
    """

    def run(batches):
        for t in blocks(batches, BLOCK):
            block = uuid.uuid4().hex
            size = pc.binary_length(t.column("text")).to_pylist()
            vocabulary, which, many, per = _Numbers(), [], [], []
            for text in t.column("text").to_pylist():
                found = words(text)
                if not ordered:
                    found = Counter(found)
                    many.append(np.fromiter(found.values(), np.int64, len(found)))
                per.append(len(found))
                which.append(np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)))
            which, many = np.concatenate(which), np.concatenate(many or [np.zeros(0, np.int64)])
            raw = [w.encode() for w in vocabulary]
            at = np.array([zlib.crc32(w) for w in raw], dtype=np.uint32) % n
            order = np.argsort(at, kind="stable")
            place = np.empty(len(order), dtype=np.uint32)
            place[order] = np.arange(len(order))
            ends = np.searchsorted(at[order], np.arange(n + 1)).tolist()
            place, per = place[which].astype(np.int64), np.array(per, np.int64)
            if not ordered:  # by number within a document, as steps: small numbers take less room
                whole = np.repeat(np.arange(len(per)), per) * len(raw) + place
                by = np.argsort(whole)
                place, many = np.diff(whole[by], prepend=0) % max(1, len(raw)), many[by]
            body = [per, place, many]
            yield _row(block, -1, len(raw), zipped(np.concatenate(body)), t.column("doc_id").to_pylist(), size)
            for b in range(n):
                if ends[b] < ends[b + 1]:
                    some = [raw[i] for i in order[ends[b] : ends[b + 1]]]
                    yield _row(block, b, ends[b], zstandard.compress(b" ".join(some), 1), [], [])

    return run


def _row(block, bucket, start, body, ids, size):
    return pa.RecordBatch.from_arrays(
        [pa.array([block]), pa.array([bucket], pa.int32()), pa.array([start], pa.int64()), pa.array([body], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([size], pa.list_(pa.int64()))],
        names=["block", "bucket", "start", "body", "ids", "size"],
    )


_PACKED = "block string, bucket int, start long, body binary, ids array<long>, size array<long>"


def _count(vocabulary, ids: bool):
    """Pieces of every distinct word of a bucket, once, and back to each block that has the word."""

    def run(t: pa.Table) -> pa.Table:
        encoder = _encoder(vocabulary.value)
        lists = [zstandard.decompress(x).decode().split(" ") for x in t.column("body").to_pylist()]
        number: dict[str, int] = {}
        which = [np.array([number.setdefault(w, len(number)) for w in some], np.int64) for some in lists]
        found = encoder.encode(list(number))
        count = np.array([len(x) for x in found], np.int64)
        flat, first = np.concatenate(found).astype(np.int64), np.cumsum(count) - count
        body = [zipped(np.concatenate([count[x], flat[spread(first[x], count[x])]] if ids else [count[x]])) for x in which]
        empty = pa.array([[]] * len(body), pa.list_(pa.int64()))
        return pa.table([t.column("block"), t.column("bucket"), pa.array([len(x) for x in which], pa.int64()), pa.array(body, pa.binary()), empty, empty], names=["block", "bucket", "start", "body", "ids", "size"])

    return run


def joined(t: pa.Table) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's documents, words per document, the rest of its body, and the counts and ids by word number."""
    rows = sorted(t.to_pylist(), key=lambda r: r["bucket"])
    docs, counts, ids = rows[0], [], []
    for r in rows[1:]:
        x = numbers(r["body"])
        counts.append(x[: r["start"]])
        ids.append(x[r["start"] :])
    body, n = numbers(docs["body"]), len(docs["ids"])
    none = [np.zeros(0, np.int64)]
    return docs, body[:n], body[n:], np.concatenate(counts or none), np.concatenate(ids or none)


def _sum(t: pa.Table) -> pa.Table:
    """A block's frequencies times its words' counts, summed per document."""
    docs, per, rest, counts, _ = joined(t)
    which, many = rest[: len(rest) // 2], rest[len(rest) // 2 :]
    which = np.cumsum(which) % max(1, docs["start"])
    total = np.zeros(len(which) + 1, np.int64)
    np.cumsum(counts[which] * many, out=total[1:])
    ends = np.cumsum(per)
    return pa.table([pa.array(docs["ids"], pa.int64()), pa.array(docs["size"], pa.int64()), pa.array(total[ends] - total[ends - per], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def by_block(docs: DataFrame, vocabulary: str, ordered: bool):
    """Blocks of documents with the counts (ordered: and ids) of their words, grouped by block; see joined."""
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = cut(texts(docs).mapInArrow(_pack(buckets(docs), ordered), _PACKED))
    counted = rows.where("bucket >= 0").groupBy("bucket").applyInArrow(_count(shared, ordered), _PACKED)
    return rows.where("bucket < 0").unionByName(counted).groupBy("block")


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row of docs, by the tokenizer file at vocabulary."""
    return by_block(docs, vocabulary, False).applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")


def op7_token_counts(spark, sf_dir: str, most: int = 2048) -> DataFrame:
    import public_tokenizers

    from pipegrid.llm.common import table

    found = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > most)
