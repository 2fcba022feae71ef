"""Token counts, packing and byte-pair encoding against the libraries."""

from __future__ import annotations

import base64
import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pipegrid.llm import bytepair, packing, tokens

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def ranks():
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}


def test_counts(docs, none, texts, library):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokens.count_tokens(docs, WORDS).collect())
    assert got == Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in texts)
    assert tokens.count_tokens(none, WORDS).collect() == []


def test_pieces_and_places(docs, none, texts, library):
    got = packing.pack(packing.token_pieces(docs, WORDS, 64), 64).collect()
    by = Counter()
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        by.update((i, p, a, ids[a : a + 64].tobytes()) for p, a in enumerate(range(0, len(ids), 64)))
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in got) == by
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64
    assert packing.pack(packing.token_pieces(none, WORDS)).collect() == []


def _one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [x for x in rooms if x >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    histogram = dict(Counter(lengths))
    slots, filled = packing.plan(histogram, 40), {}
    for n, many in histogram.items():
        rows = slots[n]
        for rank in range(many):
            first, sequence, each, offset = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1]
            k = rank - first
            filled.setdefault(sequence + k // each, []).append((offset + k % each * n, n))
    for own in filled.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 40
    assert len(filled) == _one_by_one(lengths, 40)


def test_pack_rejects_long(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(9,)], "length long"), 8)


def test_byte_pairs(docs, none, texts, ranks):
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in bytepair.decode(bytepair.encode(docs, RANKS, P.PATTERN), RANKS).collect())
    assert got == Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in texts)
    assert bytepair.encode(none, RANKS, P.PATTERN, back=True).collect() == []


def test_replay_with_disordered_ranks():
    r = random.Random(4)
    for _ in range(200):
        tokens_ = {bytes([b]) for b in range(256)} | {bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(25)}
        order = sorted(tokens_)
        r.shuffle(order)
        ranks = {t: k for k, t in enumerate(order)}
        words = [bytes(r.choice(b"abc") for _ in range(r.randint(1, 12))) for _ in range(40)]
        library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        ids, count = bytepair.MergeReplay(ranks).encode(words)
        assert ids.tolist() == [x for w in words for x in library.encode_ordinary(w.decode())]
        assert count.sum() == len(ids)


def test_long_words_alone():
    """A word of 200,000 bytes by itself, in little time, with the ids of the replay."""
    with open(RANKS, "rb") as f:
        replay = bytepair.MergeReplay(bytepair.read_ranks(f.read()))
    word = b"abcdefghij the" * 15_000
    began = time.perf_counter()
    alone = replay.one(word)
    assert time.perf_counter() - began < 20 and b"".join(replay.tokens[x] for x in alone) == word
    ids, count = replay.encode([word, word[:3000]])
    assert alone == ids[: count[0]].tolist() and replay.one(word[:3000]) == ids[count[0] :].tolist()


def test_queries_of_tokens(spark, tmp_path, docs, texts):
    """op4, op7 and op10 as registered, against the libraries."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    library, coder = Tokenizer.from_file(P.path("word_bpe_49k.json")), tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bytepair.read_ranks(open(RANKS, "rb").read()), special_tokens={})
    ids = [(i, (t or "").encode(), library.encode(t or "", add_special_tokens=False).ids) for i, t in texts]
    assert Counter(tuple(r) for r in tokens.op7_token_counts(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == Counter((i, len(raw), len(x), len(x) > 2048) for i, raw, x in ids)
    coded = [(i, raw, np.array(coder.encode_ordinary(raw.decode()), "<u4")) for i, raw, _ in ids]
    want = Counter((i, len(x), hashlib.sha256(x.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()) for i, raw, x in coded)
    assert Counter(tuple(r) for r in bytepair.op10_byte_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want
    got = packing.op4_packing(spark, str(tmp_path)).collect()
    want = Counter()
    for i, _, x in ids:
        x = np.array([*x, 0], "<u4")
        want.update((i, k, a, len(x[a : a + 2048]), zlib.crc32(x[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(x), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    for (s, a, n), (s2, a2, _) in zip(places, [*places[1:], (None, 0, 0)], strict=True):
        assert a2 == (a + n if s2 == s else 0) and a + n <= 2048
    sizes = sorted(n for *_, n in places)
    assert len({s for s, _, _ in places}) <= -(-sum(sizes) // 2048) + 1
