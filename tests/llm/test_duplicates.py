"""Near-duplicates, repeated passages and their parts against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pipegrid.llm import bwt, exactdup, graph, neardup
from tests.llm.conftest import SCHEMA, passage, rows

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def linked(texts):
    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and texts[a][0] is not None and texts[b][0] is not None and 100 * both >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for n, (i, _) in enumerate(texts):
        low[find(n)] = min(low.get(find(n), i), i) if i is not None else None
    return Counter((i, len(sets[n]), low[find(n)], i == low[find(n)]) for n, (i, _) in enumerate(texts))


def test_near_duplicates(docs, none, texts):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == linked(texts)
    assert neardup.near_duplicates(none).collect() == []


def test_chains_of_near_duplicates(spark):
    r, base = random.Random(3), passage(5, 120).split()
    texts = []
    for i in range(60):
        if i % 3 == 0:  # edits heap up, so that some lie beyond the threshold from the first but not from each other
            base[r.randrange(len(base))] = f"w{i}"
        own = list(base)
        for _ in range(i % 5):
            own[r.randrange(len(own))] = f"v{i}{r.random()}"
        texts.append((100 - i, " ".join(own)))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows(texts), SCHEMA)).collect())
    assert got == linked(texts)


def test_sketches_tell_similarity():
    r = np.random.default_rng(1)
    for n in (1, 3, 50, 2000):
        both, rest = r.integers(1 << 60, size=3 * n).astype(np.uint64), r.integers(1 << 60, size=n).astype(np.uint64)
        s = neardup.sketches([np.unique(both), np.unique(np.concatenate([both, rest]))])
        assert s.shape == (2, neardup.BINS) and abs((s[0] == s[1]).mean() - 0.75) < 0.25
        assert (neardup.sketches([np.unique(both)])[0] == s[0]).all()


def grouped(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            root[find(a)] = find(b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("share", [100_000, 150])
def test_components(spark, share):
    """Chains up, down and shuffled, stars round the largest and the smallest node, circles, loops and nulls."""
    r = random.Random(4)
    mixed = r.sample(range(10_000, 12_000), 800)
    links = [(1, 2), (2, 3), (7, 7), (9, 8), (4, 5), (5, 6), (6, 4), (None, 1), (2, None), *((n, n + 1) for n in range(20, 1020)), *((5000 - n, 5001 - n) for n in range(1000))]
    links += [*zip(mixed, mixed[1:], strict=False), *((9000, n) for n in range(6000, 6300)), *((13_000, n) for n in range(13_001, 13_300)), (1, 2), (2, 1)]
    links += [(r.randrange(20_000, 20_500), r.randrange(20_000, 20_500)) for _ in range(300)]
    want = grouped(links)
    got = {x["node"]: x["label"] for x in graph.components(spark.createDataFrame(links, "a long, b long"), share).collect()}
    assert set(got) == set(want)
    pairs = {(want[n], got[n]) for n in got}
    assert len(pairs) == len(set(want.values())) == len(set(got.values()))
    assert graph.components(spark.createDataFrame([], "a long, b long"), share).collect() == []


def removed(texts):
    order, seen, out = sorted(range(len(texts)), key=lambda n: (texts[n][0] is None, texts[n][0] or 0)), {}, Counter()
    for n in order:
        i, raw = texts[n][0], (texts[n][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            first = seen.setdefault(raw[p : p + 50], i)
            if first != i:
                gone[p : p + 50] = b"\1" * 50
        spans = tuple(m.span() for m in re.finditer(b"\1+", bytes(gone)))
        out[i, len(raw), spans, bytes(x for x, g in zip(raw, gone, strict=True) if not g)] += 1
    return out


def test_repeats(docs, none, texts):
    got = Counter((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in exactdup.remove_repeats(docs).collect())
    assert got == removed(texts)
    assert exactdup.remove_repeats(none).collect() == []


def test_repeats_in_a_few_letters(spark):
    r = random.Random(8)
    base = ["".join(r.choice("ab") for _ in range(r.randint(40, 90))) for _ in range(6)]
    texts = [(i, "".join(r.choice([*base, "ab" * 30, "a" * 70, "é" * 31, f"#{i}"]) for _ in range(r.randint(1, 6)))) for i in range(40)]
    got = Counter((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in exactdup.remove_repeats(spark.createDataFrame(rows(texts), SCHEMA)).collect())
    assert got == removed(texts)


def test_many_rows_without_an_id(spark):
    """Null and repeated ids are dealt to many blocks; a column named part goes through."""
    texts = [(None, passage(n % 40, 40)) for n in range(120)] + [(7, passage(n % 60, 30)) for n in range(90)] + [(n, passage(n, 50)) for n in range(20, 60)]
    own = spark.createDataFrame(rows(texts), SCHEMA)
    got = Counter((r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["spans"]), bytes(r["kept"])) for r in exactdup.remove_repeats(own).collect())
    assert got == removed(texts)
    cut = exactdup.without_repeats(own)
    assert cut.columns == own.columns and Counter((r["doc_id"], r["text"]) for r in cut.collect()) == Counter([(i, raw.decode(errors="ignore")) for (i, _, _, raw), n in removed(texts).items() for _ in range(n)])
    assert {r["part"] for r in cut.collect()} == {"p"}


def test_a_common_string_with_many_contexts():
    """An anchor that has more contexts than are merged at once is split into windows, with the same result."""
    r = np.random.default_rng(5)
    texts_, count, rel, doc, name = [], [], [], [], []
    for g, size in enumerate((400, 30, 30, 120)):
        gram = r.integers(97, 100, 25)
        for _ in range(size):
            left, right = 25 - r.integers(0, 8), 25 - r.integers(0, 8)
            own = np.concatenate([r.integers(97, 99, left), gram, r.integers(97, 99, right)]).astype(np.uint8)
            texts_.append(np.pad(own, (0, 75 - len(own)))), count.append(len(own) - 49), rel.append(left), doc.append(int(r.integers(0, 60))), name.append(g)
    given = [np.array(x) for x in (texts_, count, rel, doc, name)]
    low = {}
    for t, n, p, d, g in zip(*given, strict=True):
        for o in range(n):
            key = (g, p - o, t[o : o + 50].tobytes())
            low[key] = min(low.get(key, 99), d)
    want = [low[g, p - o, t[o : o + 50].tobytes()] for t, n, p, _, g in zip(*given, strict=True) for o in range(n)]
    for most in (10_000, 100, 25):
        assert exactdup.solve_parts(*given, most).tolist() == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.text("abc", min_size=1, max_size=12), min_size=1, max_size=5), min_size=1, max_size=4), st.integers(1, 9))
def test_merged_order_and_blocks(shards, depth):
    symbols = [np.frombuffer("".join(s).encode(), np.uint8) for s in shards]
    lens = [np.array([len(x) for x in s]) for s in shards]
    z, suffix, block = bwt.repeated(symbols, lens, depth)
    ends = ["\0".join(s) + "\0" for s in shards]
    prefix = [ends[s][k:].split("\0")[0][:depth] for s, k in zip(z.tolist(), suffix.tolist(), strict=True)]
    shown = [p if len(p) == depth else p + "\0" for p in prefix]
    assert shown == sorted(shown)
    full = [n for n, p in enumerate(prefix) if len(p) == depth]
    for a, b in zip(full, full[1:], strict=False):
        assert (prefix[a] == prefix[b]) == (block[a] == block[b])
