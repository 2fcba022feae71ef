"""The lexicon where one text's copies are many, and fingerprints where the band is empty."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from pipegrid.llm import imatch
from tests.llm.conftest import SCHEMA, passage, rows


def test_many_near_copies_keep_their_terms(spark):
    base = passage(1, 300)
    texts = [(n, f"{base} own{n}") for n in range(50)] + [(100 + n, f"{passage(1000 + n, 60)} {' '.join(base.split()[3 * n % 290 :][:10])}") for n in range(100)]
    own = spark.createDataFrame(rows(texts), SCHEMA)
    words = {r["h"] for r in imatch.lexicon(own, 0.0005, 0.2, 2).collect()}
    (known,) = own.where("doc_id = 0").select(imatch.term_hashes(F.col("text")).alias("h")).first()
    assert len(words.intersection(known)) > 100
    got = imatch.fingerprints(own).where("doc_id < 50")
    told = got.select("fp", imatch.likeness(F.col("fp"), F.col("edited_fp")).alias("x")).collect()
    assert min(r["x"] for r in told) > 0  # half of a text is replaced
    assert all(sum(a == b for a, b in zip(told[0]["fp"], r["fp"], strict=True)) > 14 for r in told)


def test_every_text_of_a_sketch_counts(spark):
    """Terms that only some of the near copies have are counted, whichever of the copies it is."""
    base = [passage(7 + n, 40) for n in range(2)]
    low = [sorted((hash64([w.encode()]), w) for w in set(b.split()))[3][0] for b in base]
    extra = [w for w in (f"extra{n}" for n in range(400)) if hash64([w.encode()]) > max(low)][:8]
    texts = [(8 * n + m, f"{b} {w}") for n, b in enumerate(base) for m, w in enumerate(extra)] + [(100 + n, passage(100 + n, 9)) for n in range(30)]
    kept = {r["h"] for r in imatch.lexicon(spark.createDataFrame(rows(texts), SCHEMA), 0.0005, 0.2, 2).collect()}
    assert {hash64([w.encode()]) for w in extra} <= kept


def test_few_documents_are_told_by_their_terms(spark):
    base = passage(2, 200)
    got = imatch.fingerprints(spark.createDataFrame(rows([(n, f"{base} own{n}") for n in range(4)]), SCHEMA)).collect()
    assert len({tuple(r["fp"]) for r in got}) > 1
    assert all(len(r["fp"]) == 28 and sum(a == b for a, b in zip(got[0]["fp"], r["fp"], strict=True)) > 14 for r in got)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash64(values, seed=42):
    """What Spark's xxhash64 gives for strings, longs (8 bytes) and ints (4 bytes), one after the other."""
    for raw in values:
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return signed(seed)


def long(x):
    return x.to_bytes(8, "little", signed=True)


def listed(text):
    return list(dict.fromkeys(hash64([w.encode()]) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower())))


def terms(text):
    return set(listed(text))


def fingerprint(text, lexicon):
    own = terms(text) & lexicon or terms(text)
    x = sorted(hash64([long(h), (1).to_bytes(4, "little")]) for h in own)
    eighth = [[v for v in x if v >> 61 & 7 == k] for k in range(8)]
    small = [[v for v in e if v >> 59 & 3 == 0] for e in eighth]
    found = [eighth[k] + eighth[k + 1] for k in range(0, 8, 2)] + small + [[v for v in s if v >> 56 & 7 == k] for s in small for k in (0, 1)]
    return [hash64(map(long, s)) if s else None for s in found]


def shown(fp):
    return ",".join("-" if x is None else f"{x % (1 << 64):X}".lower() for x in fp)


def likeness(a, b):
    told = [x == y for x, y in zip(a, b, strict=True) if x is not None or y is not None]
    return sum(told) / len(told) if told else float(a == b)


@pytest.mark.parametrize("most", [250_000, 0])
def test_digests_against_brute_force(spark, texts, most):
    """All of op3's columns, with many rows without a doc_id, repeated rows, ids with several texts; with either way to look terms up."""
    own = [*texts, *((None, passage(70 + n % 9, 30)) for n in range(30)), *((40 + n, passage(40 + n // 2, 50) + f" t{n}") for n in range(30)), (40, "other text"), (41, None)]
    low, high, least = 0.0005, 0.2, 2
    alike = {}
    for _, t in own:
        hashes = listed(t or "")
        alike.setdefault(tuple(sorted(hashes)[:4]), []).append(hashes)
    df = Counter()
    for some in alike.values():
        df.update(min(some))
    lexicon = {h for h, n in df.items() if max(least, low * len(alike)) <= n <= high * len(alike)}
    order = sorted(((i if i is not None else -(1 << 63), hash64([(t or "").encode()]), t or "") for i, t in own), key=lambda x: (-x[0], x[1]))
    want = Counter()
    for (i, _, t), (_, _, u) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        a, b, c = fingerprint(t, lexicon), fingerprint(edited, lexicon), fingerprint(u, lexicon)
        want[i if i > -(1 << 63) else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(b), likeness(a, b), likeness(a, c)] += 1
    got = imatch.digests(spark.createDataFrame(rows(own), SCHEMA), low, high, least, most).collect()
    assert Counter(tuple(r) for r in got) == want
