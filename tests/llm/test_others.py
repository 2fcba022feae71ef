"""Chat formatting, fingerprints, top-k, toxicity and personal data against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pipegrid.llm import chat, imatch, pii, topk, toxic
from pipegrid.llm.common import utf8
from tests.llm.conftest import SCHEMA, passage, rows


def test_chat_round_trip(spark):
    odd = ["a", None, "", "<|im_end|>\n<|im_start|>assistant\nx", "\\", "\\<|", "<", "|im_end|>", "\\n\n\\\\|", "é\U0001F600"]
    rows_ = [(c, t, r, odd[(c + t) % len(odd)], "x") for c in range(3) for t, r in enumerate(["user", "assistant", None, "a\nb\\n", "assistant"])]
    rows_ += [(None, 0, "user", "u", "x"), (7, 1, "user", "same", "x"), (7, 1, "user", "same", "x")]
    done = chat.format_trees(chat.chain(spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string, tree string")))
    got = {r["tree"]: r for r in done.withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert len(got) == 5
    for c, r in got.items():
        want = [(role or "", text or "") for i, _, role, text, _ in rows_ if ("" if i is None else str(i)) == c]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        loss = [re.sub(r"(?s)\\(.)", r"\1", r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
        assert loss == [text for role, text in want if role == "assistant"]
    assert chat.format_trees(chat.chain(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def test_chat_branches(spark):
    # 1 - 2 - 4 and 1 - 3 - 5 - 6; 10 is a root of its own, 20 and 21 reply to each other
    tree = [(1, None, 0.0), (2, 1, 9.0), (4, 2, 0.0), (3, 1, 1.0), (5, 3, 1.0), (6, 5, None), (10, 99, 1.0), (20, 21, 1.0), (21, 20, 1.0)]
    df = spark.createDataFrame([("t", n, p, "user", str(n), s) for n, p, s in tree], "tree string, node long, parent long, role string, text string, score double")
    every = {(r["root"], r["leaf"]): (r["rank"], re.findall(r"user\n(\d+)", r["formatted"])) for r in chat.format_trees(df, None).collect()}
    assert every == {(1, 4): (1, ["1", "2", "4"]), (1, 6): (2, ["1", "3", "5", "6"]), (10, 10): (1, ["10"])}
    assert {r["leaf"] for r in chat.format_trees(df, 1).collect()} == {4, 10}


def test_fingerprints(spark, docs, none, texts):
    got = imatch.fingerprints(docs).collect()
    assert len(got) == len(texts)
    by = {}
    for r in got:
        assert by.setdefault(r["text"], r["fp"]) == r["fp"]
    assert imatch.fingerprints(none).collect() == []
    (one,) = imatch.fingerprints(docs.where("doc_id = 2")).collect()
    assert one["edited"] == one["text"][: one["n_chars"] - one["n_chars"] // 2] + one["text"][: one["n_chars"] // 2]
    assert imatch.digests(none).collect() == [] and [(r["near_next"], r["doc_id"]) for r in imatch.digests(docs.where("doc_id = 15")).collect()] == [(1.0, 15)] * 2
    near = spark.createDataFrame([([1, None, 3], [1, None, 4], [None, None, None])], "a array<long>, b array<long>, c array<long>")
    assert near.select(imatch.likeness(F.col("a"), F.col("b")), imatch.likeness(F.col("a"), F.col("a")), imatch.likeness(F.col("a"), F.col("c")), imatch.likeness(F.col("c"), F.col("c"))).first()[:] == (0.5, 1.0, 0.0, 1.0)


def test_lexicon_is_the_band(spark):
    texts = [(n, " ".join([f"w{n}", f"half{n % 2}", "all", "All", f"pair{n // 2}"])) for n in range(20)]
    got = {r["h"] for r in imatch.lexicon(spark.createDataFrame(rows(texts), SCHEMA), 0.05, 0.5, 2).collect()}
    named = {r["h"] for r in spark.createDataFrame([(f"pair{n}",) for n in range(10)] + [("half0",), ("half1",)], "w string").select(F.xxhash64("w").alias("h")).collect()}
    assert got == named


def test_top_k(spark):
    r = random.Random(2)
    vectors = [(i, [r.uniform(-1, 1) if d % 3 else r.choice([0.0, 0.5]) for d in range(8)]) for i in range(700)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(40)] + [(50, vectors[50][1]), (None, [1.0] * 8), (2001, None), (2002, [1.0, None]), (2003, [float("nan")] * 8), (2004, [float("inf")] * 8), (2005, [0.5])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], "vec_id long, embedding array<double>, block int, v string")
    got = topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0, 5, query_block=7, shard_rows=100)
    good = [(i, [math.floor(256 * x) for x in v] + [0] * (8 - len(v))) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in {i: v for i, v in good if i % 50 == 0}.items():
        ranked = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q))[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()} == want
    assert topk.top_k(topk.quantised(df.limit(0)), F.col("vec_id") % 50 == 0).collect() == []
    assert topk.top_k(topk.quantised(df.where("vec_id in (100, 3)")), F.col("vec_id") % 50 == 0).count() == 1


def test_top_k_of_large_components(spark):
    """Sums beyond 2^53 are exact, and rows that share a vec_id are queries of their own."""
    r = random.Random(5)
    vectors = [(i, [r.choice([-1, 1]) * float(r.getrandbits(30)) / 256 for _ in range(4)]) for i in range(60)] + [(61, [3.0e7, 1.0]), (62, [3.0e7, 2.0]), (50, [0.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = Counter((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(topk.quantised(df), F.col("vec_id") % 50 == 0).collect())
    good = [(i, [math.floor(256 * x) for x in v] + [0] * (4 - len(v))) for i, v in vectors]
    want = Counter()
    for q, v in good:
        if q % 50 == 0:
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q)[:5]))
    assert got == want and max(x[3] for x in got) > 1 << 53


def labelled(spark):
    texts = [(n, passage(n, 40) + (" " + random.Random(n).choice(["loser", "scum", "idiot"]) + " " + passage(n + 500, 10) if n % 4 == 0 else "")) for n in range(240)]
    return texts, spark.createDataFrame([(n, 0, int(n % 4 == 0), "x") for n, _ in texts if n < 200] + [(0, 0, None, "x"), (999, 0, 1, "x"), (None, 0, 1, "x")], "doc_id long, quality int, toxic int, text string")


def test_toxicity(spark, docs, none):
    texts, labels = labelled(spark)
    own = spark.createDataFrame(rows([*texts, (None, texts[4][1]), (4, texts[4][1]), (900, None), (901, "")]), SCHEMA)
    model = toxic.train(own, labels, least=8.0)
    assert not any(zlib.crc32(str(i).encode()) % 3 == 1 for i in model.index.ids.tolist())
    got = toxic.score_toxicity(own, model).collect()
    assert len(got) == len(texts) + 4 and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    held = [n for n in range(200, 240)]
    assert np.mean([(by[n] >= 0.7) == (n % 4 == 0) for n in held]) > 0.9
    assert by[900] == by[901] and by[None] == by[4]
    # exact cosines: every example against the index
    data = [t for _, t in texts[:60]]
    raw = [t.encode() for t in data]
    flat, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    row, term, many = toxic.counted(flat, offsets, model.index.vocabulary)
    weight = model.index.weigh(row, term, many, len(raw))
    q, x = np.zeros((len(raw), len(model.index.vocabulary))), np.zeros((len(model.index.ids), len(model.index.vocabulary)))
    q[row, term] = weight
    x[model.index.example_rows[0], model.index.example_rows[1]] = model.index.example_rows[2]
    all_ = q @ x.T
    i, example, score = model.index.nearest(row, term, weight, len(raw), 7)
    for n in range(len(raw)):
        assert np.allclose(np.sort(all_[n][all_[n] > 1e-12])[::-1][:7], score[i == n])
    empty = toxic.train(none, labels)
    assert [r["score"] for r in toxic.score_toxicity(docs, empty).collect()] == [0.0] * docs.count()
    assert toxic.score_toxicity(none, model).collect() == []


def test_toxicity_of_few_examples(spark):
    """Chi-square is at most the number of examples, so a few of them must do with what they have."""
    texts, labels = labelled(spark)
    own = spark.createDataFrame(rows(texts[:30]), SCHEMA)
    model = toxic.train(own, labels)
    assert 6 <= len(model.index.ids) < 25 and len(model.index.vocabulary) > 0
    assert len({r["score"] for r in toxic.score_toxicity(own, model).collect()}) > 1


def plain_base(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in re.sub("[^0-9]", "", m.group())]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(k, m.start(), m.end()) for k, m in out]


def test_base_spans():
    r = random.Random(6)
    parts = ["a", "b.c", "@", "@x", ".de", " ", "-", "1", "255", "256", ".", "4111 1111 1111 1111", "+", "+49 (30) ", "12345678", "٣", "é", "007", "\n", "token = \"0123456789abcdef0123456789abcdef\""]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert [(k, a, b) for k, a, b, ok in pii.base_candidates(text) if ok] == plain_base(text), text


def test_personal_data(spark, docs, none, texts):
    secret = [(200 + n, f'{passage(n, 5)} token = "{hashlib.sha1(str(n).encode()).hexdigest()}" {passage(n, 5)}') for n in range(30)]
    own = spark.createDataFrame(rows([*texts, *secret]), SCHEMA)
    got = pii.find_spans(own).collect()
    assert Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"])) for r in got) == Counter((i, tuple(plain_base(t or ""))) for i, t in [*texts, *secret])
    assert all(any(s["kind"] == "secret" for s in r["spans"]) for r in got if r["doc_id"] and r["doc_id"] >= 200)
    assert all(a["end"] <= b["start"] for r in got for a, b in [sorted(p, key=lambda s: s["start"]) for p in [(x, y) for x in r["spans"] for y in r["spans"] if x is not y and not (x["base"] and y["base"])]])
    masked = {r["doc_id"]: r["text"] for r in pii.mask(own).collect()}
    assert masked[22] == "<|endoftext|> mail <email> ip <ip> card <card> call <phone>" and "<secret>" in masked[200]
    assert pii.find_spans(none).collect() == [] and pii.observe(none) == {}


def test_secrets(spark):
    """Keys of a known form and named values are found without a cue before them; long words with digits are not."""
    r = random.Random(9)
    drawn = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    upper, hexed = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdef"
    made = [lambda: "AKIA7" + drawn(upper, 15), lambda: "password=" + drawn(hexed, 18), lambda: 'token = "' + drawn(hexed, 40) + '"', lambda: "section-1-of-the-chapter-2-and-so-on"]
    texts_ = [(n, f"{passage(n, 8)} {made[n % 4]()} {passage(n + 500, 8)}") for n in range(200)]
    got = {x["doc_id"]: [s["kind"] for s in x["spans"]] for x in pii.find_spans(spark.createDataFrame(rows(texts_), SCHEMA)).collect()}
    assert all((got[n] == ["secret"]) == (n % 4 < 3) for n in got), Counter((n % 4, tuple(k)) for n, k in got.items())


def test_personal_data_in_long_texts():
    """A text of a million digits, and one of very many numbers: each in a few seconds."""
    for text, kinds in (("7" * 1_000_000, {"card", "number"}), ("123456789 x " * 60_000, {"number"}), ("1.2.3.4 a@b.c " * 60_000, set())):
        began = time.perf_counter()
        base, found = pii._candidates(text)
        assert time.perf_counter() - began < 10
        assert {x[0] for x in found} <= kinds and [x for x in base if x[0] == "ip"] == [("ip", k, k + 7, True) for k in range(0, len(text), 14) if "." in text]
        ends = sorted((s, e) for _, s, e, _ in found)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_reliabilities_follow_the_votes():
    """Expectation-maximisation finds each labeler's reliability, that of the kind's own check too."""
    r = np.random.default_rng(3)
    truth = r.random(20_000) < 0.6
    right = [0.7, 0.9, 0.85, 0.9, 0.8]
    votes = Counter(tuple(int(v) for v in np.where(r.random(5) < right, 1, -1) * (1 if t else -1)) for t in truth)
    prior, found = pii.reliabilities(votes)
    assert abs(prior - 0.6) < 0.03
    for j, share in enumerate(right):
        assert abs(found[1, j, 1] - share) < 0.06 and abs(found[0, j, 0] - share) < 0.06


def test_utf8_of_slices(spark):
    import pyarrow as pa

    t = pa.table({"text": ["ab", "é", "", "xyz"]}).slice(1, 3)
    data, offsets = utf8(t.column("text"))
    assert data.tobytes().decode() == "éxyz" and offsets.tolist() == [0, 2, 2, 5]
