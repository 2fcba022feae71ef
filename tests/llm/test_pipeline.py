"""The pipeline's stages against brute force on a small corpus."""

from __future__ import annotations

import random
import re

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import passage
from tests.llm.test_duplicates import linked, removed

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, folder):
    r = random.Random(1)
    texts = []
    for n in range(160):
        text = passage(n, 60)
        if n % 4 == 0:
            text += " " + r.choice(["loser", "scum", "idiot"]) + " " + passage(n + 900, 12)
        if n % 10 == 3:
            text += " " + passage(5000, 14)
        if n % 20 == 7:
            text = texts[n - 2][1] + " tail"
        if n % 20 == 9:
            text += " reach me at a.b@c.de"
        texts.append((n, text))
    texts.append((160, None))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(n, 0, int(n % 4 == 0)) for n in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def rows(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_stages(spark, tmp_path):
    folder = str(tmp_path)
    corpus(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/out{k}")
        docs = spark.read.parquet(f"{folder}/out{k}")
        if k < 4:
            assert docs.columns == COLUMNS.replace(" long", "").replace(" string", "").split(", "), name
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect() if r["text"] is not None), name
            seen.append(rows(docs))
    clean, near, cut, masked = seen
    gone = set(range(161)) - {i for i, _ in clean}
    assert len([i for i in gone if i % 4 == 0]) >= 30 and len([i for i in gone if i % 4]) <= 3
    kept = {i for (i, _, _, ok) in linked(clean) if ok}
    assert near == [x for x in clean if x[0] in kept]
    assert cut == sorted((i, raw.decode(errors="ignore")) for i, _, _, raw in removed(near))
    assert masked == [(i, re.sub(r"\S+@\S+", "<email>", t)) for i, t in cut]
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in masked)
    assert sum(r["length"] for r in docs.collect()) == want
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
