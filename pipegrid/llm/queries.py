"""The queries of the training-data operators, by name."""

from __future__ import annotations

from pipegrid.llm import bytepair, chat, exactdup, imatch, neardup, packing, pii, tokens, topk, toxic
from pipegrid.session import ship


def queries() -> dict:
    found = {f.__name__: f for f in (chat.op1_chat_format, exactdup.op2_suffix_dedup, imatch.op3_imatch, packing.op4_packing, topk.op5_top_k, toxic.op6_toxicity, tokens.op7_token_counts, pii.op8_pii, neardup.op9_minhash, bytepair.op10_byte_bpe)}

    def shipped(f):
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {k: shipped(f) for k, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.OP1_SQL, "op5_top_k": topk.OP5_SQL}
