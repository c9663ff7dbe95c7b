"""Queries and SQL of this subpackage's operators."""

from __future__ import annotations

from tesserae.llm.byte_bpe import op5_byte_bpe
from tesserae.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from tesserae.llm.exact_topk import OP10_SQL, op10_exact_topk
from tesserae.llm.langid import op9_langid
from tesserae.llm.minhash_forest import op4_minhash_forest
from tesserae.llm.mixing import op8_mixing
from tesserae.llm.suffix_dedup import op7_suffix_dedup
from tesserae.llm.token_sstable import op3_token_sstable
from tesserae.llm.toxicity import op2_toxicity
from tesserae.llm.warc import OP6_SQL, op6_warc


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_token_sstable": op3_token_sstable,
        "op4_minhash_forest": op4_minhash_forest,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_warc": op6_warc,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_mixing": op8_mixing,
        "op9_langid": op9_langid,
        "op10_exact_topk": op10_exact_topk,
    }


def oracle_sql() -> dict:
    return {"op1_exact_dedup": OP1_SQL, "op6_warc": OP6_SQL, "op10_exact_topk": OP10_SQL}
