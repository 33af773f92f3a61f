"""The registered queries of this subpackage, with the SQL of those that SQL can express."""

from __future__ import annotations

from groundspark.llm.ann import op2_ann
from groundspark.llm.bpe import op1_bpe
from groundspark.llm.chat import OP10_SQL, op10_chat
from groundspark.llm.dedup import OP12_SQL, op12_dedup
from groundspark.llm.divergence import OP13_SQL, op13_divergence
from groundspark.llm.extract import op4_html
from groundspark.llm.jaccard import op6_jaccard
from groundspark.llm.mixing import OP5_SQL, op5_mixing
from groundspark.llm.negatives import OP11_SQL, op11_negatives
from groundspark.llm.pii import op9_pii
from groundspark.llm.quality import op3_quality
from groundspark.llm.topk import OP8_SQL, op8_topk
from groundspark.llm.warc import OP7_SQL, op7_warc


def queries():
    return {
        "op1_bpe": op1_bpe,
        "op2_ann": op2_ann,
        "op3_quality": op3_quality,
        "op4_html": op4_html,
        "op5_mixing": op5_mixing,
        "op6_jaccard": op6_jaccard,
        "op7_warc": op7_warc,
        "op8_topk": op8_topk,
        "op9_pii": op9_pii,
        "op10_chat": op10_chat,
        "op11_negatives": op11_negatives,
        "op12_dedup": op12_dedup,
        "op13_divergence": op13_divergence,
    }


def oracle_sql():
    return {
        "op5_mixing": OP5_SQL,
        "op7_warc": OP7_SQL,
        "op8_topk": OP8_SQL,
        "op10_chat": OP10_SQL,
        "op11_negatives": OP11_SQL,
        "op12_dedup": OP12_SQL,
        "op13_divergence": OP13_SQL,
    }
