"""The subpackage's queries: names, callables and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, audit, bpe, linededup, mainhtml, matroska, mixing, neardup, pii, repair, tokenfiles, toxicity, warc


def queries():
    return {
        "op1_tokens": tokenfiles.op1_tokens,
        "op2_bpe": bpe.op2_bpe,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_ann": ann.op4_ann,
        "op5_neardup": neardup.op5_neardup,
        "op6_mixing": mixing.op6_mixing,
        "op7_warc": warc.op7_warc,
        "op8_mainhtml": mainhtml.op8_mainhtml,
        "op9_pii": pii.op9_pii,
        "op10_media": matroska.op10_media,
        "op11_filter_audit": audit.op11_filter_audit,
        "op12_conversation_repair": repair.op12_conversation_repair,
        "op13_line_dedup": linededup.op13_line_dedup,
    }


def oracle_sql():
    return {"op5_neardup": neardup.ORACLE, "op6_mixing": mixing.ORACLE, "op7_warc": warc.ORACLE, "op11_filter_audit": audit.ORACLE, "op13_line_dedup": linededup.ORACLE}
