"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import (chat, context_tree, decontaminate, html_extract, jaccard_join, merkle, mixing, periodic_runs, pii, quality_rules,
               token_store, toxicity, warc)


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_token_store": token_store.op3_token_store,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_html_extract": html_extract.op5_html_extract,
        "op6_pii": pii.op6_pii,
        "op7_chat": chat.op7_chat,
        "op8_mixing": mixing.op8_mixing,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_context_tree": context_tree.op10_context_tree,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict:
    return {
        "op1_warc": warc.OP1_SQL,
        "op2_quality_rules": quality_rules.OP2_SQL,
        "op7_chat": chat.OP7_SQL,
        "op8_mixing": mixing.OP8_SQL,
        "op13_merkle": merkle.OP13_SQL,
    }
