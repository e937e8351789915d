"""The registered queries of the training-data operators and the SQL oracles of those SQL can express."""

from __future__ import annotations

from stratalog.llm import binary, chat, decontam, embed_dedup, html_extract, mixing, pii, sharding, simhash, toxicity


def queries():
    return {
        "op1_html": html_extract.op1_html,
        "op2_simhash": simhash.op2_simhash,
        "op3_mixing": mixing.op3_mixing,
        "op4_sharding": sharding.op4_sharding,
        "op5_binary": binary.op5_binary,
        "op6_embeddings": embed_dedup.op6_embeddings,
        "op7_chat": chat.op7_chat,
        "op8_pii": pii.op8_pii,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_decontamination": decontam.op10_decontamination,
    }


def oracle_sql():
    return {"op6_embeddings": embed_dedup.ORACLE, "op7_chat": chat.ORACLE, "op10_decontamination": decontam.ORACLE}
