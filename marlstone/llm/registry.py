"""Queries of the training-data operators."""

from __future__ import annotations

from marlstone.llm import decontam, extract, langid, licenses, media, mixing, quality, secrets, simhash, toxicity

QUERIES = {
    "op1_secrets": (secrets.op1_secrets, None),
    "op2_simhash": (simhash.op2_simhash, None),
    "op3_quality": (quality.op3_quality, None),
    "op4_extract": (extract.op4_extract, None),
    "op5_mixing": (mixing.op5_mixing, mixing.ORACLE),
    "op6_licenses": (licenses.op6_licenses, None),
    "op7_toxicity": (toxicity.op7_toxicity, None),
    "op8_decontam": (decontam.op8_decontam, None),
    "op9_media": (media.op9_media, None),
    "op10_langid": (langid.op10_langid, None),
}


def queries():
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
