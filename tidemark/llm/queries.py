"""Queries of this subpackage; their SQL, where it can express one, is in ``oracle``."""

from __future__ import annotations

from tidemark.llm import decontaminate, hard_negatives, language, line_dedup, merkle, ngram_join, packing, quality, secrets, substring_dedup, telephony, toxicity, warc
from tidemark.llm.oracles import ORACLES  # noqa: F401

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_telephony": telephony.op2_telephony,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_packing": packing.op5_packing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_secrets": secrets.op7_secrets,
    "op8_quality": quality.op8_quality,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_warc": warc.op10_warc,
    "op11_language_id": language.op11_language_id,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}
