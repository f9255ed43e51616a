"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from quarrywork.llm import chat, decontamination, imatch, language_id, merkle, mixing, near_dedup, outliers, periodic_runs, sharding, suffix_dedup, token_output, warc

MODULES = {
    "op1_extendible_sharding": sharding,
    "op2_language_masks": language_id,
    "op3_warc_salvage": warc,
    "op4_decontamination": decontamination,
    "op5_robust_outliers": outliers,
    "op6_source_mixing": mixing,
    "op7_rans_token_output": token_output,
    "op8_suffix_repeats": suffix_dedup,
    "op9_chat_formatting": chat,
    "op10_lsh_forest": near_dedup,
    "op11_periodic_runs": periodic_runs,
    "op12_imatch_fingerprints": imatch,
    "op13_merkle_manifest": merkle,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in MODULES.items() if getattr(module, "ORACLE", None)}
