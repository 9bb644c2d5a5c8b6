"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from labelsift.llm import decontaminate, edit_join, exact_dedup, language_id, mixing, pii, shingle_join, subword_lattice, token_counts, toxicity

MODULES = {
    "op1_toxicity": toxicity,
    "op2_exact_dedup": exact_dedup,
    "op3_subword_lattice": subword_lattice,
    "op4_language_id": language_id,
    "op5_edit_join": edit_join,
    "op6_token_counts": token_counts,
    "op7_shingle_join": shingle_join,
    "op8_mixing": mixing,
    "op9_pii": pii,
    "op10_decontaminate": decontaminate,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in MODULES.items() if getattr(module, "SQL", None)}
