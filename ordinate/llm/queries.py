"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: module -> query; a module's SQL, where it has one, is its oracle.
MODULES = {
    "line_dedup": "op1_line_dedup",
    "suffix_dedup": "op2_suffix_dedup",
    "pii": "op7_pii",
    "simhash": "op3_simhash",
    "html": "op4_html",
    "decontam": "op5_decontamination",
    "sharding": "op9_sharding",
    "toxicity": "op6_toxicity",
    "bpe": "op8_bpe",
    "topk": "op10_exact_topk",
    "url_filter": "op11_url_filter",
    "merkle": "op12_merkle",
    "periodic": "op13_periodic",
}


def queries() -> dict:
    return {q: getattr(import_module(f"ordinate.llm.{m}"), q) for m, q in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {q: getattr(import_module(f"ordinate.llm.{m}"), "SQL", None) for m, q in MODULES.items()}
    return {q: s for q, s in found.items() if s}
