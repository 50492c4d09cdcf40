"""Queries and SQL of this subpackage."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module that defines it.
MODULES = {
    "op1_simple8b_ids": "simple8b",
    "op2_suffix_tree_lm": "suffixtree",
    "op3_quality_ngrams": "quality",
    "op4_toxicity_grammar": "toxicity",
    "op5_bottomk_neardup": "neardup",
    "op6_pii_spans": "pii",
    "op7_latent_decontamination": "latent",
    "op8_ring_shards": "ring",
    "op9_seekable_warc": "warc",
    "op10_suffix_array_pieces": "pieces",
    "op11_trie_collocations": "collocations",
    "op12_simhash_balls": "simhash",
    "op13_spelling_halves": "spelling",
}


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    out = {name: getattr(import_module(f"lexbind.llm.{module}"), name) for name, module in MODULES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL, where SQL can express the whole result."""
    out = {}
    for name, module in MODULES.items():
        out |= {k: v for k, v in getattr(import_module(f"lexbind.llm.{module}"), "ORACLE_SQL", {}).items() if k == name}
    return out
