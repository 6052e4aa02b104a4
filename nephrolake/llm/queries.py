"""The registered queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from . import language_id, line_dedup, ngram_join, packing, piece_lattice, pii, quality_model, quality_rules, substring_dedup, vector_dedup
from .oracles import ORACLE_SQL  # noqa: F401  part of this module's interface

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_ngram_join": ngram_join.query,
    "op3_packing": packing.query,
    "op4_language_id": language_id.query,
    "op5_quality_model": quality_model.query,
    "op6_vector_dedup": vector_dedup.query,
    "op7_line_dedup": line_dedup.query,
    "op8_pii": pii.query,
    "op9_piece_lattice": piece_lattice.query,
    "op10_quality_rules": quality_rules.query,
}
