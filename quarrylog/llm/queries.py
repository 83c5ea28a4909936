"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, jaccard_join, language_id, line_dedup, neighbours, packing, pii, quality, token_counts, token_file

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_token_file": token_file.op3_token_file,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_pii": pii.op6_pii,
    "op7_byte_bpe": byte_bpe.op7_byte_bpe,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_neighbours": neighbours.op9_neighbours,
    "quality_ablations": quality.quality_ablations,
}

SQL = {
    "op10_jaccard_join": jaccard_join.SQL,
    "op2_line_dedup": line_dedup.SQL,
    "op8_quality_rules": quality.SQL,
    "quality_ablations": quality.ABLATIONS_SQL,
}
