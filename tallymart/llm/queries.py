"""The queries of this subpackage, with DuckDB SQL where SQL can express one."""

from __future__ import annotations

from . import blocks, bpe, jpeg, lm, mixing, negatives, packing, pii, quality, sharding, simhash, spelling, urls

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_lm_scoring": lm.op2_lm_scoring,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_pii": pii.op4_pii,
    "op5_balanced_shards": sharding.op5_balanced_shards,
    "op6_media_columns": jpeg.op6_media_columns,
    "op7_mixing": mixing.op7_mixing,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_url_filters": urls.op9_url_filters,
    "op10_html_extraction": blocks.op10_html_extraction,
    "op11_best_fit_packing": packing.op11_best_fit_packing,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {**quality.ORACLE_SQL, **urls.ORACLE_SQL, **negatives.ORACLE_SQL}
