"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op8_byte_bpe
from .hnsw import op1_hnsw
from .importance import OP13_SQL, op13_importance_resampling
from .licenses import op9_license_scans
from .neardup import OP5_SQL, op5_minhash_near_dedup
from .packing import op4_best_fit_packing
from .quality import OP3_SQL, op3_quality_rules
from .secrets import OP6_SQL, op6_secret_scans
from .sharding import OP2_SQL, op2_sharding
from .spelling import OP12_SQL, op12_spelling_variants
from .suffixes import OP11_SQL, op11_suffix_array_dedup
from .token_counts import op10_token_counts
from .warc import OP7_SQL, op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hnsw": op1_hnsw,
    "op2_sharding": op2_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_secret_scans": op6_secret_scans,
    "op7_warc": op7_warc,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_license_scans": op9_license_scans,
    "op10_token_counts": op10_token_counts,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": OP2_SQL,
    "op3_quality_rules": OP3_SQL,
    "op5_minhash_near_dedup": OP5_SQL,
    "op6_secret_scans": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op11_suffix_array_dedup": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
