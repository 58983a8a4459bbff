"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from corpus_pipeline import run

from . import oracles
from .centroids import op13_centroids
from .compact_windows import op7_compact_windows
from .fingerprint import op1_fingerprint
from .line_rules import op6_line_rules
from .license_scan import op8_license_scan
from .merkle import op11_merkle
from .mixing import op10_mixing
from .near_dedup import op2_near_dedup
from .packing import op4_packing
from .pseudonyms import op9_pseudonyms
from .sharding import op5_sharding
from .substring_dedup import op3_substring_dedup
from .url_filter import op12_url_filter


def queries() -> dict:
    return {
        "op1_fingerprint": op1_fingerprint,
        "op2_near_dedup": op2_near_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_packing": op4_packing,
        "op5_sharding": op5_sharding,
        "op6_line_rules": op6_line_rules,
        "op7_compact_windows": op7_compact_windows,
        "op8_license_scan": op8_license_scan,
        "op9_pseudonyms": op9_pseudonyms,
        "op10_mixing": op10_mixing,
        "op11_merkle": op11_merkle,
        "op12_url_filter": op12_url_filter,
        "op13_centroids": op13_centroids,
        "pipeline": run,
    }


def oracle_sql() -> dict:
    return {
        "op2_near_dedup": oracles.NEAR_DEDUP,
        "op3_substring_dedup": oracles.SUBSTRINGS,
        "op6_line_rules": oracles.LINE_RULES,
        "op11_merkle": oracles.merkle(),
        "op12_url_filter": oracles.url_filter(),
        "op13_centroids": oracles.centroids(),
    }
