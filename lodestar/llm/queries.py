"""The queries of this package and their SQL."""

from __future__ import annotations

from .filter_audit import OP11_SQL, op11_filter_audit
from .language_id import op4_language_id
from .mixing import op5_mixing
from .ngram_join import op10_ngram_join
from .packing import op7_packing
from .pii import op2_pii
from .quality import op9_quality
from .sharding import op1_sharding
from .tile_search import OP13_SQL, op13_tile_search
from .token_counts import op6_token_counts, token_counts_warm
from .token_files import op3_token_files
from .topk import OP8_SQL, op8_topk
from .turn_repair import op12_turn_repair

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_pii": op2_pii,
    "op3_token_files": op3_token_files,
    "op4_language_id": op4_language_id,
    "op5_mixing": op5_mixing,
    "op6_token_counts": op6_token_counts,
    "op7_packing": op7_packing,
    "op8_topk": op8_topk,
    "op9_quality": op9_quality,
    "op10_ngram_join": op10_ngram_join,
    "op11_filter_audit": op11_filter_audit,
    "op12_turn_repair": op12_turn_repair,
    "op13_tile_search": op13_tile_search,
    "token_counts_warm": token_counts_warm,
}

ORACLE_SQL: dict[str, str] = {"op8_topk": OP8_SQL, "op11_filter_audit": OP11_SQL, "op13_tile_search": OP13_SQL}
