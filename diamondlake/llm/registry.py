"""Queries of the subpackage and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

from .decontamination import op5_decontamination
from .language_id import op10_language_id
from .neighbours import op8_nearest_neighbours
from .ngram_join import op6_ngram_join
from .packing import op3_lexical_packing
from .secret_scan import op9_secret_scan
from .suffix_dedup import op2_suffix_dedup
from .token_counts import op7_token_counts
from .url_filter import OP4_SQL, op4_url_filter
from .warc_audit import OP1_SQL, op1_warc_audit

QUERIES = {
    "op1_warc_audit": op1_warc_audit,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_lexical_packing": op3_lexical_packing,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_ngram_join": op6_ngram_join,
    "op7_token_counts": op7_token_counts,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
}
ORACLE_SQL: dict[str, str] = {"op1_warc_audit": OP1_SQL, "op4_url_filter": OP4_SQL}
