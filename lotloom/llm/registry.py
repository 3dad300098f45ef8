"""Queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ball_kmeans import ORACLE_SQL as KMEANS_SQL
from .ball_kmeans import op11_ball_kmeans
from .binary_output import op7_token_files
from .embedding_dedup import op3_embedding_dedup
from .html_text import op12_html_text
from .impact_search import ORACLE_SQL as SEARCH_SQL
from .impact_search import op13_impact_search
from .license_scan import op2_license_scan
from .line_dedup import ORACLE_SQL as LINE_DEDUP_SQL
from .line_dedup import op5_line_dedup
from .media import op10_media
from .minhash_dedup import op8_minhash_dedup
from .mixing import op6_mixing
from .packing import op9_packing
from .toxicity import op1_toxicity
from .warc import ORACLE_SQL as WARC_SQL
from .warc import op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_token_files": op7_token_files,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_packing": op9_packing,
    "op10_media": op10_media,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_html_text": op12_html_text,
    "op13_impact_search": op13_impact_search,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": WARC_SQL,
    "op5_line_dedup": LINE_DEDUP_SQL,
    "op11_ball_kmeans": KMEANS_SQL,
    "op13_impact_search": SEARCH_SQL,
}
