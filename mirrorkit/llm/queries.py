"""The operators as registered queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mirrorkit.llm.common import table
from mirrorkit.llm.edits import edit_fingerprints
from mirrorkit.llm.language import language_rows, page_language_rows
from mirrorkit.llm.licenses import LICENSE_SQL, license_scan
from mirrorkit.llm.lines import LINES_SQL, line_rows
from mirrorkit.llm.mixing import mix_shares
from mirrorkit.llm.packing import packed_pieces
from mirrorkit.llm.pii import pii_rows
from mirrorkit.llm.quality import QUALITY_SQL, quality_rows
from mirrorkit.llm.search import SEARCH_SQL, search
from mirrorkit.llm.simhash import near_duplicates
from mirrorkit.llm.simplex import CLUSTERS_SQL, cluster_rows
from mirrorkit.llm.token_files import token_file_rows
from mirrorkit.llm.toxicity import toxicity


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": _over("documents", packed_pieces),
    "op2_license_scan": _over("documents", license_scan),
    "op3_toxicity": lambda spark, sf_dir: toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op4_language_id": language_rows,
    "llm_page_languages": page_language_rows,
    "op5_mixing": _over("documents", mix_shares),
    "op6_edit_fingerprints": _over("documents", edit_fingerprints),
    "op7_simhash": _over("documents", near_duplicates),
    "op8_pii": _over("documents", pii_rows),
    "op9_token_files": _over("documents", token_file_rows),
    "op10_quality": _over("documents", quality_rows),
    "op11_search": lambda spark, sf_dir: search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op12_clusters": _over("embeddings", cluster_rows),
    "op13_line_dedup": _over("documents", line_rows),
}

ORACLES: dict[str, str] = {
    "op2_license_scan": LICENSE_SQL,
    "op10_quality": QUALITY_SQL,
    "op11_search": SEARCH_SQL,
    "op12_clusters": CLUSTERS_SQL,
    "op13_line_dedup": LINES_SQL,
}
