"""Registered queries of this subpackage, each an operator with production parameters over its whole table."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from erario.llm import exact_dedup, license_scan, line_dedup, merkle, mixing, near_dedup, packing, periodic_runs, quality, token_counts, toxicity, url_filter, vp_search
from erario.llm.common import table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return vp_search.search(vp_search.build_index(vectors), vectors.filter("vec_id % 20 = 0"), k=20, factor=1.0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_vantage_point_search": _nearest,
    "op2_token_counts": lambda spark, folder: token_counts.count_tokens(table(spark, folder, "documents"), BYTE_VOCABULARY),
    "op3_license_scan": lambda spark, folder: license_scan.license_digest(license_scan.scan_licenses(table(spark, folder, "documents"))),
    "op4_mix_sources": lambda spark, folder: mixing.mix_report(table(spark, folder, "documents")),
    "op5_harmonic_packing": lambda spark, folder: packing.pack(table(spark, folder, "documents"), WORD_VOCABULARY),
    "op6_toxicity": lambda spark, folder: toxicity.score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels")),
    "op7_grace_dedup": lambda spark, folder: exact_dedup.dedup_exact(table(spark, folder, "documents")),
    "op8_line_dedup": lambda spark, folder: line_dedup.line_digest(line_dedup.clean_lines(table(spark, folder, "documents"))),
    "op9_quality": lambda spark, folder: quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels")),
    "op10_minhash_dedup": lambda spark, folder: near_dedup.link(table(spark, folder, "documents"), width=2, percent=80),
    "op11_path_templates": lambda spark, folder: url_filter.judge_urls(table(spark, folder, "pages")),
    "op12_periodic_runs": lambda spark, folder: periodic_runs.run_digest(table(spark, folder, "documents")),
    "op13_merkle_manifest": lambda spark, folder: merkle.prove_documents(table(spark, folder, "documents")),
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op1_vantage_point_search": vp_search.SEARCH_SQL, "op4_mix_sources": mixing.REPORT_SQL, "op7_grace_dedup": exact_dedup.EXACT_SQL, "op8_line_dedup": line_dedup.LINE_SQL, "op10_minhash_dedup": near_dedup.LINK_SQL, "op11_path_templates": url_filter.JUDGE_SQL, "op12_periodic_runs": periodic_runs.RUN_SQL, "op13_merkle_manifest": merkle.PROOF_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
