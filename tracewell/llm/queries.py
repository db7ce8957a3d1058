"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, fim, fingerprint, html, jpeg, line_dedup, lm, merkle, packing, pii, quality, simhash, toxicity
from tracewell.llm import sql as oracle
from tracewell.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_report(table(spark, sf_dir, "pages"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media_report(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(table(spark, sf_dir, "documents"))


QUERIES = {
    q.__name__: q
    for q in (op1_line_dedup, op2_lm_score, op3_toxicity, op4_html_extract, op5_simhash_dedup, op6_media, op7_decontaminate,
              op8_pii, op9_quality, op10_pack, op11_fim, op12_merkle_manifest, op13_fingerprint)
}
SQL = {"op1_line_dedup": oracle.LINES, "op7_decontaminate": oracle.LEAKS, "op8_pii": oracle.PII, "op11_fim": oracle.FIM,
       "op12_merkle_manifest": oracle.MERKLE, "op13_fingerprint": oracle.FINGERPRINTS}
