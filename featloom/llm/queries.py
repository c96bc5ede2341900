"""The registered query of each operator, with production parameters, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm import (
    decontaminate,
    html_text,
    language,
    line_dedup,
    minhash,
    mixing,
    periodic_runs,
    phrases,
    quality,
    secrets,
    simhash,
    suffix_dedup,
    url_filter,
)
from featloom.llm.common import table


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    listed = url_filter.under_domain(F.col("key"), url_filter.BLOCKED_DOMAINS)
    return url_filter.filter_urls(table(spark, folder, "pages"), listed)


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return language.predict(documents, language.learn(documents))


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.group(table(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, folder, "documents"))


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.judge(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return quality.judge(documents, quality.fit(documents, table(spark, folder, "labels")))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.summary(table(spark, folder, "documents"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return periodic_runs.digests(periodic_runs.collapse(documents, rewrite=periodic_runs.loop_tenth))


def op12_minhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = minhash.group(table(spark, folder, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id", "kept")


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine(table(spark, folder, "documents"))


QUERIES = {
    q.__name__: q
    for q in (
        op1_url_filter, op2_secret_scan, op3_language, op4_html_text, op5_simhash, op6_substring_dedup,
        op7_source_mix, op8_decontamination,
        op9_quality, op10_line_dedup, op11_periodic_runs, op12_minhash, op13_phrases,
    )
}
ORACLES = {
    "op1_url_filter": url_filter.URL_SQL,
    "op7_source_mix": mixing.MIX_SQL,
    "op8_decontamination": decontaminate.DECONTAMINATION_SQL,
    "op10_line_dedup": line_dedup.LINE_SQL,
    "op13_phrases": phrases.PHRASES_SQL,
}
