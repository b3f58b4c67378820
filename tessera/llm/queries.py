"""One query for each corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.decontam import decontaminate
from tessera.llm.langid import identify_languages
from tessera.llm.licenses import scan_licenses, train
from tessera.llm.media import text_media
from tessera.llm.pieces import Pieces, encode_pieces
from tessera.llm.quality import judge_quality
from tessera.llm.sharding import histogram_shards
from tessera.llm.simhash import hex_print, near_duplicates
from tessera.llm.suffixes import repeat_report
from tessera.llm.urlrules import judge_urls, rules_frame


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), Pieces.load()).drop("ids")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_shards(table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), train())


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex_print("fp").alias("fingerprint"), "component_id")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scans": op1_license_scans,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_sharding": op6_sharding,
    "op7_url_filters": op7_url_filters,
    "op8_media_columns": op8_media_columns,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_language_id": op10_language_id,
}

ORACLE = {
    "op7_url_filters": r"""
WITH rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, row_number() OVER () AS rid, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, rid, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
t AS (SELECT page_id, rid, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM s),
m AS (SELECT t.*, h || p AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC, v DESC) AS k
      FROM t LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1""",
}
