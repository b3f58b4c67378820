"""JSON lines in and out: explicit schemas, quarantine or failure, canonical output."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.digest import canonical

PARAGRAPHS = "array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>"
SOURCE = f"id string, paragraphs {PARAGRAPHS}, question string, question_decomposition array<struct<id:int,question:string,answer:string,paragraph_support_idx:int>>, answer string, answer_aliases array<string>, answerable boolean"


def _strict(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def strict_object(text: str | bytes) -> dict:
    """One JSON object; raises on repeated keys, NaN and Infinity, text that is not UTF-8, and other values."""
    value = json.loads(text.decode() if isinstance(text, bytes) else text, object_pairs_hook=_strict, parse_constant=_no_constant)
    if not isinstance(value, dict):
        raise ValueError("not a JSON object")
    return value


def _fits(value, kind: T.DataType) -> bool:
    if value is None:
        return True
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return isinstance(value, int)
    if isinstance(kind, T.DoubleType):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(_fits(v, kind.elementType) for v in value)
    if isinstance(kind, T.StructType):
        return isinstance(value, dict) and all(f.name in value and _fits(value[f.name], f.dataType) for f in kind.fields)
    return False


def _trim(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [_trim(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return {f.name: _trim(value[f.name], f.dataType) for f in kind.fields}
    if isinstance(kind, (T.IntegerType, T.LongType)):
        return int(value)
    return value


def read_jsonl(spark: SparkSession, path: str, schema: str = SOURCE, blank: str = "skip") -> DataFrame:
    """Rows with row_sha256 (of the line and its newline), file and fault (null if the line is right).

    Every line is checked by the strict parser in Arrow batches: repeated keys, missing keys and wrong types are
    faults; keys beyond the schema are not. blank: 'skip' leaves blank lines out, 'fault' reports them."""
    kind = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else spark.createDataFrame([], schema).schema
    lines = spark.read.text(path).select("value", F.sha2(F.concat("value", F.lit("\n")), 256).alias("row_sha256"), F.col("_metadata.file_name").alias("file"))
    if blank == "skip":
        lines = lines.where(F.trim("value") != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, faults = [], []
            for text in batch.column("value").to_pylist():
                try:
                    value = strict_object(text)
                    if not _fits(value, kind):
                        raise ValueError("a key is missing or of another type")
                    rows.append(json.dumps(_trim(value, kind)))
                    faults.append(None)
                except ValueError as e:
                    rows.append(None)
                    faults.append(str(e)[:200])
            yield pa.record_batch({"row_sha256": batch.column("row_sha256"), "file": batch.column("file"), "fault": pa.array(faults, pa.string()), "json": pa.array(rows, pa.string())})

    parsed = lines.mapInArrow(run, "row_sha256 string, file string, fault string, json string")
    return parsed.select(F.from_json("json", kind).alias("r"), "row_sha256", "file", "fault").select("r.*", "row_sha256", "file", "fault")


def good_rows(rows: DataFrame) -> DataFrame:
    """Rows without a fault; raises at the first faulty one that is read."""
    clear = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("a source line is wrong: "), F.col("fault")))).otherwise(F.lit(True))
    return rows.where(clear).drop("fault")


def check_counts(table: DataFrame, /, **expected: int) -> None:
    """Raises unless the table has the expected numbers: rows, and distinct values of named columns."""
    got = table.agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(c) for c in expected if c != "rows"]).first().asDict()
    if any(got[k] != v for k, v in expected.items()):
        raise ValueError(f"expected {expected}, found {got}")


def reread(rows: DataFrame, selected: DataFrame, id_col: str = "id") -> DataFrame:
    """Full rows of the selected ids: a semi-join in place of seeking."""
    return rows.join(selected.select(id_col).distinct(), id_col, "left_semi")


def to_canonical(rows: DataFrame, order: list[str]) -> DataFrame:
    """One column `value`: rows as JSON with sorted keys and no spaces, numbers as Python writes them, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"value": pa.array([canonical(r) for r in batch.to_pylist()], pa.string())})

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, "value string")


def write_canonical(rows: DataFrame, path: str, order: list[str]) -> None:
    """Part files whose names are in the order of the rows."""
    to_canonical(rows, order).write.mode("errorifexists").text(path)


def write_release(records: DataFrame, path: str) -> None:
    """Records as Parquet, a folder per split, so that a reader of one split never opens another."""
    records.write.mode("errorifexists").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Records of one split that may be read; the sealed one cannot be."""
    if split == "shadow":
        raise PermissionError("the sealed split is not read")
    rows = spark.read.parquet(path).where(F.col("split") == split)
    return rows.where(F.when(F.col("sealed") | ~F.col("training_read_allowed"), F.raise_error(F.lit("a sealed record"))).otherwise(F.lit(True)))
