"""Cutting lineage with tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []  # this process's own folder, made only if a local session names none
#: Spark's option to delete the shuffle files of a query as soon as it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir. Where none is named, a local session gets a temporary one;
    on a cluster that would be a folder of one machine, so it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
        base = _OWN[0]
    return f"{base}/tessera/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends there, and lost executors cost nothing. The
    shuffle files that the write took are deleted when it ends."""
    conf, path = df.sparkSession.conf, shared_path(df.sparkSession, name)
    before = conf.get(CLEAN, "false")
    conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEAN, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.tessera_path = path  # plain attribute, for drop()
    return out


def drop(df: DataFrame) -> None:
    """Delete the files behind a cut() table that nothing reads any more."""
    spark, path = df.sparkSession, df.tessera_path
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
