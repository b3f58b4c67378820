"""Orders over whole tables without one task that sorts them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.digest import joined_sha
from tessera.plans.lineage import cut


def global_rank(rows: DataFrame, order: list[str], group: str | None = None, name: str = "rank") -> DataFrame:
    """rows with their place from 0 in the order (within the group, if one is named); the order's columns must tell
    rows apart. Rows are range-partitioned and counted per partition; the counts, at most one per partition and
    group, give each partition its first place."""
    keys = [*([group] if group else []), *order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33).alias("__part")
    own = [F.col(group).alias("__group")] if group else [F.lit(0).alias("__group")]
    counts = sorted((r["__group"], r["__part"], r["low"], r["n"]) for r in placed.groupBy(*own, part).agg(F.min("__at").alias("low"), F.count("*").alias("n")).collect())
    before, seen, last = [], 0, None
    for g, p, low, k in counts:
        seen = 0 if g != last else seen
        before.append((g, p, seen - low))
        seen, last = seen + k, g
    kind = rows.schema[group].dataType.simpleString() if group else "int"
    shift = rows.sparkSession.createDataFrame(before, f"__g {kind}, __p long, __shift long")
    on = (F.shiftright("__at", 33) == F.col("__p")) & ((F.col(group) == F.col("__g")) if group else F.lit(True))
    return placed.join(F.broadcast(shift), on).withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__g", "__p", "__shift")


def hash_rank(rows: DataFrame, id_col: str, *salt: str, name: str = "rank") -> DataFrame:
    """Places in the order of the digest of salt and id, then id: a draw that anyone can repeat."""
    return global_rank(rows.withColumn("__sha", joined_sha(*salt, F.col(id_col))), ["__sha", id_col], name=name).drop("__sha")


def stable_folds(ids: DataFrame, id_col: str, seed: str, folds: int = 5) -> DataFrame:
    """(id, fold): distinct ids dealt out in digest order."""
    return hash_rank(ids.select(id_col).distinct(), id_col, seed).select(id_col, (F.col("rank") % folds).cast("int").alias("fold"))


def batches(rows: DataFrame, rank: str = "rank", size: int = 8) -> DataFrame:
    return rows.withColumn("batch", F.floor(F.col(rank) / size))


def top(rows: DataFrame, k: int, by: list[Column], *partition: str) -> DataFrame:
    """The first k rows of each partition; Spark limits the groups before it shuffles them."""
    from pyspark.sql import Window

    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*partition).orderBy(*by))).where(F.col("__rn") <= k).drop("__rn")
