"""Audits over records and ledgers: lengths, batches, schedules, steps."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.stats import close, cosine_rate
from tessera.operators.ranking import batches, hash_rank

FRACTIONS = (0.5, 0.95, 0.99)


def count_tokens(rows: DataFrame, text_col: str, encode: Callable[[list[str]], list[int]], name: str = "n_tokens") -> DataFrame:
    """rows with the number of tokens that an injected tokenizer gives each text."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(encode(x.fillna("").tolist()))

    return rows.withColumn(name, run(F.col(text_col)))


def length_audit(rows: DataFrame, limit: int, column: str = "n_tokens", *by: str) -> DataFrame:
    """Count, minimum, nearest-rank percentiles, maximum and how many are over the limit; rows of null length do not count.

    Ranks come from the numbers of rows of each length and their running sums, exact at every size."""
    lengths = rows.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("length")).agg(F.count("*").alias("k"))
    window = Window.partitionBy(*by).orderBy("length")
    upto = F.sum("k").over(window.rowsBetween(Window.unboundedPreceding, 0))
    ranked = lengths.withColumn("upto", upto).withColumn("whole", F.sum("k").over(Window.partitionBy(*by)))
    at = lambda f: F.min(F.when(F.col("upto") >= F.greatest(F.ceil(F.lit(f) * F.col("whole")), F.lit(1)), F.col("length")))
    return ranked.groupBy(*by).agg(
        F.sum("k").alias("n"), F.min("length").alias("min"), *[at(f).alias(f"p{round(100 * f)}") for f in FRACTIONS], F.max("length").alias("max"),
        F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("k"))), F.lit(0)).alias("over_limit"),
    )


def triples(rows: DataFrame) -> DataFrame:
    """Groups that are not exactly C, D, M at consecutive places, or whose flags do not fit their split.

    rows: id, orbit_id, state, place (line number), split, training_read_allowed, sealed."""
    g = rows.groupBy("orbit_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "state"))), lambda s: s["state"]).alias("states"), F.min("place").alias("low"), F.max("place").alias("high"), F.count_distinct("split").alias("splits"),
        F.count_if(F.col("sealed") | ~F.col("training_read_allowed")).alias("closed"), F.count_distinct("id").alias("ids"),
    )
    good = (F.col("states") == F.array(*map(F.lit, "CDM"))) & (F.col("high") - F.col("low") == 2) & (F.col("low") % 3 == 0) & (F.col("splits") == 1) & (F.col("closed") == 0) & (F.col("ids") == 3)
    return g.where(~good)


def schedule(ids: DataFrame, id_col: str = "orbit_id", seed: int = 17, size: int = 8) -> DataFrame:
    """The order in which a run reads its orbits, whatever order they came in, in batches."""
    return batches(hash_rank(ids.select(id_col).distinct(), id_col, str(seed)), size=size)


def batch_digests(plan: DataFrame, id_col: str = "orbit_id") -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", id_col))), lambda x: x[id_col])
    return plan.groupBy("batch").agg(F.sha2(F.array_join(ids, "\n"), 256).alias("orbit_batch_sha256"), F.count("*").alias("orbits"))


def ledger_faults(ledger: DataFrame, plan: DataFrame, steps: int = 240, size: int = 8, peak: float = 2e-4, warm: int = 8) -> DataFrame:
    """(optimizer_step, fault) of rows that are missing, repeated, not finite, flagged, or off the schedule or rate."""
    want = plan.sparkSession.range(1, steps + 1).select(F.col("id").alias("optimizer_step")).join(batch_digests(plan).select((F.col("batch") + 1).alias("optimizer_step"), F.col("orbit_batch_sha256").alias("want")), "optimizer_step", "left")
    rows = want.join(ledger, "optimizer_step", "full_outer")
    numbers = [f.name for f in ledger.schema.fields if f.dataType.simpleString() == "double"]
    flags = [f.name for f in ledger.schema.fields if f.dataType.simpleString() == "boolean"]
    step = F.col("optimizer_step")
    odd = F.lit(False)
    for c in numbers:
        odd = odd | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    down = F.lit(False)
    for c in flags:
        down = down | ~F.coalesce(F.col(c), F.lit(False))
    fault = (
        F.when(F.col("orbit_batch_sha256").isNull(), "missing_step")
        .when((step < 1) | (step > steps), "extra_step")
        .when(odd, "not_finite")
        .when(down, "flag_false")
        .when(F.col("orbit_batch_sha256") != F.col("want"), "batch_differs")
        .when(F.col("consumed_orbits") != step * size, "consumed_differs")
        .when(~close(F.col("learning_rate_applied"), cosine_rate(step - 1, peak, warm, steps)), "rate_differs")
    )
    again = ledger.groupBy("optimizer_step").count().where("count > 1").select("optimizer_step", F.lit("repeated_step").alias("fault"))
    return rows.select("optimizer_step", fault.alias("fault")).where("fault IS NOT NULL").unionByName(again)


def micro_means(rows: DataFrame, *by: str) -> DataFrame:
    """Mean of every double column; raises if one is not finite."""
    names = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "double" and f.name not in by]
    safe = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.raise_error(F.lit(f"{c} is not finite"))).otherwise(F.col(c))
    return rows.groupBy(*by).agg(*[F.avg(safe(c)).alias(c) for c in names])
