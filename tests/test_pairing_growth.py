"""Pairs made from one small file are dealt out, and their rows are neither measured before pairing nor moved for it."""

from pyspark.sql import functions as F

from tessera.functions.text import ordered
from tessera.operators.pairing import eligibility, header, pair_rows
from tessera.plans import flagship


def test_pairs_are_dealt_out_before_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(flagship, "PART", 50, raising=False)
    base = spark.range(1000).coalesce(1).select(F.col("id").alias("k"), F.lit("seg").alias("seg"))
    rows = flagship.source_pairs(base)
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 250
    pairs = eligibility(pair_rows(header(rows)))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and pairs.count() == 1000
    assert not {"text_hashes", "held_subanswers"} & set(header(rows).columns)


def test_order_keeps_equal_slots_as_they_came(spark):
    kind = "p array<struct<idx:int,title:string>>"
    rows = [([(0, "b"), (1, "a"), (1, "A")],), ([(2, "c"), (0, "z"), (0, "a")],), ([],), (None,)]
    got = [r["p"] and [tuple(x) for x in r["p"]] for r in spark.createDataFrame(rows, kind).select(ordered(F.col("p")).alias("p")).collect()]
    assert got == [[(0, "b"), (1, "a"), (1, "A")], [(0, "z"), (0, "a"), (2, "c")], [], None]
