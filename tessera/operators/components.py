"""Connected components of an edge table by alternating large and small stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut, drop


def _toward_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and all its v. A min per node combines map-side; the join splits hot nodes."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, label) for every node that has an edge to another one; the label is the least node of its component.

    edges: columns a and b, long. Self-loops and repeats do no harm; no edge gives an empty table. Every round is
    written to the shared folder, so a lost executor costs one round at most. After 40 rounds it raises: the number
    grows with the logarithm of the largest component, so that is not reached.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    mark = print_of(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _toward_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        step = cut(large, "large")
        star = _toward_least(step)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(small, "small")
        drop(step)
        drop(now)
        now, before, mark = new, mark, print_of(new)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    raise RuntimeError("the components did not settle")


def key_components(rows: DataFrame, id_col: str, keys_col: str) -> DataFrame:
    """(id, label) of rows that share keys, directly or through others; the label is the least id of the component.

    Rows are linked to the least row of each of their keys, never to each other, so a key that a third of all rows
    has makes as many edges as rows. Ids are strings or numbers and unique; rows without a key are their own component.
    """
    numbered = rows.select(F.col(id_col).alias("id"), F.explode_outer(keys_col).alias("key")).select("id", "key", F.xxhash64("id").alias("n"))
    first = numbered.where("key IS NOT NULL").groupBy("key").agg(F.min("n").alias("first"))
    edges = numbered.join(first, "key").select(F.col("n").alias("a"), F.col("first").alias("b"))
    labels = components(edges)
    ids = rows.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col)).alias("n"))
    placed = ids.join(labels, ids["n"] == labels["node"], "left").select("id", F.coalesce("label", "n").alias("label"))
    least = placed.groupBy("label").agg(F.min("id").alias("least"))
    return placed.join(least, "label").select(F.col("id").alias(id_col), F.col("least").alias("label"))


def component_table(members: DataFrame, id_col: str = "orbit_id", label_col: str = "label", prefix: str = "component_") -> DataFrame:
    """component_id (digest of the sorted members), size and members of each component."""
    grouped = members.groupBy(label_col).agg(F.array_sort(F.collect_set(id_col)).alias("members"))
    name = F.concat(F.lit(prefix), F.substring(F.sha2(F.array_join("members", "\n"), 256), 1, 20))
    return grouped.select(label_col, name.alias("component_id"), F.size("members").alias("size"), "members")
