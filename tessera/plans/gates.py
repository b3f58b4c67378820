"""Release decisions: named checks that hold only if they are literally true."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.records import SEALED_SPLIT
from tessera.operators.splits import overlap_counts


class Checks(dict):
    def add(self, name: str, value: object) -> None:
        self[name] = value is True

    @property
    def decision(self) -> str:
        return "READY" if self and all(self.values()) else "HOLD"


def release_checks(records: DataFrame, orbits: DataFrame, invariants: DataFrame, lengths: DataFrame, aucs: DataFrame, targets: Mapping[str, int], ratio: float = 1.25, ceiling: float = 0.60, gated_semantic: tuple[str, ...] = ("C-D",), semantic: DataFrame | None = None) -> Checks:
    """Every count is taken from the data: split sizes, key overlap, construction rules, sealed rows, lengths, probes."""
    checks = Checks()
    sizes = {r["split"]: (r["orbits"], r["records"]) for r in records.groupBy("split").agg(F.count_distinct("orbit_id").alias("orbits"), F.count("*").alias("records")).collect()}
    for split, n in targets.items():
        checks.add(f"{split}_orbits", sizes.get(split, (0, 0))[0] == n)
        checks.add(f"{split}_records", sizes.get(split, (0, 0))[1] == 3 * n)
    checks.add("no_shared_keys", overlap_counts(orbits).isEmpty())
    row = invariants.first().asDict()
    for name, n in row.items():
        if name != "orbits":
            checks.add(name, n == row["orbits"] == sum(targets.values()))
    closed = records.agg(F.count_if((F.col("split") == SEALED_SPLIT) != F.col("sealed")).alias("a"), F.count_if(F.col("sealed") == F.col("training_read_allowed")).alias("b")).first()
    checks.add("sealed_flags", closed["a"] == 0 and closed["b"] == 0)
    checks.add("no_text_over_limit", lengths.agg(F.sum("over_limit")).first()[0] == 0)
    for r in aucs.collect():
        checks.add(f"surface_{r['pair']}", r["separability"] <= ceiling)
    for r in semantic.collect() if semantic is not None else ():
        if r["pair"] in gated_semantic:
            checks.add(f"semantic_{r['pair']}", r["separability"] <= ceiling)
    return checks


def body_faults(gold: DataFrame, predictions: DataFrame, rows: int) -> dict[str, bool]:
    """Checks of a production body: number of rows, ids in the same order (column place), one prediction each."""
    both = gold.select("place", F.col("id").alias("g")).join(predictions.select("place", F.col("id").alias("p")), "place", "full_outer")
    a = both.agg(F.count("*").alias("n"), F.count_if(~F.col("g").eqNullSafe(F.col("p"))).alias("off"), F.count_distinct("g").alias("ids")).first()
    return {"rows": a["n"] == rows, "order": a["off"] == 0, "unique": a["ids"] == rows}


def same_report(saved: Mapping, fresh: Mapping) -> bool:
    """A saved report counts only if computing it again gives the same."""
    from tessera.functions.digest import canonical_sha

    return canonical_sha(dict(saved)) == canonical_sha(dict(fresh))
