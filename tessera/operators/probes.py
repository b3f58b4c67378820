"""Can states be told apart from features alone? Out-of-fold logistic probes and exact AUC."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import stable_folds
from tessera.plans.lineage import cut

PAIRS = (("C", "D"), ("D", "M"), ("C", "M"))


def _moments(weights: dict[tuple[str, int], np.ndarray], width: int):
    """Per (pair, held-out fold) and partition: sums for the scaling (without weights) or for a Newton step."""

    def run(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, width)
            y, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            pair = np.array(batch.column("pair").to_pylist(), object)
            for (name, held), w in weights.items():
                on = (pair == name) & (fold != held)
                if not on.any():
                    continue
                if w is None:
                    part = np.concatenate([[on.sum()], x[on].sum(axis=0), (x[on] ** 2).sum(axis=0)])
                else:
                    z = np.column_stack([(x[on] - w[0]) / w[1], np.ones(int(on.sum()))])
                    p = 1 / (1 + np.exp(-np.clip(z @ w[2], -500, 500)))
                    part = np.concatenate([z.T @ (p - y[on]), ((z.T * (p * (1 - p))) @ z).ravel()])
                sums[name, held] = sums.get((name, held), 0) + part
        if sums:
            yield pa.record_batch({"pair": pa.array([k[0] for k in sums]), "held": pa.array([k[1] for k in sums], pa.int32()), "s": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    return run


def _add(table: pa.Table) -> pa.Table:
    s = np.sum([np.array(v) for v in table.column("s").to_pylist()], axis=0)
    return pa.table({"pair": table.column("pair")[:1], "held": table.column("held")[:1], "s": pa.array([s.tolist()], pa.list_(pa.float64()))})


def _summed(rows: DataFrame, weights: dict, width: int) -> dict[tuple[str, int], np.ndarray]:
    """One vector per model reaches the driver, whatever the number of rows."""
    schema = "pair string, held int, s array<double>"
    out = rows.mapInArrow(_moments(weights, width), schema).groupBy("pair", "held").applyInArrow(_add, schema)
    return {(r["pair"], r["held"]): np.array(r["s"]) for r in out.collect()}


def oof_scores(rows: DataFrame, seed: str, folds: int = 5, c: float = 1.0, steps: int = 25) -> DataFrame:
    """Held-out scores for each pair of states. rows: id, group (all its rows share a fold), state, features, split.

    Rows of the sealed split are left out. All models step together: a Newton step is one pass in which partitions
    add up gradients and Hessians. The intercept is penalized like the weights, the scale is the population's."""
    usable = rows.where("split <> 'shadow'")
    usable = usable.join(stable_folds(usable, "group", seed, folds), "group")
    made = F.array(*[F.when(F.col("state").isin(a, b), F.struct(F.lit(f"{a}-{b}").alias("pair"), (F.col("state") == b).cast("int").alias("label"))) for a, b in PAIRS])
    flat = cut(usable.withColumn("k", F.explode(F.filter(made, lambda k: k.isNotNull()))).select("k.pair", "k.label", F.col("id").cast("string").alias("id"), "fold", F.col("features").cast("array<double>").alias("features")), "features")
    found = flat.groupBy("pair").agg(F.max(F.size("features")).alias("width"), F.count_distinct("fold").alias("folds")).collect()
    if not found:
        return flat.select("pair", "id", "fold", "label", F.lit(0.0).alias("score"))
    if any(r["folds"] < 2 for r in found):
        raise ValueError("one fold holds every row")
    width = found[0]["width"]
    models: dict[tuple[str, int], list] = {}
    for key, s in _summed(flat, {(r["pair"], k): None for r in found for k in range(folds)}, width).items():
        mean = s[1 : width + 1] / s[0]
        scale = np.sqrt(np.maximum(s[width + 1 :] / s[0] - mean**2, 0))
        models[key] = [mean, np.where(scale < 1e-12, 1, scale), np.zeros(width + 1)]
    for _ in range(steps):
        most = 0.0
        for key, s in _summed(flat, models, width).items():
            w = models[key][2]
            step = np.linalg.solve(c * s[width + 1 :].reshape(width + 1, -1) + np.eye(width + 1), c * s[: width + 1] + w)
            models[key][2] = w - step
            most = max(most, np.abs(step).max())
        if most < 1e-8:
            break

    def score(batches):
        for batch in batches:
            x = batch.column("features").flatten().to_numpy().reshape(-1, width)
            out = np.zeros(len(x))
            pair, fold = np.array(batch.column("pair").to_pylist(), object), batch.column("fold").to_numpy()
            for (name, held), (mean, scale, w) in models.items():
                on = (pair == name) & (fold == held)
                out[on] = 1 / (1 + np.exp(-np.clip(((x[on] - mean) / scale) @ w[:-1] + w[-1], -500, 500)))
            yield pa.record_batch({**{k: batch.column(k) for k in ("pair", "id", "fold", "label")}, "score": pa.array(out)})

    return flat.mapInArrow(score, "pair string, id string, fold int, label int, score double")


def auc(scores: DataFrame, *by: str, label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under the curve with ties as halves, from counts per distinct score; null without both labels."""
    counts = scores.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = counts.withColumn("under", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    out = below.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return out.withColumn("separability", F.greatest("auc", 1 - F.col("auc")))


def separability_gate(aucs: DataFrame, ceiling: float = 0.60) -> DataFrame:
    return aucs.withColumn("passed", F.col("separability") <= ceiling)
