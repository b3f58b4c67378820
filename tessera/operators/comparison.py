"""Two arms compared orbit by orbit: paired bootstrap intervals, gates, one decision."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.digest import joined_sha, mod_pair

# The draw, and the gates in order.
SAMPLES, SEED, CHUNK = 10_000, 20260814, 512
METRICS = ("cd_min_f1", "orbit_answer_suff_f1", "d_answer_f1", "c_answer_f1", "false_refusal_rate", "m_refusal_rate", "orbit_support_suff_f1", "parse_rate")
GATES = (
    ("cd_min_f1_gain", "cd_min_f1", "delta >= 0.04 AND ci_low > 0"),
    ("orbit_answer_suff_gain", "orbit_answer_suff_f1", "delta >= 0.04 AND ci_low > 0"),
    ("d_answer_f1_gain", "d_answer_f1", "delta >= 0.04"),
    ("c_answer_f1_noninferiority", "c_answer_f1", "delta >= -0.02"),
    ("false_refusal_noninferiority", "false_refusal_rate", "delta <= 0.02"),
    ("m_refusal", "m_refusal_rate", "delta >= 0 AND treatment >= 0.80"),
    ("orbit_support_suff_noninferiority", "orbit_support_suff_f1", "delta >= -0.02"),
    ("parse_rate", "parse_rate", "treatment >= 0.99"),
)


def paired(control: DataFrame, treatment: DataFrame, metrics=METRICS) -> DataFrame:
    """(metric, orbit_id, control, treatment) in long form; raises unless both arms have the same orbits."""
    long = lambda df, name: df.select("orbit_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*metrics))).alias("metric", name))
    both = long(control, "control").join(long(treatment, "treatment"), ["orbit_id", "metric"], "full_outer")
    n, bad = both.agg(F.count("*"), F.count_if(F.col("control").isNull() | F.col("treatment").isNull())).first()
    if bad or not n:
        raise ValueError("the arms do not have the same orbits")
    return both


def _interval(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("orbit_id")
    delta = (pdf["treatment"] - pdf["control"]).to_numpy()
    rng, n, done, means = np.random.default_rng(SEED), len(delta), 0, []
    while done < SAMPLES:
        k = min(CHUNK, SAMPLES - done)
        means.append(delta[rng.integers(0, n, size=(k, n))].mean(axis=1))
        done += k
    low, high = np.quantile(np.concatenate(means), [0.025, 0.975])
    return pd.DataFrame({"metric": [pdf["metric"].iloc[0]], "control": [pdf["control"].mean()], "treatment": [pdf["treatment"].mean()], "delta": [delta.mean()], "ci_low": [low], "ci_high": [high]})


def bootstrap(rows: DataFrame) -> DataFrame:
    """Exact stream: 10,000 resamples of the orbits' differences by one generator per metric (a group of one metric has
    one row per evaluated orbit, a set that people judge, and is what the generator needs at once)."""
    return rows.groupBy("metric").applyInPandas(_interval, "metric string, control double, treatment double, delta double, ci_low double, ci_high double")


def digest_bootstrap(rows: DataFrame, samples: int = SAMPLES, unit: str = "orbit_id", seed: str = str(SEED)) -> DataFrame:
    """Another stream that any engine can repeat: draw i of resample b is the unit whose place is a digest modulo n.

    With a coarser unit (a component) whole groups are drawn and the statistic stays a mean over orbits."""
    sums = rows.groupBy("metric", unit).agg(F.sum(F.col("treatment") - F.col("control")).alias("d"), F.count("*").alias("k"))
    lists = sums.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct(F.col(unit).alias("u"), "d", "k"))).alias("l"))
    draw = lists.select("metric", "l", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("b"))
    places = F.transform(F.sequence(F.lit(0), F.size("l") - 1), lambda i: F.get(F.col("l"), mod_pair(joined_sha(seed, F.col("b"), i), F.size("l"))["rest"].cast("int")))
    fold = lambda f: F.aggregate("p", F.lit(0.0), lambda s, x: s + x[f])
    means = draw.select("metric", places.alias("p")).select("metric", (fold("d") / fold("k")).alias("m"))
    ci = means.groupBy("metric").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    point = rows.groupBy("metric").agg(F.avg("control").alias("control"), F.avg("treatment").alias("treatment"), F.avg(F.col("treatment") - F.col("control")).alias("delta"))
    return point.join(ci, "metric").select("metric", "control", "treatment", "delta", F.get("q", F.lit(0)).alias("ci_low"), F.get("q", F.lit(1)).alias("ci_high"))


def gates(intervals: DataFrame, integrity: Mapping[str, bool]) -> DataFrame:
    """(gate, rule, passed), the integrity of the runs last."""
    spark = intervals.sparkSession
    by = None
    for i, (name, metric, rule) in enumerate(GATES):
        one = intervals.where(F.col("metric") == metric).select(F.lit(i).alias("place"), F.lit(name).alias("gate"), F.lit(rule).alias("rule"), F.expr(rule).alias("passed"))
        by = one if by is None else by.unionByName(one)
    last = spark.range(1).select(F.lit(len(GATES)).alias("place"), F.lit("run_integrity").alias("gate"), F.lit("all checks true").alias("rule"), F.lit(bool(integrity) and all(v is True for v in integrity.values())).alias("passed"))
    return by.unionByName(last)


def decision(gate_rows: DataFrame) -> DataFrame:
    whole = F.count("*") == len(GATES) + 1
    return gate_rows.agg(F.count_if("passed").alias("passed"), F.count("*").alias("gates"), F.when(whole & (F.count_if("passed") == F.count("*")), "GO").otherwise("STOP").alias("decision"))


def integrity(control: Mapping, treatment: Mapping, same: tuple[str, ...], other: tuple[str, ...] = ()) -> dict[str, bool]:
    """Named checks on the bindings of two runs: fields that must be there and equal, and fields that must differ."""
    checks = {f"same_{k}": k in control and control.get(k) == treatment.get(k) for k in same}
    return checks | {f"other_{k}": k in control and k in treatment and control[k] != treatment[k] for k in other}
