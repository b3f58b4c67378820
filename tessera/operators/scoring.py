"""Predictions against gold: a total one-to-one alignment, state scores, orbit scores and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import STATES, best_answer, parse_prediction, support_scores

PREDICTION = ("arm_id", "dataset_manifest_sha256", "id", "prediction")
# Metrics of a state.
METRICS = ("parse_rate", "answer_em", "answer_f1", "support_em", "support_f1", "answerability_accuracy", "refusal_rate")


def alignment(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row: gold, matched, missing and extra ids, repeated ids on either side, and the first five of each kind."""
    g = gold.groupBy("id").agg(F.count("*").alias("g"))
    p = predictions.groupBy("id").agg(F.count("*").alias("p"))
    both = g.join(p, "id", "full_outer")
    first = lambda cond, name: F.slice(F.array_sort(F.collect_set(F.when(cond, F.col("id")))), 1, 5).alias(name)
    return both.agg(
        F.count("g").alias("gold_ids"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("matched"), F.count_if(F.col("p").isNull()).alias("missing"), F.count_if(F.col("g").isNull()).alias("extra"),
        F.count_if(F.col("g") > 1).alias("repeated_gold"), F.count_if(F.col("p") > 1).alias("repeated_predictions"), first(F.col("p").isNull(), "first_missing"), first(F.col("g").isNull(), "first_extra"),
    )


def check_alignment(gold: DataFrame, predictions: DataFrame) -> None:
    """Raises unless predictions have just the known columns and answer every gold id once."""
    odd = set(predictions.columns) - set(PREDICTION)
    if odd or not {"id", "prediction"} <= set(predictions.columns):
        raise ValueError(f"prediction columns are wrong: {sorted(odd)}")
    a = alignment(gold, predictions).first()
    if not a["gold_ids"]:
        raise ValueError("the evaluation set is empty")
    if a["missing"] or a["extra"] or a["repeated_gold"] or a["repeated_predictions"]:
        raise ValueError(f"ids do not align: {a.asDict()}")


def check_orbits(gold: DataFrame) -> None:
    """Raises unless every orbit is exactly C, D, M with answerable true, true, false."""
    want = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(s != "M").alias("answerable")) for s in STATES])
    got = gold.groupBy("orbit_id").agg(F.array_sort(F.collect_list(F.struct("state", "answerable"))).alias("s"))
    bad = got.where(F.col("s") != want).select("orbit_id").take(5)
    if bad:
        raise ValueError(f"orbits are not C, D, M: {[r[0] for r in bad]}")


def score_states(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per id. Answer and support metrics are null for unanswerable rows, not 0; an invalid line answers ''."""
    rows = gold.join(predictions.select("id", "prediction"), "id").withColumn("r", parse_prediction(F.col("prediction")))
    says = F.when(F.col("r.valid"), F.col("r.status") == "S")
    answer = F.when(F.col("answerable"), best_answer(F.col("r.answer"), F.col("answers")))
    support = F.when(F.col("answerable"), support_scores(F.col("r.support"), F.col("support")))
    rows = rows.withColumn("a", answer).withColumn("s", support)
    return rows.select(
        "id", "orbit_id", "state", F.col("r.valid").cast("double").alias("parse_valid"), F.col("a.em").alias("answer_em"), F.col("a.f1").alias("answer_f1"), F.col("s.em").alias("support_em"), F.col("s.f1").alias("support_f1"),
        says.alias("predicted_answerable"), F.coalesce((says == F.col("answerable")).cast("double"), F.lit(0.0)).alias("answerability_correct"), F.coalesce((~says).cast("double"), F.lit(0.0)).alias("refusal"), F.col("r.error").alias("error"),
    )


def state_summary(scores: DataFrame) -> DataFrame:
    """Means per state over the rows that have the metric; false refusals only where refusing is wrong."""
    return scores.groupBy("state").agg(
        F.count("*").alias("count"), F.avg("parse_valid").alias("parse_rate"), *[F.avg(c).alias(c) for c in ("answer_em", "answer_f1", "support_em", "support_f1")],
        F.avg("answerability_correct").alias("answerability_accuracy"), F.avg("refusal").alias("refusal_rate"), F.avg(F.when(F.col("state") != "M", F.col("refusal"))).alias("false_refusal_rate"),
    )


def orbit_scores(scores: DataFrame) -> DataFrame:
    """One row per orbit; sufficiency counts an answer only if the answerable state was answered and M validly refused."""
    one = F.first(F.struct("parse_valid", "answer_f1", "support_f1", "predicted_answerable", "refusal"))
    by = scores.groupBy("orbit_id").pivot("state", list(STATES)).agg(one)
    no = F.coalesce(~F.col("M.predicted_answerable"), F.lit(False))
    cm, dm = (F.coalesce(F.col(f"{s}.predicted_answerable"), F.lit(False)) & no for s in "CD")
    worst = lambda f: F.least(f"C.{f}", f"D.{f}")
    only = lambda ok, x: F.when(ok, x).otherwise(0.0)
    return by.select(
        "orbit_id", F.col("C.answer_f1").alias("c_answer_f1"), F.col("D.answer_f1").alias("d_answer_f1"), F.col("C.support_f1").alias("c_support_f1"), F.col("D.support_f1").alias("d_support_f1"),
        worst("answer_f1").alias("cd_min_f1"), worst("support_f1").alias("cd_min_support_f1"), only(cm, F.col("C.answer_f1")).alias("cm_answer_suff_f1"), only(dm, F.col("D.answer_f1")).alias("dm_answer_suff_f1"),
        only(cm, F.col("C.support_f1")).alias("cm_support_suff_f1"), only(dm, F.col("D.support_f1")).alias("dm_support_suff_f1"), only(cm & dm, worst("answer_f1")).alias("orbit_answer_suff_f1"), only(cm & dm, worst("support_f1")).alias("orbit_support_suff_f1"),
        ((F.col("C.refusal") + F.col("D.refusal")) / 2).alias("false_refusal_rate"), F.col("M.refusal").alias("m_refusal_rate"), ((F.col("C.parse_valid") + F.col("D.parse_valid") + F.col("M.parse_valid")) / 3).alias("parse_rate"),
    )


def orbit_means(orbits: DataFrame) -> DataFrame:
    return orbits.agg(F.count("*").alias("orbits"), *[F.avg(c).alias(c) for c in orbits.columns if c != "orbit_id"])


def evaluate(gold: DataFrame, predictions: DataFrame) -> dict[str, DataFrame]:
    """states, orbits and their summaries, after the checks."""
    check_alignment(gold, predictions)
    check_orbits(gold)
    scores = score_states(gold, predictions)
    orbits = orbit_scores(scores)
    return {"states": scores, "state_summary": state_summary(scores), "orbits": orbits, "orbit_means": orbit_means(orbits)}
