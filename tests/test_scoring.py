import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import audits, comparison, probes, scoring


def gold(spark, orbits):
    rows = [(f"{o}::{s}", o, s, ["the north", "north"], [6] if s == "M" else [6, 10], s != "M") for o in orbits for s in "CDM"]
    return spark.createDataFrame(rows, "id string, orbit_id string, state string, answers array<string>, support array<int>, answerable boolean")


YES, NO = "S | evidence=[P06,P10] | answer=North", "U | evidence=[] | answer=INSUFFICIENT_EVIDENCE"


def said(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, prediction string")


def test_orbit_and_state_scores(spark):
    p = said(spark, ("o1::C", YES), ("o1::D", YES), ("o1::M", NO), ("o2::C", YES), ("o2::D", NO), ("o2::M", YES))
    out = scoring.evaluate(gold(spark, ["o1", "o2"]), p)
    states = {r["state"]: r for r in out["state_summary"].collect()}
    assert states["C"]["answer_f1"] == 1.0 and states["D"]["answer_f1"] == 0.5 and states["M"]["answer_f1"] is None and states["M"]["false_refusal_rate"] is None
    m = out["orbit_means"].first()
    assert (m["orbits"], m["cd_min_f1"], m["orbit_answer_suff_f1"], m["orbit_support_suff_f1"], m["false_refusal_rate"], m["m_refusal_rate"]) == (2, 0.5, 0.5, 0.5, 0.25, 0.5)


def test_an_invalid_line_scores_nothing_and_is_no_refusal(spark):
    p = said(spark, ("o1::C", "no line"), ("o1::D", YES), ("o1::M", "U | evidence=[] | answer=x"))
    m = scoring.evaluate(gold(spark, ["o1"]), p)["orbit_means"].first()
    assert m["c_answer_f1"] == 0 and m["orbit_answer_suff_f1"] == 0 and m["m_refusal_rate"] == 0 and abs(m["parse_rate"] - 1 / 3) < 1e-12


def test_alignment_is_total(spark):
    g = gold(spark, ["o1"])
    for rows in ([("o1::C", YES), ("o1::D", YES)], [("o1::C", YES), ("o1::D", YES), ("o1::M", NO), ("o2::C", YES)], [("o1::C", YES), ("o1::C", YES), ("o1::D", YES), ("o1::M", NO)]):
        with pytest.raises(ValueError):
            scoring.check_alignment(g, said(spark, *rows))
    with pytest.raises(ValueError):
        scoring.check_alignment(g, said(spark, ("o1::C", YES)).withColumn("note", F.lit(1)))
    with pytest.raises(ValueError):
        scoring.check_orbits(g.where("state <> 'D'"))


def arms(spark, change):
    base = {m: 0.5 for m in comparison.METRICS} | {"c_answer_f1": 0.7, "false_refusal_rate": 0.05, "m_refusal_rate": 0.8, "orbit_support_suff_f1": 0.65, "parse_rate": 1.0}
    rows = []
    for arm in (0, 1):
        one = []
        for i in range(20):
            v = dict(base) | {m: base[m] + 0.05 * (i % 2) for m in ("cd_min_f1", "orbit_answer_suff_f1", "d_answer_f1")}
            if arm:
                v = {k: x + (0.1 if k in ("cd_min_f1", "orbit_answer_suff_f1", "d_answer_f1", "m_refusal_rate") else 0) for k, x in v.items()} | change
            one.append((f"o{i:02d}", *[float(v[m]) for m in comparison.METRICS]))
        rows.append(spark.createDataFrame(one, "orbit_id string, " + ", ".join(f"{m} double" for m in comparison.METRICS)))
    return rows


@pytest.mark.parametrize(("change", "want"), [({}, "GO"), ({"parse_rate": 0.98}, "STOP")])
def test_gates(spark, change, want):
    rows = comparison.paired(*arms(spark, change))
    intervals = comparison.bootstrap(rows)
    got = comparison.decision(comparison.gates(intervals, {"same_data": True})).first()
    assert got["decision"] == want and got["passed"] == (9 if want == "GO" else 8)


def test_bootstrap_repeats_numpy_and_needs_equal_orbits(spark):
    a, b = arms(spark, {})
    got = {r["metric"]: r for r in comparison.bootstrap(comparison.paired(a, b)).collect()}["cd_min_f1"]
    assert abs(got["delta"] - 0.1) < 1e-12 and abs(got["ci_low"] - 0.1) < 1e-9
    with pytest.raises(ValueError):
        comparison.paired(a, b.where("orbit_id <> 'o03'"))


def test_integrity_counts_only_what_is_there():
    assert comparison.integrity({"sha": 1}, {"sha": 1}, ("sha",)) == {"same_sha": True}
    assert comparison.integrity({}, {}, ("sha",)) == {"same_sha": False}


def test_auc_and_logistic_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2)).round(1)
    state = ["C" if i % 2 else "D" for i in range(60)]
    x[1::2] += 0.7
    rows = [(f"r{i:02d}", f"g{i // 2:02d}", state[i], "train", [float(v) for v in x[i]]) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, group string, state string, split string, features array<double>")
    got = probes.oof_scores(df, "seed").where("pair = 'C-D'").toPandas().set_index("id")
    y = np.array([s == "D" for s in state], float)
    for fold in range(5):
        held = np.array([got.loc[f"r{i:02d}", "fold"] == fold for i in range(60)])
        mean, scale = x[~held].mean(axis=0), x[~held].std(axis=0)
        z, w = np.column_stack([(x - mean) / scale, np.ones(60)]), np.zeros(3)
        own, rest = z[~held], y[~held]
        for _ in range(4000):  # plain descent to the same optimum
            p = 1 / (1 + np.exp(-(own @ w)))
            w -= 0.02 * (own.T @ (p - rest) + w)
        want = 1 / (1 + np.exp(-(z[held] @ w)))
        assert np.allclose(want, [got.loc[f"r{i:02d}", "score"] for i in np.flatnonzero(held)], atol=1e-6)
    s, label = got["score"].to_numpy(), got["label"].to_numpy()
    pairs = [(a > b) + 0.5 * (a == b) for a in s[label == 1] for b in s[label == 0]]
    auc = probes.auc(spark.createDataFrame(got.reset_index()), "pair").first()
    assert abs(auc["auc"] - np.mean(pairs)) < 1e-12
    assert (got.groupby(got.index.map(lambda i: int(i[1:]) // 2))["fold"].nunique() == 1).all()


def test_schedule_triples_and_ledger(spark):
    ids = spark.createDataFrame([(f"o{i:03d}",) for i in range(24)], "orbit_id string")
    plan = audits.schedule(ids)
    assert [tuple(r) for r in plan.orderBy("rank").collect()] == [tuple(r) for r in audits.schedule(ids.orderBy(F.desc("orbit_id"))).orderBy("rank").collect()]
    assert [r["count"] for r in plan.groupBy("batch").count().collect()] == [8, 8, 8]
    sha = {r["batch"]: r["orbit_batch_sha256"] for r in audits.batch_digests(plan).collect()}
    rate = lambda s: 2e-4 * s / 8 if s < 8 else 0.0
    rows = [(s, 8 * s, sha[s - 1], rate(s - 1), 1.0, True) for s in (1, 2, 3)]
    schema = "optimizer_step long, consumed_orbits long, orbit_batch_sha256 string, learning_rate_applied double, grad_norm double, finite boolean"
    check = lambda rows: sorted(tuple(r) for r in audits.ledger_faults(spark.createDataFrame(rows, schema), plan, steps=3).collect())
    assert check([(s, n, h, 2e-4 * (s - 1) / 8, g, f) for s, n, h, _, g, f in rows]) == []
    bad = [(1, 8, "0" * 64, 0.0, 1.0, True), (2, 16, sha[1], 2e-4 / 8, float("nan"), True), (3, 24, sha[2], 2e-4 / 4, 1.0, False)]
    assert check(bad) == [(1, "batch_differs"), (2, "not_finite"), (3, "flag_false")]
    triple = [(f"a::{s}", "a", s, i, "train", True, False) for i, s in enumerate("CDM")] + [(f"b::{s}", "b", s, 3 + i, "train", True, False) for i, s in enumerate("CCM")]
    assert [r["orbit_id"] for r in audits.triples(spark.createDataFrame(triple, "id string, orbit_id string, state string, place int, split string, training_read_allowed boolean, sealed boolean")).collect()] == ["b"]
