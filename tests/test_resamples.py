"""The registered exact bootstrap against numpy, and the number of resamples that is the default."""

import inspect

import numpy as np

from tessera.operators import comparison
from tessera.plans import catalogue


def test_exact_bootstrap_draws_all_resamples(spark, monkeypatch):
    rng = np.random.default_rng(6)
    values = rng.normal(0.02, 0.1, 30)
    rows = spark.createDataFrame([("balance", f"o{i:02d}", 0.0, float(v)) for i, v in enumerate(values)], "metric string, orbit_id string, control double, treatment double")
    monkeypatch.setattr(catalogue, "arm_rows", lambda spark, sf: rows)
    got = catalogue.QUERIES["q40_exact_bootstrap"](spark, "").first()
    draws = np.random.default_rng(20260814)
    means = np.concatenate([values[draws.integers(0, 30, size=(min(512, 10_000 - lo), 30))].mean(axis=1) for lo in range(0, 10_000, 512)])
    assert np.allclose([got["ci_low"], got["ci_high"]], np.quantile(means, [0.025, 0.975]), atol=1e-8)
    assert inspect.signature(comparison.digest_bootstrap).parameters["samples"].default == 10_000
