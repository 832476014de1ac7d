"""Posterior width and evidence of the mean of all event values, against the closed form."""

from __future__ import annotations

import numpy as np
import pytest

from dendrolith.plans import numeric

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def exact(spark):
    y = np.log(spark.read.parquet(f"{SF}/events.parquet").toPandas().value.to_numpy())
    n, m, s = len(y), y.mean(), y.std(ddof=1)
    best = -0.5 * ((y - m) ** 2).sum() / s**2 - n * np.log(s) - 0.5 * n * np.log(2 * np.pi)
    spread = 100 + s**2 / n
    return best + 0.5 * np.log(2 * np.pi * s**2 / n) - 0.5 * m**2 / spread - 0.5 * np.log(2 * np.pi * spread), m, s / np.sqrt(n), n


def test_evidence_counts_all_rows(spark, exact):
    log_z, _, _, n = exact
    assert n > 100
    got = numeric.nested_sampling(spark, SF).first()
    assert abs(got["log_z"] - log_z) < 4 * got["error"] + 0.1
    assert max(r["bound"] for r in numeric.variational_race(spark, SF).collect()) == pytest.approx(log_z, abs=0.5)


def test_posterior_width_follows_all_rows(spark, exact):
    _, m, error, _ = exact
    cold = numeric.tempered_mcmc(spark, SF).where("beta = 1 and iter >= 200").toPandas().x.map(lambda x: x[0])
    assert cold.mean() == pytest.approx(m, abs=error)
    assert cold.std() == pytest.approx(error, rel=0.35)
