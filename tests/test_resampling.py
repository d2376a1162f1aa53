"""Exact resampling against numpy's bootstrap and against what a multinomial must satisfy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodeframe.functions import resampling, statistics


def units(spark, copies):
    return spark.createDataFrame([(str(i), c, float(i)) for i, c in enumerate(copies)], "unit string, copies long, v double")


def test_every_round_draws_n_rows_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 16)
    rows = units(spark, [1 + i % 3 for i in range(300)])
    one = resampling.resampled(rows, 50, 7, ("v",)).orderBy("round").collect()
    two = resampling.resampled(rows.repartition(9), 50, 7, ("v",)).orderBy("round").collect()
    assert [r.drawn for r in one] == [600] * 50
    assert [r.v for r in one] == pytest.approx([r.v for r in two]) and len({r.v for r in one}) > 40
    assert [r.v for r in one] != [r.v for r in resampling.resampled(rows, 50, 8, ("v",)).orderBy("round").collect()]


def test_blocks_share_out_all_draws():
    sizes = np.array([5, 0, 17, 3, 3, 40, 1])
    drawn = np.stack([resampling.block_draws(sizes, b, 69, 4000, 3) for b in range(7)])
    assert (drawn.sum(axis=0) == 69).all() and (drawn[1] == 0).all()
    # a block's draws are Binomial(69, size / 69), and two blocks' covariance is -n p q
    assert drawn.mean(axis=1) == pytest.approx(sizes, abs=0.25)
    assert drawn.var(axis=1) == pytest.approx(sizes * (1 - sizes / 69), rel=0.1)
    assert np.cov(drawn[2], drawn[5])[0, 1] == pytest.approx(-17 * 40 / 69, rel=0.15)


def test_rows_of_a_block_share_out_its_draws():
    weights = np.arange(1.0, 301.0)
    counts = np.array([0, 10, 5000])
    parts = list(resampling.dealt(counts, weights, np.random.default_rng(1)))
    times = np.concatenate([t for _, t in parts], axis=1)
    assert [s for s, _ in parts][0].start == 0 and times.shape == (3, 300) and times.sum(axis=1).tolist() == [0, 10, 5000]
    assert times[2] @ weights / 5000 == pytest.approx((weights**2).sum() / weights.sum(), rel=0.05)


def test_intervals_are_those_of_a_bootstrap(spark):
    rng = np.random.default_rng(2)
    a, b = rng.exponential(size=500), rng.normal(1.5, 2, 300)
    frame = lambda x: spark.createDataFrame([(float(v),) for v in x], "v double")
    draw = lambda x: x[rng.integers(0, len(x), (10_000, len(x)))].mean(axis=1)
    one = statistics.mean_interval(frame(a), "v").first()
    low, high = np.quantile(draw(a), [0.025, 0.975])
    assert (one.n, one.mean) == (500, pytest.approx(a.mean())) and one.low == pytest.approx(low, abs=0.01) and one.high == pytest.approx(high, abs=0.01)
    two = statistics.delta_interval(frame(a), frame(b), "v").first()
    deltas = np.sort(draw(b) - draw(a))
    assert two.delta == pytest.approx(b.mean() - a.mean()) and two.low == pytest.approx(deltas[250], abs=0.03) and two.high == pytest.approx(deltas[9749], abs=0.03)
    assert statistics.delta_rounds(frame(a), frame(b), "v", 20).select("drawn_before", "drawn_after").distinct().collect() == [(500, 300)]


def test_cluster_interval_is_that_of_a_bootstrap_over_keys(spark):
    rng = np.random.default_rng(5)
    n = rng.integers(5, 30, (2, 12))
    wins = rng.binomial(n, [[0.3], [0.5]])
    side = lambda j: spark.createDataFrame([(s, bool(i < wins[j, s])) for s in range(12) for i in range(n[j, s])], "seed long, won boolean")
    rounds = statistics.cluster_rounds(side(0), side(1), "seed").collect()
    assert {r.drawn for r in rounds} == {12} and len(rounds) == 10_000
    picked = rng.integers(0, 12, (10_000, 12))
    rate = [rng.binomial(n[j][picked], (wins[j] / n[j])[picked]).sum(axis=1) / n[j][picked].sum(axis=1) for j in (0, 1)]
    low, high = np.quantile(rate[1] - rate[0], [0.025, 0.975])
    got = statistics.cluster_interval(side(0), side(1), "seed").first()
    assert got.low == pytest.approx(low, abs=0.015) and got.high == pytest.approx(high, abs=0.015)


def test_no_rows_nulls_and_one_value(spark):
    rows = spark.createDataFrame([(1.0,), (None,), (1.0,)], "v double")
    assert statistics.mean_interval(rows, "v", 100).first() == (2, 1.0, 1.0, 1.0)
    nothing = statistics.mean_interval(rows.where("false"), "v", 100).first()
    assert (nothing.n, nothing.mean, nothing.low) == (0, None, None)
    assert resampling.resampled_means(rows, "v", 5, 1).agg(F.sum("drawn")).first()[0] == 10
