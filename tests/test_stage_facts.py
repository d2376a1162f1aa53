"""Many runs folded together from facts that Spark finds, against the plain step of every run."""

import random

import pytest

from episodeframe.streaming import stages
from episodeframe.streaming.stages import Machine, Plan

PLAN = Plan(pilot_updates=2, adaptive_updates=4, probe_every=2)
IDS = ("a", "Z", "é", "\U00010400", "￿")
COLUMNS = ("kind", "state_id", "env_step", "samples", "successes", "mean_reward", "mean_pellets", "variance")


def odd_updates(runs):
    """Rates at the range's ends, no samples, ties, ids beyond ASCII, variances that are no number."""
    rng, out = random.Random(5), []
    for run in runs:
        for version in range(8):
            frontier = [("frontier", s, rng.choice((0, 3, 9)), rng.choice((0, 12, 24, 40)), rng.randrange(29), 0.0, 0.0, 0.0) for s in IDS if rng.random() < 0.8]
            pilots = [("pilot", s[1], s[2], 24, rng.randrange(6) if version == 0 else rng.randrange(12, 25), rng.choice((0.0, 0.5, 1.0)), 0.0, rng.choice((0.0, 0.25))) for s in [(None, x, 3) for x in IDS]]
            starts = [("start", f"t{i}", 0, rng.choice((0, 24)), rng.randrange(8 if version == 0 else 25), 0.0, 0.0, 0.0) for i in range(rng.randrange(3))]
            told = starts + frontier + pilots
            rng.shuffle(told)
            out.append((run, version, rng.choice((0, 2)), rng.choice((0.1, 1e-13, float("nan"))), told))
    return out


def plainly(updates):
    machines, out = {}, []
    for run, version, count, variance, told in updates:
        found = machines.setdefault(run, Machine()).step(PLAN, version, count, variance, [dict(zip(COLUMNS, s, strict=True)) for s in told])
        out += [] if found is None else [(run, version, *found)]
    return sorted(out)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_table_of_runs_carried_over_batches(spark, small_batches):
    updates = odd_updates(range(-30, 370))
    want = plainly(updates)
    table = spark.createDataFrame(random.Random(6).sample(updates, len(updates)), stages.UPDATE)
    found = stages.fold(table, PLAN)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()  # no call for each run
    assert sorted(map(tuple, found.collect())) == want
    assert len({r[3] for r in want}) == 8  # every event of this plan


def test_a_stream_whose_runs_share_states(spark, tmp_path, small_batches):
    updates = odd_updates(range(-100, 200))
    rng, source = random.Random(7), str(tmp_path / "in")
    parts = [[], [], []]
    for u in updates:
        parts[rng.randrange(3)].append(u)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for part in (parts[0], parts[1] + parts[0][::3], parts[2]):
            spark.createDataFrame(part, stages.UPDATE).write.mode("append").parquet(source)
            stream = stages.fold_stream(spark.readStream.schema(spark.createDataFrame([], stages.UPDATE).schema).parquet(source), PLAN)
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination(300)
            assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, spark.read.schema(stages.OUT).parquet(str(tmp_path / "out")).collect())) == plainly(updates)


@pytest.mark.parametrize(("told", "why"), [([("frontier", "b", 1, 24, 2, 0.0, 0.0, 0.0)] * 2, "two frontier summaries of b"), ([("frontier", "b", 1, None, 2, 0.0, 0.0, 0.0)], "a value missing")])
def test_updates_that_cannot_be_folded(spark, told, why):
    with pytest.raises(Exception, match=why):
        stages.fold(spark.createDataFrame([(1, 0, 2, 0.1, told)], stages.UPDATE), PLAN).collect()
