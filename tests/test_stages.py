"""The stage machine by hand, and a stream against the fold of a table."""

import pytest

from episodeframe.streaming import stages
from episodeframe.streaming.stages import Machine, Plan

PLAN = Plan(pilot_updates=2, adaptive_updates=4, probe_every=2)


def told(kind, name, step, wins, samples=24, reward=0.0, variance=0.25):
    return {"kind": kind, "state_id": name, "env_step": step, "samples": samples, "successes": wins, "mean_reward": reward, "mean_pellets": 0.0, "variance": variance}


def first(start=0, **pilot):
    return [told("start", "t", 0, start), told("frontier", "z", 0, 12), told("frontier", "b", 9, 12), told("frontier", "a", 9, 8), told("frontier", "c", 3, 17), told("pilot", "a", 9, 2, **pilot)]


def events(*updates, plan=PLAN, signal=(2, 0.1)):
    machine, out = Machine(), []
    for version, summaries in enumerate(updates):
        if (found := machine.step(plan, version, *signal, summaries)) is not None:
            out.append(found)
    return out


def test_the_course_of_a_run():
    after = [told("pilot", "a", 9, 20, reward=0.5), told("frontier", "z", 0, 23), told("frontier", "c", 3, 16)]
    none = [told("start", "t", 0, 18), told("start", "u", 0, 24), told("frontier", "c", 3, 17), told("frontier", "d", 1, 12, samples=12)]
    got = events(first(), [], after, [], none, [])
    # the earliest step with a rate in [0.3, 0.7] and the least id; at version 0 none at step 0
    assert got == [("pilot", "pilot_selected", "a", 9), ("pilot", "train", "a", 9), ("staged", "adaptive_selected", "c", 3), ("staged", "train", "c", 3), ("stopped", "true_start_above_frontier", "c", 3)]
    assert events(first(), [], after, [], after, [], after)[-1] == ("completed", "bounded_run_completed", "c", 3)
    assert events(first(), [], after, [], [])[-1][1] == "no_current_learnable_frontier"
    assert events(first(), [], after, plan=Plan(2, 4, 2, phase="pilot"))[-1] == ("passed", "pilot_passed", "a", 9)


def test_the_gate():
    after = lambda wins=20, **k: [told("pilot", "a", 9, wins, reward=0.5, **k)]
    stop = ("stopped", "pilot_inconclusive", "a", 9)
    assert events(first(), [], after(wins=7))[-1] == stop  # intervals meet
    assert events(first(reward=0.6), [], after())[-1] == stop
    assert events(first(variance=0.0), [], after())[-1] == stop
    assert events(first(samples=12), [], after())[-1] == stop
    assert events(first(), [], after(), signal=(1, 0.1))[-1] == stop
    assert events(first(start=8))[-1][:2] == ("stopped", "initial_cold_start_assumption_not_supported")
    assert events([told("frontier", "z", 0, 12)])[-1][:2] == ("stopped", "no_initial_learnable_restart_state")


def test_gaps_and_doubles_are_errors():
    with pytest.raises(ValueError, match="follows"):
        Machine().step(PLAN, 1, 0, 0.0, [])
    with pytest.raises(ValueError, match="two frontier summaries of b"):
        events([told("frontier", "b", 1, 2), told("frontier", "b", 1, 2)])


def test_stream_out_of_order_with_replays(spark, tmp_path):
    after = [told("pilot", "a", 9, 20, reward=0.5), told("frontier", "c", 3, 16)]
    rows = [(r, v, 2, 0.1, [tuple(s.values()) for s in x]) for r in (1, 2, 3) for v, x in enumerate([first(start=8 if r == 3 else 0), [], after, [], after if r == 1 else []])]
    table = spark.createDataFrame(rows, stages.UPDATE)
    want = sorted(map(tuple, stages.fold(table, PLAN).collect()))
    source = tmp_path / "s"
    for versions in ((1, 4), (1, 2), (3,), (0,), (0, 3)):
        table.where(table.version.isin(*versions)).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = stages.fold_stream(stream, PLAN).writeStream.format("memory").queryName("stages").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, spark.table("stages").collect())) == want and len(want) == 5 + 5 + 1
