"""Routes bound to their steps on odd rows, and in tasks that do not grow with the table."""

from math import ceil

from episodeframe.operators import contracts
from episodeframe.plans import registry
from episodeframe.sources import bindings


def test_odd_sides(spark):
    """A key of one side alone, a side that has more, gaps in the order, null facts and null keys (bound to nothing)."""
    steps = spark.createDataFrame([(1, 10, "U", 3, True), (1, 30, "D", 4, False), (1, 40, "L", 5, False), (2, 1, "U", 1, True), (4, 1, None, 1, None), (None, 1, "U", 1, True)], "k long, at long, action string, cell long, called boolean")
    executed = spark.createDataFrame([(1, 5, "U", 3, 0), (1, 6, "R", 4, 0), (3, 1, "U", 1, 0), (4, 9, "U", 2, 1), (None, 1, "U", 1, 0)], "k long, at long, action string, cell long, cursor long")
    every = ["action", "both", "called", "cell"]
    want = [(1, 2, "action"), (1, 2, "called"), *((1, 3, r) for r in every), *((2, 1, r) for r in every), *((3, 1, r) for r in every), (4, 1, "action"), (4, 1, "called"), (4, 1, "cell")]
    want += sorted([(None, 1, r) for r in every] * 2)
    for parts in (None, 3):
        got = contracts.route_binding(steps, executed, "k", parts).collect()
        assert sorted(((r.k, r.place, r.rule) for r in got), key=str) == sorted(want, key=str)


def test_tasks_do_not_grow_with_the_table(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(tuple, registry.QUERIES["val17_route_binding"](spark, d).collect()))
    whole = rows()
    monkeypatch.setattr(bindings, "TASK_ROWS", 200)
    monkeypatch.setattr("episodeframe.plans.audits.TASK_ROWS", 200)
    n = bindings.table(spark, d, "lineitem").count()
    assert bindings.steps(spark, d).rdd.getNumPartitions() == ceil(n / 200) > 8
    assert rows() == whole
    plan = registry.QUERIES["val17_route_binding"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning(episode_id#" in plan
