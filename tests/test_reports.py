"""Reports on empty, null and odd rows."""

from pyspark.sql import functions as F

from episodeframe.operators import reports


def test_rows_made_of_rows(spark):
    rows = spark.createDataFrame([(1, 3), (2, 20), (3, None)], "id int, n int")
    assert sorted((r.id, r.bin) for r in reports.in_bins(rows, "n", [(1, 8, "a"), (3, 20, "b")]).collect()) == [(1, "a"), (1, "b"), (2, "b")]
    assert sorted(map(tuple, reports.seed_plan(rows.select("id"), [7, 9]).where("id < 3").collect())) == [(1, 7), (1, 9), (2, 7), (2, 9)]
    assert sorted((r.id, r.audit_role, r.independent) for r in reports.in_roles(rows.where("id = 1"), {"x": True, "y": False}).collect()) == [(1, "x", True), (1, "y", False)]
    both = reports.decisions_or_placeholder(rows.select("id"), spark.createDataFrame([(1, 0, "U")], "id int, step int, action string"), "id")
    assert sorted((r.id, r.decision, r.trains) for r in both.collect()) == [(1, 0, True), (2, -1, False), (3, -1, False)]
    assert reports.without_fields(rows.select(F.struct("id", "n").alias("s")), "s", "n", "none").select("s.*").columns == ["id"]


def test_numbers_of_nothing(spark):
    none = spark.createDataFrame([], "p boolean, e boolean, fault_p boolean, fault_e boolean, steps_p int, steps_e int")
    assert tuple(reports.paired_outcomes(none).first()) == (0, 0, 0, 0, None, None)
    draws = spark.createDataFrame([(1, 5, True), (1, 6, False)], "item int, frame int, big boolean")
    assert reports.plan_statistics(draws, "item", "frame", F.col("big")).first().asDict() == {"draws": 2, "distinct_items": 1, "max_repeat": 2, "large_fraction": 0.5, "distinct_frames": 2}
    rows = spark.createDataFrame([(1, True, 0.5)], "seed int, won boolean, reward double")
    found = reports.route_summary(spark.createDataFrame([(1,), (2,)], "seed int"), rows)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 1, 0.5, 0.5, 0.5), (2, 0, 0, None, None, None)]


def test_hashes_and_states(spark):
    rows = spark.createDataFrame([(1, "x", None), (2, "x", "0"), (3, "x", "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881")], "id int, text string, told string")
    assert sorted(r.id for r in reports.stale_hashes(rows, F.col("told"), F.col("text")).collect()) == [1, 2]
    states = spark.createDataFrame([(1, True, True, 40, 6), (2, True, True, 39, 6), (3, True, True, 61, 6), (4, True, True, 50, 12), (5, True, False, 50, 6), (6, None, True, 50, 6)], "id int, qualified boolean, eligible boolean, measured int, wins int")
    assert [r.id for r in reports.active_states(states, 60, 12).collect()] == [1]
