"""Operators on small tables of their own: rules, functions, boards, state, sources and sinks."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from episodeframe.functions import scalar, statistics
from episodeframe.operators import audit, grids, selection
from episodeframe.sources import readers, sinks
from episodeframe.streaming import controller, journal


def test_rules_report_all_and_fail_closed(spark):
    rows = spark.createDataFrame([(1, 5, 1.0), (2, -1, 9.0), (3, None, 2.0)], "id long, steps int, reward double")
    rules = [audit.Rule("steps", F.col("steps") < 0), audit.Rule("reward", F.col("reward") > 3)]
    assert sorted(map(tuple, audit.violations(rows, rules, "id").collect())) == [(2, "reward"), (2, "steps"), (3, "steps")]
    assert [r.id for r in audit.quarantined(rows, rules, "id").collect()] == [1]
    assert audit.clean(rows.where("id = 1"), rules, "id").count() == 1
    with pytest.raises(Exception, match="2: steps, reward"):
        audit.clean(rows.where("id = 2"), rules, "id").collect()


def test_centered_groups_sum_to_zero(spark):
    rng = random.Random(1)
    rows = [(g, rng.random() if g else 0.3) for g in range(5) for _ in range(12)]
    out = statistics.centered(spark.createDataFrame(rows, "group_id long, reward double"))
    sums = {r[0]: r[1] for r in out.groupBy("group_id").agg(F.sum("advantage")).collect()}
    assert all(abs(x) < 1e-12 for x in sums.values()) and out.where("group_id = 0 AND advantage <> 0").isEmpty()


def test_mcnemar_and_wilson(spark):
    rows = spark.createDataFrame([(i < 14, False) for i in range(50)], "a boolean, b boolean")
    assert statistics.mcnemar(rows, F.col("a"), F.col("b")).first().p_value == pytest.approx(0.0001220703125)
    low, high = statistics.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (0.0, 0.0)


def test_natural_labels(spark):
    labels = ["update12", "update2", "base", "update" + "9" * 20, "update1" + "0" * 20, "update007"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    found = [r.label for r in df.orderBy(selection.natural_key(F.col("label"))).collect()]
    assert found == ["base", "update2", "update007", "update12", "update" + "9" * 20, "update1" + "0" * 20]


def test_scalars(spark):
    one = spark.range(1)
    x = one.select(
        scalar.seed64_little(F.lit("a")).alias("s"),
        scalar.clean_line(F.lit("\x1b[31mperf 1\x1b[0m [repeated 7x across cluster]")).alias("line"),
        scalar.common_prefix(F.array(*map(F.lit, range(130))), F.array(*map(F.lit, [*range(100), -1]))).alias("p"),
        scalar.redacted(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("name"), F.lit("y"))).alias("m"),
        scalar.metrics_only(F.create_map(F.lit("a/b"), F.lit(1.0), F.lit("c"), F.lit(2.0), F.lit("d/e"), F.lit(float("nan")))).alias("f"),
    ).first()
    import hashlib

    assert int(x.s) == int.from_bytes(hashlib.sha256(b"a").digest()[:8], "little")
    assert (x.line, x.p, x.m, x.f) == ("perf 1", 64, {"api_key": "[REDACTED]", "name": "y"}, {"a/b": 1.0})


def test_boards(spark):
    cells = spark.createDataFrame([(1, r, c) for r in range(2) for c in range(3) if (r, c) != (0, 1)], "map_id long, r long, c long")
    edges = grids.edges_of(cells, 3)
    far = grids.all_distances(edges)
    found = {(r.src, r.node): (r.distance, r.actions) for r in grids.first_moves(edges, far).collect()}
    assert found[0, 2] == (4, "D") and len(found) == 20 and far.count() == 25
    tunnel = grids.edges_of(cells, 3, portal_row=0)
    assert (0, "L", 2) in {(r.src, r.action, r.dst) for r in tunnel.collect()}
    boards = spark.createDataFrame([(1, ["ab", "cd"]), (2, ["ca", "db"]), (3, ["ba", "dc"]), (4, ["ab", "dc"])], "map_id long, rows array<string>")
    form = {r.map_id: r.canonical for r in grids.canonical_layouts(boards).collect()}
    assert form[1] == form[2] == form[3] != form[4]


def test_frontier_reaches_the_end_of_a_long_path(spark):
    edges = spark.range(70).select(F.lit(1).cast("long").alias("map_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).coalesce(1)
    source = spark.createDataFrame([(1, 0)], "map_id long, node long")
    assert sorted(map(tuple, grids.frontier_distances(edges, source).collect())) == [(1, n, n) for n in range(71)]
    assert grids.frontier_distances(edges, source, limit=3).count() == 4


def test_seeds_and_files(spark, tmp_path):
    df = spark.createDataFrame([("0,1,14-16",)], "e string")
    assert [r.seed for r in readers.seeds(df, "e").collect()] == [0, 1, 14, 15, 16]
    (tmp_path / "a--sample-b.json").write_text('{"id": "a", "trajectory_sample_id": "b"}')
    (tmp_path / "wrong.json").write_text('{"id": "c", "trajectory_sample_id": "d"}')
    files = readers.json_files(spark, str(tmp_path), "id string, trajectory_sample_id string")
    assert [r._file for r in readers.misnamed(files).collect()] == ["wrong.json"]
    (tmp_path / "x.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), "id string").count() == 2
    with pytest.raises(Exception, match="blank line"):
        readers.json_lines(spark, str(tmp_path / "x.jsonl"), "id string", allow_blank=False).collect()


def test_write_once(spark, tmp_path):
    df = spark.range(5)
    path = str(tmp_path / "out")
    assert sinks.write_once(df, path) is True and sinks.write_once(df.orderBy(F.desc("id")), path) is False
    with pytest.raises(ValueError, match="other rows"):
        sinks.write_once(spark.range(6), path)
    a, b = (sinks.manifest(x, "t", "id").first() for x in (df, df.repartition(3)))
    assert a == b and a.rows == 5


def batch(run, update, *tiers):
    return (run, update, [(*t[:4], list(t[4])) for t in tiers])


BATCH = f"run long, update long, tiers {controller.TIER}"


def test_stream_folds_like_the_table(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for run in range(3):
        for u in range(12):
            games = [rng.randint(5, 20) for _ in range(3)]
            rows.append(batch(run, u, *((t, g, rng.randint(g // 3, g), g, rng.sample(range(9), 2)) for t, g in enumerate(games))))
    policy = controller.Policy(max_tier=2)
    want = sorted(map(tuple, controller.fold(spark.createDataFrame(rows, BATCH), policy).collect()))
    assert any(w[-1] > w[-2] for w in want)
    source = tmp_path / "in"
    source.mkdir()
    rng.shuffle(rows)  # updates arrive out of order, and one twice
    names = ("tier", "games", "wins", "planned", "maps")
    text = lambda r: json.dumps({"run": r[0], "update": r[1], "tiers": [dict(zip(names, t)) for t in r[2]]})
    for i in range(4):
        (source / f"{i}.json").write_text("\n".join(map(text, rows[i::4] + rows[:1])))
        time.sleep(0.02)
    stream = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).json(str(source))
    q = controller.fold_stream(stream, policy).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("folded").collect())) == want
    with pytest.raises(Exception, match="follows"):
        controller.fold(spark.createDataFrame([batch(1, 1, (0, 5, 5, 5, [1]))], BATCH)).collect()


def test_journal(spark, tmp_path):
    lines = ['{"source_step": 1, "metrics": {"a/b": 1.5, "plain": 2}, "time": 1}', "broken", '{"source_step": 2, "metrics": {"a/b": 2.5}, "time": 2}']
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.jsonl").write_text("\n".join(lines) + "\n")
    q = journal.read_journal(spark, str(tmp_path / "j")).writeStream.format("memory").queryName("journal").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.source_step, r.key, r.value) for r in spark.table("journal").collect()) == [(1, "a/b", 1.5), (2, "a/b", 2.5)]


def test_strict_windows_refuse_other_tiers():
    policy = controller.Policy(window=1, least_games=1, strict=True)
    state = controller.State()
    assert state.step(policy, 0, [(0, 5, 5, 5, [1])])[0] == 5
    with pytest.raises(ValueError, match=r"games of tiers \[1\], the current one is 0"):
        state.step(policy, 1, [(0, 5, 5, 5, [1]), (1, 2, 2, 2, [1])])
