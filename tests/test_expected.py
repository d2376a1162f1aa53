"""Rows written out by hand: what the rules say must come out, apart from any SQL."""

import pytest
from pyspark.sql import functions as F

from episodeframe.functions import records, scalar, statistics
from episodeframe.operators import banks, contracts, evaluation, ordered, orderstats
from episodeframe.streaming import controller

BATCH = f"run long, update long, tiers {controller.TIER}"


def fold(spark, rows, **policy):
    out = controller.fold(spark.createDataFrame([(1, u, t) for u, t in enumerate(rows)], BATCH), controller.Policy(**policy))
    return [(r.ready, r.passed, r.tier_before, r.tier_after) for r in out.orderBy("update").collect()]


def test_promotion_asks_for_a_full_window_and_a_streak(spark):
    """Window of two batches, 24 games, two passes in a row: promotion with the third update; review wins of a lower tier don't count afterwards."""
    won, lost = (0, 12, 12, 12, [1]), (1, 12, 0, 12, [1])
    found = fold(spark, [[won], [won], [won], [won, lost], [won, lost], [won, lost]], window=2, least_games=24, threshold=0.75, consecutive=2, max_tier=2)
    assert found == [(False, False, 0, 0), (True, True, 0, 0), (True, True, 0, 1), (False, False, 1, 1), (True, False, 1, 1), (True, False, 1, 1)]


def test_promotion_asks_for_maps_and_stops_at_the_last_tier(spark):
    one, two = (0, 12, 12, 12, [1]), (0, 12, 12, 12, [2])
    assert fold(spark, [[one], [one], [two]], window=2, least_games=24, threshold=0.5, consecutive=1, least_maps=2, max_tier=3)[-2:] == [(False, False, 0, 0), (True, True, 0, 1)]
    assert fold(spark, [[one]] * 3, window=1, least_games=1, threshold=0.5, consecutive=1, max_tier=0)[-1] == (True, True, 0, 0)


def test_window_stretches_over_short_batches(spark):
    """Batches of 4 counted games of 12 planned: two full batches are 24 games, so six batches are needed."""
    short = (0, 4, 4, 12, [1])
    ready = [r[0] for r in fold(spark, [[short]] * 7, window=2, least_games=12, threshold=0.5, consecutive=9, stretch=True)]
    assert ready == [False] * 5 + [True] * 2


def test_stage_hand_over():
    state = controller.State(tier=3, last=41, streak=1, recent=[[1, 1, []]])
    assert state.handed_over() == controller.State(tier=0, last=41, streak=0, recent=[])


ANSWERS = [
    (" UP ", "up"),
    ("I choose RIGHT.", "right"),
    ("Reason: left is blocked, down loops, right eats.\nAction: right", "right"),
    ('{"reason":"right eats a pellet","action":"right"}', "right"),
    ('text {"a": {"action": "Down"}} left', "down"),
    ('{"action": "jump"} and left', "left"),
    ("final answer = stay", "stay"),
    ("faction: up; leftover", "up"),
    ("nothing here", "stay"),
    (None, "stay"),
]


def test_parsed_actions(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ANSWERS)], "i long, t string")
    found = {r.i: r.a for r in df.select("i", scalar.parsed_action(F.col("t")).alias("a")).collect()}
    assert [found[i] for i in range(len(ANSWERS))] == [w for _, w in ANSWERS]
    only = df.select("i", scalar.parsed_action(F.col("t"), allowed=("left", "right"), by_word=False).alias("a")).where("i = 0").first().a
    assert only == "left"  # up is not allowed, words don't count: the first allowed one


def test_tiers_and_buckets(spark):
    rows = spark.createDataFrame([(0, 12), (12, 12), (1, 12)], "w long, n long")
    assert [r[0] for r in rows.select(scalar.tier_label(F.col("w"), F.col("n"))).collect()] == ["blocked", "very_easy", "mixed"]
    df = spark.createDataFrame([(9, 4, None, 10), (0, 0, 2, 11), (3, 7, 5, 41), (4, 8, 6, 40)], "r long, c long, d long, p long")
    assert [r[0] for r in df.select(scalar.bucket_key(*map(F.col, "rcdp"))).collect()] == ["2|1|6+|0-10", "0|0|0-2|11-40", "0|1|3-5|41+", "1|2|6+|11-40"]


def test_redacted_arguments(spark):
    argv = F.array(*map(F.lit, ["--wandb-key", "secret-value", "--api-key=abc", "--lr", "5e-7"]))
    assert spark.range(1).select(scalar.redacted_arguments(argv).alias("a")).first().a == ["--wandb-key", "[REDACTED]", "--api-key=[REDACTED]", "--lr", "5e-7"]


def outcomes(spark, rates, n=48):
    rows = [(s, i < round(r * n)) for s, r in rates.items() for i in range(n)]
    return spark.createDataFrame(rows, "seed long, won boolean")


def test_pooled_bootstrap(spark):
    rows = outcomes(spark, {0: 0.25, 1: 0.5, 15: 0.75})
    one, two = statistics.bootstrap_rate(rows, "seed").first(), statistics.bootstrap_rate(rows.repartition(3), "seed").first()
    assert one == two and (one.n, one.wins, one.pass_rate) == (144, 72, 0.5)
    # strata keep their sizes, so the spread is that of the sum of three binomials
    spread = 1.96 * (48 * (0.1875 + 0.25 + 0.1875)) ** 0.5 / 144
    assert one.low == pytest.approx(0.5 - spread, abs=0.01) and one.high == pytest.approx(0.5 + spread, abs=0.01)


def test_clear_improvement(spark):
    seeds = (0, 1, 14, 15, 16)
    base = outcomes(spark, dict.fromkeys(seeds, 0.25))
    better = statistics.clear_improvement(base, outcomes(spark, dict.fromkeys(seeds, 0.45)), "seed").first()
    assert better.difference == pytest.approx(0.2, abs=0.01) and better.clear_improvement and better.low > 0
    assert not statistics.clear_improvement(base, outcomes(spark, dict.fromkeys(seeds, 0.29)), "seed").first().clear_improvement
    with pytest.raises(Exception, match="different keys"):
        statistics.clear_improvement(base, outcomes(spark, {0: 0.5}), "seed").collect()
    collapsed = outcomes(spark, {0: 0.0, 1: 1.0, 14: 1.0, 15: 0.0, 16: 0.0})
    within, across = statistics.clear_improvement(base, collapsed, "seed").first(), statistics.cluster_interval(base, collapsed, "seed").first()
    assert within.difference == pytest.approx(0.15) and within.regressed == 3
    assert within.low > 0 and across.low < 0 < across.high and across.high - across.low > within.high - within.low


def test_mean_intervals(spark):
    rows = spark.createDataFrame([(float(i % 10), float(i % 5)) for i in range(400)], "a double, b double")
    found = statistics.mean_interval(rows, "a").first()
    assert found.n == 400 and found.mean == 4.5 and (found.high - found.low) / 2 == pytest.approx(1.96 * 2.872 / 20, rel=0.1)
    assert statistics.mean_interval(rows, "a", less="b").first().mean == 2.5


def test_clip_selection_floor_cap_and_empty(spark):
    rows = spark.createDataFrame([(1, 0, 1.0, -0.1), (1, 1, -1.0, -3.0), (1, 2, 0.0, -1.0)], "u long, i long, a double, lp double")
    pick = lambda **k: statistics.clip_selection(rows, "u", "i", "a", "lp", seed="0", **k).collect()
    one = pick(ratio=1e-4, low=1.0, high=5.0)
    assert len(one) == 1 and one[0].i != 2  # a floor of one of the two in the band
    assert pick(ratio=0.1, low=10.0, high=20.0) == []
    assert pick(ratio=1e-4, low=1.0, high=5.0) == one
    assert tuple(statistics.clip_summary(rows, "u", "a", "lp", ratio=0.9, low=1.0, high=5.0).first()) == (1, 3, 2, 2)


def test_rollout_counts_an_episode_once(spark):
    from episodeframe.operators import aggregates

    rows = [("g1", "a", 1.1, True, 10)] * 3 + [("g1", "b", 0.0, False, 5), ("g2", "c", 0.0, False, 7), ("g2", "d", 0.0, False, 9), ("g3", "e", 1.0, True, 20)]
    found = aggregates.rollout_metrics(spark.createDataFrame(rows, "group_id string, episode_id string, reward double, won boolean, n_steps long")).first()
    assert (found.episodes, found.win_rate, found.mean_reward) == (5, 0.4, pytest.approx(0.42))
    assert found.zero_variance_groups == pytest.approx(2 / 3) and found.success_steps_median == 15


def test_order_statistics_beyond_the_sketch(spark):
    """More rows than the sketch tells apart, with many ties: ranks are exact all the same."""
    rows = spark.range(60_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 50021).cast("double")).alias("v"))
    found = {r.k: r for r in orderstats.nearest_ranks(rows, ["k"], "v", {"a": 0.0, "b": 0.333, "c": 0.5, "d": 0.999, "e": 1.0}).collect()}
    for k in (0, 1):
        v = sorted(7.0 if i % 3 == 0 else float(i * 7919 % 50021) for i in range(60_000) if i % 2 == k)
        assert [found[k][c] for c in "abcde"] == [v[round((len(v) - 1) * f)] for f in (0.0, 0.333, 0.5, 0.999, 1.0)]


def test_route_captures(spark):
    rows = spark.createDataFrame([(1, i, f"s{i}") for i in range(17)] + [(2, i, "same") for i in range(12)], "e long, i long, s string")
    found = {(r.e, r.s): r.sources for r in ordered.route_captures(rows, "e", "i", "s", F.col("e") == 1).collect()}
    assert {(k[1], *v[0].origins) for k, v in found.items() if k[0] == 1} == {("s2", "early_1/6"), ("s5", "early_1/3"), ("s12", "death_before_4"), ("s8", "death_before_8"), ("s0", "death_before_16")}
    assert [(x.i, x.origins) for x in found[2, "same"]] == [(2, ["early_1/6"]), (4, ["early_1/3"])]


def test_strict_collection_fails_without_an_effective_group(spark):
    rows = [(0, 0, 10, 1.0), (0, 0, 10, 1.0), (0, 1, 11, 1.0), (0, 1, 11, 1.0 + 1e-11), (1, 0, 12, 0.0), (1, 0, 12, 0.0)]
    schema = "slot long, round long, group_id long, reward double"
    assert tuple(banks.collected(spark.createDataFrame(rows[:4], schema)).first()) == (0, 11, 1, 2, 1)
    with pytest.raises(Exception, match="slot 1"):
        banks.collected(spark.createDataFrame(rows, schema)).collect()
    kept = {r.slot: (r.group_id, r.filled) for r in banks.resampled(spark.createDataFrame(rows, schema), 2, "s").collect()}
    assert kept == {0: (11, False), 1: (12, True)}


def test_evictions_take_the_most_used(spark):
    bank = spark.createDataFrame([(i, "b", i % 3, u, p) for i, (u, p) in enumerate([(0, 5), (9, 1), (9, 0), (1, 1), (2, 2), (3, 3)])], "state_id long, bucket string, seed long, usage long, last_probe long")
    assert sorted(map(tuple, banks.evicted(bank).collect())) == [(1, "bucket"), (2, "bucket")]


def test_weighted_draws_follow_weights(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "id long, w double")
    found = banks.weighted_draws(rows, "id", "w", spark.range(4000).withColumnRenamed("id", "draw"), "s").groupBy("id").count().collect()
    share = {r.id: r["count"] / 4000 for r in found}
    assert set(share) == {1, 2} and share[2] == pytest.approx(0.75, abs=0.03)


def test_ledger_freezes_after_a_death(spark):
    part = {n: 0 for n in contracts.NAMES} | {"total": 0}
    kind = "struct<" + ", ".join(f"{n}: bigint" for n in (*contracts.NAMES, "total")) + ">"
    schema = f"episode_id long, step long, idx long, frame long, score long, delta long, components {kind}, events array<struct<type: string, delta: bigint, idx: bigint, frame: bigint>>"
    pellet = part | {"normal_pellet": 10, "total": 10}
    rows = [
        (1, 1, 1, 1, 10, 10, pellet, [("normal_pellet_eaten", 10, 1, 1)]),
        (1, 2, 1, 2, 10, 0, part, [("death", 0, 1, 2)]),
        (1, 2, 2, 2, 10, 0, part, []),
        (1, 3, 1, 3, 10, 0, part, []),
    ]
    assert contracts.ledger(spark.createDataFrame(rows, schema)).isEmpty()
    rows[2] = (1, 2, 2, 3, 10, 0, part, [("death", 0, 2, 3)])
    broken = {r.rule for r in contracts.ledger(spark.createDataFrame(rows, schema)).collect()}
    assert broken == {"frame_contiguous", "one_death"}


def test_group_checks_are_errors(spark):
    good = [("g", f"e{i}", float(i % 2), "v", "s", 1, 0) for i in range(12)]
    schema = "group_id string, episode_id string, reward double, version string, state string, decisions long, place long"
    out = contracts.post_processed(spark.createDataFrame(good, schema)).collect()
    assert {r.advantage for r in out} == {0.5, -0.5}
    for bad, what in ((good[:-1], "incomplete"), (good + [("g", "e0", 1.0, "v", "s", 1, 0)], "inconsistent"), (good[:-1] + [("g", "e11", 1.0, "w", "s", 1, 0)], "mixed"), (good[:-1] + [("g", "e11", 1.0, "v", "t", 1, 0)], "incomplete")):
        with pytest.raises(Exception, match=what):
            contracts.post_processed(spark.createDataFrame(bad, schema)).collect()


def test_board_answers(spark):
    df = spark.createDataFrame([(["# P .", ". . #"],), (["# P .", ". .#"],), (["# P x", ". . #"],), (["# P ."],)], "rows array<string>")
    found = [r[0] for r in df.select(records.decoded_board(F.col("rows"), F.lit(2), F.lit(3))).collect()]
    assert found == [["#P.", "..#"], None, None, None]
    packed = spark.createDataFrame([(["#P.", "..#"],)], "rows array<string>")
    assert packed.select(records.spaced_rows(F.col("rows")).alias("r")).first().r == ["# P .", ". . #"]


def test_literals(spark):
    texts = ["{'a/b': 1, 'c': 2, 'd/e': nan, 'f/g': True, 'h/i': -inf, 'n/n': 'nan'}", "{'a/b': 1", "[1]", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(records.literal_metrics(F.col("t"))).collect()] == [{"a/b": 1.0}, None, None, None]


def test_gates(spark):
    rows = spark.createDataFrame([(0.2, 0.5, 0, 0), (0.2, 0.39, 0, 0), (0.6, 0.9, 0, 0), (0.2, 0.9, 1, 0)], "before double, after double, parse_failures long, violations long")
    assert [(r.progress, r.accepted) for r in evaluation.progress_gate(rows).collect()] == [(True, True), (False, False), (True, True), (True, False)]
    kept = evaluation.retained(spark.createDataFrame([(1, 6, 12, False), (2, 1, 2, False), (3, 0, 0, True), (4, 1, 3, False)], "update long, wins long, episodes long, pending boolean"))
    assert {(r.update, r.latest, r.best, r.pending) for r in kept.collect()} == {(1, False, True, False), (3, False, False, True), (4, True, False, False)}
