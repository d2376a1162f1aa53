"""Queries of state that advances once an update: promotion, banks, collection rounds, draws."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..operators import banks
from ..sources import sinks
from ..sources.bindings import EPISODES, episodes, table
from ..streaming import banks as bank_streams
from ..streaming import controller, stages
from .core import query

COURSE = f"""{EPISODES}, course AS (SELECT seed % 4 AS run, group_id // 64 AS update, group_id, group_id % 3 AS tier, terminal = 'cleared' AS won, seed AS map, fault, group_id % 5 <> 0 AS normal FROM episodes)"""


def course(spark, d):
    e = episodes(spark, d)
    return e.select((F.col("seed") % 4).alias("run"), F.expr("group_id div 64").alias("update"), "group_id", (F.col("group_id") % 3).alias("tier"), (F.col("terminal") == "cleared").alias("won"), F.col("seed").alias("map"), "fault", (F.col("group_id") % 5 != 0).alias("normal"))


def promotion_sql(counts: str, window: int, least: int, threshold: float, consecutive: int, maps: int, top: int, stretch: bool = False) -> str:
    """The fold as a recursive query, one step an update: the window is three lists."""
    size = f"coalesce(list_min(list_filter(range({window}, len(g1) + 1), lambda k: list_sum(g1[-k:]) >= least)), greatest(len(g1), {window}))" if stretch else str(window)
    floor = f"greatest({least}, {window} * coalesce(b.planned, 0))" if stretch else str(least)
    return f"""WITH RECURSIVE {COURSE}, {counts}, u AS (SELECT DISTINCT run, update FROM course), f AS (
      SELECT run, -1::BIGINT AS update, 0::BIGINT AS tier, 0::BIGINT AS streak, []::BIGINT[] AS g, []::BIGINT[] AS w, []::BIGINT[][] AS m, 0::BIGINT AS games, 0::BIGINT AS maps, false AS ready, false AS passed, 0::BIGINT AS before FROM (SELECT DISTINCT run FROM course)
      UNION ALL
      SELECT run, update, CASE WHEN up THEN tier + 1 ELSE tier END, CASE WHEN up THEN 0 ELSE s2 END, CASE WHEN up THEN [] ELSE g2 END, CASE WHEN up THEN [] ELSE w2 END, CASE WHEN up THEN [] ELSE m2 END, games2, maps2, ready2, passed2, tier FROM (
        SELECT *, s2 >= {consecutive} AND tier < {top} AS up FROM (SELECT *, CASE WHEN passed2 THEN streak + 1 ELSE 0 END AS s2 FROM (SELECT *, coalesce(ready2 AND wins2 / games2 >= {threshold}, false) AS passed2 FROM (
          SELECT *, len(g2) = size AND games2 >= least AND maps2 >= {maps} AS ready2 FROM (SELECT *, list_sum(g2)::BIGINT AS games2, list_sum(w2)::BIGINT AS wins2, len(list_distinct(flatten(m2)))::BIGINT AS maps2 FROM (
            SELECT *, g1[-size:] AS g2, w1[-size:] AS w2, m1[-size:] AS m2 FROM (SELECT *, {size} AS size FROM (
              SELECT f.run, u.update, f.tier, f.streak, {floor} AS least, list_append(f.g, coalesce(b.games, 0)) AS g1, list_append(f.w, coalesce(b.wins, 0)) AS w1, list_append(f.m, coalesce(b.maps, [])) AS m1
              FROM f JOIN u ON u.run = f.run AND u.update = f.update + 1 LEFT JOIN b ON b.run = u.run AND b.update = u.update AND b.tier = f.tier)))))))))
    SELECT run, update, games, maps, ready, passed, before AS tier_before, tier AS tier_after FROM f WHERE update >= 0"""


PLAIN = "b AS (SELECT run, update, tier, count(*) AS games, count(*) FILTER (won) AS wins, count(*) AS planned, list_distinct(list(map)) AS maps FROM course GROUP BY 1, 2, 3)"
NORMAL = "b AS (SELECT run, update, tier, count(*) FILTER (normal) AS games, count(*) FILTER (won AND normal) AS wins, count(*) AS planned, list_distinct(list(map) FILTER (normal)) AS maps FROM course GROUP BY 1, 2, 3)"
FAULTLESS = """k AS (SELECT group_id, NOT bool_or(fault) AND bool_and(normal) AS counted FROM course GROUP BY 1),
  b AS (SELECT run, update, tier, count(*) FILTER (counted) AS games, count(*) FILTER (won AND counted) AS wins, count(*) AS planned, list_distinct(list(map) FILTER (counted)) AS maps FROM course JOIN k USING (group_id) GROUP BY 1, 2, 3)"""


@query(promotion_sql(PLAIN, 3, 24, 0.48, 2, 2, 2))
def st1_st9_seq18_promotion(spark, d):
    return controller.fold(controller.batches(course(spark, d)), controller.Policy(window=3, least_games=24, threshold=0.48, consecutive=2, least_maps=2, max_tier=2))


@query(promotion_sql(NORMAL, 2, 24, 0.48, 2, 2, 2, stretch=True))
def st2_stretched_window(spark, d):
    policy = controller.Policy(window=2, least_games=24, threshold=0.48, consecutive=2, least_maps=2, max_tier=2, stretch=True)
    return controller.fold(controller.batches(course(spark, d), F.col("normal")), policy)


@query(promotion_sql(FAULTLESS, 3, 24, 0.45, 1, 2, 2))
def st3_faultless_window(spark, d):
    policy = controller.Policy(window=3, least_games=24, threshold=0.45, consecutive=1, least_maps=2, max_tier=2)
    return controller.fold(controller.batches(controller.fault_free(course(spark, d)), F.col("counted")), policy)


@query("""WITH p AS (SELECT user_id * 10 + event_id % 10 AS state_id, row_number() OVER (PARTITION BY user_id * 10 + event_id % 10 ORDER BY ts, event_id) - 1 AS n, event_type IN ('click', 'view') AS won FROM events),
  a AS (SELECT state_id, count(*) FILTER (n < 8) AS f, count(*) FILTER (n < 8 AND won) AS e, count(*) AS c, count(*) FILTER (won) AS w FROM p WHERE n < 24 GROUP BY 1)
  SELECT state_id, CASE WHEN e > 0 AND e < f THEN c ELSE f END AS probes, CASE WHEN e > 0 AND e < f THEN w ELSE e END AS wins, e > 0 AND e < f AND c = 24 AND w BETWEEN 3 AND 21 AS accepted FROM a""")
def st4_probe_budget(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").withColumn("state_id", F.col("user_id") * 10 + F.col("event_id") % 10)
    n = F.row_number().over(Window.partitionBy("state_id").orderBy("ts", "event_id")) - 1
    return banks.accepted(e.select("state_id", n.alias("n"), F.col("event_type").isin("click", "view").alias("won")))


BANK = "k AS (SELECT p_partkey AS state_id, p_brand || p_size % 7 AS bucket, p_partkey % 28 AS seed, p_size % 5 AS usage, p_partkey * 7 % 101 AS last_probe FROM part)"


@query(f"""WITH {BANK}, a AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY usage DESC, last_probe, state_id) <= count(*) OVER (PARTITION BY bucket) - 4 AS o FROM k),
  b AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY usage DESC, last_probe, state_id) <= count(*) OVER (PARTITION BY seed) - 16 AS o2 FROM a WHERE NOT o)
  SELECT state_id, 'bucket' AS reason FROM a WHERE o UNION ALL SELECT state_id, 'seed' FROM b WHERE o2""")
def st5_sel7_evictions(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    bank = p.select(F.col("p_partkey").alias("state_id"), F.concat("p_brand", (size % 7).cast("string")).alias("bucket"), (F.col("p_partkey") % 28).alias("seed"), (size % 5).alias("usage"), (F.col("p_partkey") * 7 % 101).alias("last_probe"))
    return banks.evicted(bank)


@query("""WITH o AS (SELECT o_orderkey % 4000 AS id, o_orderkey % 5 AS tier, 4 + o_custkey % 29 AS lookback, o_orderkey % 60 AS admitted, row_number() OVER (PARTITION BY o_orderkey % 4000 ORDER BY o_orderkey) AS k FROM orders),
  old AS (SELECT id, tier, lookback, admitted FROM o WHERE k = 1), new AS (SELECT id, tier, lookback, 60 AS admitted FROM old WHERE id % 9 = 0),
  e AS (SELECT * FROM old WHERE id % 9 <> 0 UNION ALL SELECT * FROM new), f AS (SELECT * FROM e WHERE admitted >= 40),
  r AS (SELECT *, row_number() OVER (PARTITION BY tier, lookback ORDER BY admitted DESC, id DESC) AS round FROM f), p AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY round, lookback) AS place FROM r) SELECT id, tier, lookback, admitted, place FROM p WHERE place <= 64""")
def st6_flt7_bank_refresh(spark, d):
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    old = o.groupBy((key % 4000).alias("id")).agg(F.min_by(F.struct((key % 5).alias("tier"), (4 + F.col("o_custkey") % 29).alias("lookback"), (key % 60).alias("admitted")), key).alias("r")).select("id", "r.*")
    return banks.refreshed(old, old.where("id % 9 = 0"), 60).select("id", "tier", "lookback", "admitted", "place")


SLOTS = f"""{EPISODES}, s AS (SELECT group_id % 50 AS slot, group_id // 50 AS round, group_id, CASE WHEN hash_ = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM (SELECT *, (episode_id * 7919) % 41 AS hash_ FROM episodes)),
  g AS (SELECT slot, round, group_id, min(reward) = max(reward) AS flat FROM s GROUP BY 1, 2, 3)"""


def slots(spark, d):
    return episodes(spark, d).select((F.col("group_id") % 50).alias("slot"), F.expr("group_id div 50").alias("round"), "group_id", F.when(F.col("episode_id") * 7919 % 41 == 0, 1.0).otherwise(0.0).alias("reward"))


@query(f"""WITH {SLOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY flat, CASE WHEN NOT flat THEN round END, sha256('draw|' || slot || '|' || group_id), group_id) AS k FROM g WHERE round < 2) SELECT slot, group_id, round, flat AS filled FROM r WHERE k = 1""")
def st7_resampled_slots(spark, d):
    return banks.resampled(slots(spark, d), 2, "draw")


@query(f"""WITH {SLOTS}, ok AS (SELECT slot FROM g WHERE NOT flat AND round < 16 GROUP BY 1), k AS (SELECT slot, min(round) AS round FROM g WHERE NOT flat GROUP BY 1)
  SELECT slot, group_id, round, round + 1 AS generated, round AS rejected FROM g JOIN k USING (slot, round) SEMI JOIN ok USING (slot)""")
def st8_strict_collection(spark, d):
    s = slots(spark, d)
    able = s.groupBy("slot", "round", "group_id").agg((F.min("reward") != F.max("reward")).alias("ok")).where("ok AND round < 16").select("slot").distinct()
    return banks.collected(s.join(able, "slot", "left_semi"))


@query(f"WITH {SLOTS} SELECT slot, count(*) AS episodes, count(*) FILTER (reward >= 1) AS wins FROM s WHERE round = 0 GROUP BY 1")
def st8_first_pass(spark, d):
    return banks.first_pass(slots(spark, d)).groupBy("slot").agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("reward") >= 1).alias("wins"))


@query("""WITH w AS (SELECT p_partkey AS id, (p_size % 5 * 1000 + CASE WHEN p_size % 7 = 0 THEN 250 ELSE 0 END)::BIGINT AS u FROM part), s AS (SELECT id, (sum(u) OVER (ORDER BY id) - u)::BIGINT AS low FROM w WHERE u > 0), t AS (SELECT sum(u)::BIGINT AS total FROM w),
  p AS (SELECT o_orderkey AS draw, (('0x' || substr(sha256('nm24|' || o_orderkey), 1, 15))::BIGINT % total)::BIGINT AS point FROM orders, t) SELECT draw, id FROM p ASOF JOIN s ON point >= low""")
def nm24_weighted_draws(spark, d):
    size = F.col("p_size")
    rows = table(spark, d, "part").select("p_partkey", (size % 5 + F.when(size % 7 == 0, 0.25).otherwise(0.0)).alias("w"))
    return banks.weighted_draws(rows, "p_partkey", "w", table(spark, d, "orders").select(F.col("o_orderkey").alias("draw")), "nm24")


@query("""WITH d AS (SELECT o_orderkey AS draw, o_custkey % 40 AS key, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1 AS nth FROM orders), p AS (SELECT p_partkey % 40 AS key, p_partkey AS id, count(*) OVER (PARTITION BY p_partkey % 40) AS size FROM part),
  t AS (SELECT draw, key, nth // size AS turn, nth % size AS pos FROM d JOIN (SELECT DISTINCT key, size FROM p) USING (key)),
  q AS (SELECT key, turn, id, row_number() OVER (PARTITION BY key, turn ORDER BY sha256('nm25|' || turn || '|' || id), id) - 1 AS pos FROM (SELECT DISTINCT key, turn FROM t) JOIN p USING (key)) SELECT draw, id FROM t JOIN q USING (key, turn, pos)""")
def nm25_rotating_queues(spark, d):
    draws = table(spark, d, "orders").select(F.col("o_orderkey").alias("draw"), (F.col("o_custkey") % 40).alias("key"))
    pool = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("key"), F.col("p_partkey").alias("id"))
    return banks.rotating_queue(draws, pool, "key", "id", "nm25")


@query("""SELECT l_orderkey, l_partkey, CASE WHEN l_returnflag = 'N' THEN 1.0 WHEN w > 0 AND w < 12 THEN 2.0 ELSE 0.1 END::DOUBLE AS weight FROM (SELECT l_orderkey, l_partkey, l_returnflag, l_suppkey % 13 AS w FROM lineitem)""")
def jn14_nm24_outcome_weights(spark, d):
    wins = F.when(F.col("l_returnflag") != "N", F.col("l_suppkey") % 13)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", banks.outcome_weight(wins, F.lit(12)).alias("weight"))


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def st9_snk7_exactly_once(spark, d):
    """Attempts appended by a stream that fails between a batch's rows and its ledger entry, goes on, and has a finished batch replayed: each row is there once."""
    path = sinks.shared_path(spark, "st9")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for part in range(3):
        o.where(F.col("o_orderkey") % 3 == part).coalesce(1).write.mode("append").parquet(f"{path}/in")

    def fail(batch_id: int) -> None:
        if batch_id == 1:
            raise RuntimeError("stopped between rows and entry")

    def run(ledger: sinks.Ledger):
        stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        q = stream.writeStream.foreachBatch(ledger).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except StreamingQueryException:
            if ledger.before_entry is None:
                raise

    run(sinks.Ledger(f"{path}/out", fail))
    ledger = sinks.Ledger(f"{path}/out")
    run(ledger)
    ledger(o, 0)
    return ledger.committed(spark, o.schema).drop("batch")


@query("""WITH e AS (SELECT DISTINCT p_partkey % 3 AS tier, p_partkey AS id, 4 + p_size % 29 AS lookback, unnest([p_partkey % 6, p_size % 6]) AS update FROM part),
  l AS (SELECT u AS update, tier, id, lookback, max(e.update) AS admitted FROM e, range(6) r(u) WHERE e.update <= u GROUP BY 1, 2, 3, 4) SELECT tier, update, id, lookback, admitted FROM l WHERE admitted >= update - 2""")
def st6_bank_stream(spark, d):
    """Banks after each of six updates of a stream that is restarted after every two; entries live for two more updates, and come in anew with a second admission."""
    path, keep = sinks.shared_path(spark, "st6"), sinks.shared_path(spark, "st6-kept")
    key, size = F.col("p_partkey"), F.col("p_size").cast("long")
    rows = table(spark, d, "part").select((key % 3).alias("tier"), F.explode(F.array(key % 6, size % 6)).alias("update"), key.alias("id"), (4 + size % 29).alias("lookback")).distinct()
    for low in (0, 2, 4):
        rows.where(F.col("update").between(low, low + 1)).write.mode("append").parquet(path)
        found = bank_streams.refreshed_stream(spark.readStream.schema(rows.schema).parquet(path), max_age=2, cap=None)
        found.writeStream.format("parquet").option("path", keep).option("checkpointLocation", f"{keep}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("tier long, update long, id long, lookback long, admitted long").parquet(keep)


# the stage machine


STAGES = """WITH RECURSIVE k AS (SELECT c_custkey AS run FROM customer),
  f AS (SELECT run, v AS version, s, (run * 7 + v * 5 + s * 11) % 25 AS wins FROM k, range(13) v(v), range(4) s(s)),
  ch AS (SELECT run, version, min(s) FILTER (wins BETWEEN 8 AND 16 AND (version > 0 OR s > 0)) AS s FROM f GROUP BY 1, 2),
  p AS (SELECT run, s, ((run + s) % 5) / 24 AS b, (8 + (run * 3 + s) % 17) / 24 AS a, 1.959963984540054 AS z FROM k, range(4) s(s)),
  g AS (SELECT run, s, run % 7 > 0 AND run % 5 > 0 AND a > b AND greatest((a + z*z/48) / (1 + z*z/24) - z * sqrt(a * (1 - a) / 24 + z*z/2304) / (1 + z*z/24), 0) > (b + z*z/48) / (1 + z*z/24) + z * sqrt(b * (1 - b) / 24 + z*z/2304) / (1 + z*z/24) AS learned FROM p),
  r AS (SELECT run, 0 AS version, CASE WHEN run % 9 >= 8 OR s IS NULL THEN 'stopped' ELSE 'pilot' END AS stage,
      CASE WHEN run % 9 >= 8 THEN 'initial_cold_start_assumption_not_supported' WHEN s IS NULL THEN 'no_initial_learnable_restart_state' ELSE 'pilot_selected' END AS event, CASE WHEN run % 9 < 8 THEN s END AS s FROM ch WHERE version = 0
    UNION ALL
    SELECT r.run, r.version + 1,
      CASE WHEN r.version + 1 < 4 THEN 'pilot' WHEN r.version + 1 = 4 AND NOT g.learned THEN 'stopped' WHEN r.version + 1 >= 12 THEN 'completed' WHEN r.version % 2 = 0 OR ch.s IS NOT NULL THEN 'staged' ELSE 'stopped' END,
      CASE WHEN r.version + 1 < 4 THEN 'train' WHEN r.version + 1 = 4 AND NOT g.learned THEN 'pilot_inconclusive' WHEN r.version + 1 >= 12 THEN 'bounded_run_completed' WHEN r.version % 2 = 0 THEN 'train'
        WHEN ch.s IS NOT NULL THEN 'adaptive_selected' WHEN (r.run + r.version + 1) % 25 >= 17 THEN 'true_start_above_frontier' ELSE 'no_current_learnable_frontier' END,
      CASE WHEN r.version + 1 >= 4 AND r.version + 1 < 12 AND r.version % 2 = 1 AND (r.version + 1 > 4 OR g.learned) THEN coalesce(ch.s, r.s) ELSE r.s END
    FROM r JOIN ch ON ch.run = r.run AND ch.version = r.version + 1 JOIN g ON g.run = r.run AND g.s = r.s WHERE r.stage IN ('pilot', 'staged'))
  SELECT run, version::BIGINT AS version, stage, event, CASE WHEN s IS NULL THEN '' ELSE 's' || s END AS current, coalesce(s * 5, 0)::BIGINT AS env_step FROM r"""
PLAN = stages.Plan(pilot_updates=4, adaptive_updates=8, probe_every=2)


def probes(spark, d):
    """A run for every customer: thirteen updates with summaries of a true start, four candidates and independent probes of these."""
    run, v = F.col("c_custkey"), F.col("version")
    keys = table(spark, d, "customer").select("c_custkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")  # a small file is much work
    rows = keys.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("version"))
    one = lambda s, kind, name, wins: F.struct(F.lit(kind).alias("kind"), name.alias("state_id"), (s * 5).cast("long").alias("env_step"), F.lit(24).cast("long").alias("samples"), wins.cast("long").alias("successes"), (wins / 24).alias("mean_reward"), (wins * 2.0).cast("double").alias("mean_pellets"), F.when(run % 7 == 0, 0.0).otherwise(0.25).alias("variance"))
    each = [(F.lit(i), F.lit(f"s{i}")) for i in range(4)]
    told = F.array(
        one(F.lit(0), "start", F.lit("t0"), F.when(v == 0, run % 9).otherwise((run + v) % 25)),
        *(one(s, "frontier", name, (run * 7 + v * 5 + s * 11) % 25) for s, name in each),
        *(F.when(v.isin(0, 4), one(s, "pilot", name, F.when(v == 0, (run + s) % 5).otherwise(8 + (run * 3 + s) % 17))) for s, name in each),
    )
    summaries = F.filter(told, lambda x: x.isNotNull()).alias("summaries")
    return rows.select(run.alias("run"), v.cast("long").alias("version"), F.lit(2).cast("long").alias("adv_count"), F.when(run % 5 == 0, 0.0).otherwise(0.1).alias("adv_variance"), summaries)


@query(STAGES)
def st14_stage_machine(spark, d):
    return stages.fold(probes(spark, d), PLAN)


@query(STAGES)
def st14_stage_machine_stream(spark, d):
    """The same machine over a stream, whose updates come in three parts, each with a third of a run's updates, the last ones first; it is restarted for each."""
    path, keep = sinks.shared_path(spark, "st14"), sinks.shared_path(spark, "st14-kept")
    source = probes(spark, d)
    for third in (2, 0, 1):
        source.where(F.col("version") % 3 == third).write.mode("append").parquet(path)
        updates = spark.readStream.schema(source.schema).parquet(path)
        stages.fold_stream(updates, PLAN).writeStream.format("parquet").option("path", keep).option("checkpointLocation", f"{keep}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stages.OUT).parquet(keep)
