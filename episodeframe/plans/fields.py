"""Queries of projections, filters, scalar functions, ordered picks and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import records, scalar
from ..operators import ordered, reports, selection
from ..sources.bindings import EPISODES, STEPS, episodes, steps, table
from .core import query

N = F.lit

# projections


@query("""SELECT o_orderkey AS id, o_orderstatus AS split, o_custkey AS recipe_revision, o_orderpriority AS environment_source FROM orders""")
def prj2_renamed(spark, d):
    from ..operators.records import renamed

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("split"), F.struct(F.col("o_custkey").alias("old_revision"), F.col("o_orderpriority").alias("old_source")).alias("env"))
    return renamed(o, "env", {"old_revision": "recipe_revision", "old_source": "environment_source"}).select("id", "split", "env.*")


@query("""SELECT o_orderkey AS id, o_custkey AS seed, o_orderstatus AS mode FROM orders""")
def prj3_dropped_field(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_custkey").alias("seed"), F.col("o_orderstatus").alias("mode"), F.col("o_totalprice").alias("engine_state")).alias("frame"))
    return reports.without_fields(o, "frame", "engine_state").select("id", "frame.*")


@query(f"WITH {STEPS} SELECT episode_id, step, unnest(['option_candidate_audit', 'deterministic_baseline']) AS audit_role, unnest([false, true]) AS independent, action FROM steps")
def prj5_candidate_roles(spark, d):
    rows = steps(spark, d).select("episode_id", "step", "action")
    return reports.in_roles(rows, {"option_candidate_audit": False, "deterministic_baseline": True})


@query("""SELECT o_orderkey AS id, unnest(['actor.path', 'actor.lr.peak', 'seed']) AS key, unnest([o_orderstatus, (o_custkey % 7)::VARCHAR, o_custkey::VARCHAR]) AS value FROM orders""")
def prj6_flattened(spark, d):
    from ..operators.records import flattened

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.struct(F.col("o_orderstatus").alias("path"), F.struct((F.col("o_custkey") % 7).alias("peak")).alias("lr")).alias("actor"), F.col("o_custkey").alias("seed")).alias("config"))
    return flattened(o, "id", "config")


@query("""WITH k AS (SELECT c_custkey AS id, unnest(['api_key', 'n_tokens', 'authorization', 'wandb-key', 'access.token', 'keyboard', 'DB_PASSWORD']) AS key, unnest([c_name, 'a', c_mktsegment, 'b', 'c', 'd', 'e']) AS value FROM customer)
  SELECT id, key, CASE WHEN regexp_matches(key, 'api.?key|wandb.key|password|secret|access.?token|authorization', 'i') THEN '[REDACTED]' ELSE value END AS value FROM k""")
def prj7_redacted(spark, d):
    keys = F.array(*map(N, ("api_key", "n_tokens", "authorization", "wandb-key", "access.token", "keyboard", "DB_PASSWORD")))
    m = F.map_from_arrays(keys, F.array(F.col("c_name"), N("a"), F.col("c_mktsegment"), N("b"), N("c"), N("d"), N("e")))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(scalar.redacted(m)))


@query("""SELECT c_custkey AS id, '--lr=1 --api-key=[REDACTED] --secret [REDACTED] ' || c_mktsegment || ' --token x' AS argv FROM customer""")
def prj7_redacted_arguments(spark, d):
    argv = F.array(N("--lr=1"), N("--api-key=k1"), N("--secret"), F.col("c_name"), F.col("c_mktsegment"), N("--token"), N("x"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(scalar.redacted_arguments(argv), " ").alias("argv"))


@query(f"""WITH {STEPS}, h AS (SELECT episode_id, step, position, list(action) OVER w AS history FROM steps WINDOW w AS (PARTITION BY episode_id, position ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT episode_id, step, coalesce(array_to_string(list_sort(list_distinct(history)), ''), '') AS tried, coalesce(len(list_filter(history, lambda x: x = 'U')), 0) AS ups, coalesce(history[1], '') AS first FROM h""")
def prj8_exit_history(spark, d):
    w = Window.partitionBy("episode_id", "position").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    h = steps(spark, d).withColumn("history", F.collect_list("action").over(w))
    counts = records.exit_counts(F.col("history"))
    tried = F.array_distinct("history")
    return h.select("episode_id", "step", F.array_join(F.array_sort(tried), "").alias("tried"), F.coalesce(counts["U"], N(0)).cast("long").alias("ups"), F.coalesce(F.get(tried, N(0)), N("")).alias("first"))


@query("""WITH c AS (SELECT l_orderkey, l_partkey, list_filter(['U', 'D', 'L', 'R'], lambda m: (l_suppkey // (CASE m WHEN 'U' THEN 1 WHEN 'D' THEN 2 WHEN 'L' THEN 4 ELSE 8 END)) % 2 = 1) AS open, list_transform(range(0, l_linenumber % 5), lambda i: substr('UDLR', ((l_partkey + i * 3) % 4 + 1)::INT, 1)) AS tried, substr('UDLR', (l_partkey % 4 + 1)::INT, 1) AS last FROM lineitem),
  b AS (SELECT *, list_filter(open, lambda m: len(list_filter(tried, lambda t: t = m)) = list_min(list_transform(open, lambda n: len(list_filter(tried, lambda t: t = n))))) AS best FROM c),
  u AS (SELECT *, list_filter(best, lambda m: m <> translate(last, 'UDLR', 'DURL')) AS without FROM b) SELECT l_orderkey, l_partkey, array_to_string(CASE WHEN len(without) > 0 THEN without ELSE best END, '') AS preferred FROM u""")
def prj9_preferred_moves(spark, d):
    s = F.col("l_suppkey")
    open_ = F.filter(F.array(*map(N, records.MOVES)), lambda m: F.floor(s / F.when(m == "U", 1).when(m == "D", 2).when(m == "L", 4).otherwise(8)) % 2 == 1)
    n = F.col("l_linenumber") % 5
    tried = F.when(n > 0, F.transform(F.sequence(N(0), n - 1), lambda i: F.substring(N("UDLR"), ((F.col("l_partkey") + i * 3) % 4 + 1).cast("int"), N(1)))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", open_.alias("open"), tried.alias("tried"), F.substring(N("UDLR"), (F.col("l_partkey") % 4 + 1).cast("int"), N(1)).alias("last"))
    return rows.select("l_orderkey", "l_partkey", F.array_join(records.preferred_moves(F.col("open"), F.col("tried"), F.col("last")), "").alias("preferred"))


@query("""WITH u AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'system') AS system, arg_min(text, turn) FILTER (role = 'user') AS said FROM conversations GROUP BY 1)
  SELECT conv_id, coalesce(system, '') AS system, coalesce(said || chr(10) || 'part ' || conv_id, '') AS first_user, ['up', 'down', 'left', 'right', 'stay'][(conv_id % 5 + 1)::INT] AS answer FROM u""")
def prj10_chat_rows(spark, d):
    part = lambda kind, text: F.struct(N(kind).alias("type"), text.alias("text"))
    parts = F.array(part("text", F.col("text")), part("image", N("i.png")), part("text", N("")), part("text", F.concat(N("part "), F.col("conv_id").cast("string"))))
    parts = F.when(F.col("role") == "user", parts).otherwise(F.array(part("text", F.col("text"))))
    chats = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", parts.alias("parts")))).alias("messages"))
    answer = F.concat(N(" "), F.upper(F.element_at(F.array(*map(N, scalar.WORDS)), (F.col("conv_id") % 5 + 1).cast("int"))), N(" "))
    text = lambda role: F.coalesce(records.first_text(F.col("messages"), role), N(""))
    return chats.select("conv_id", text("system").alias("system"), text("user").alias("first_user"), records.known_answer(answer, scalar.WORDS, F.col("conv_id")).alias("answer"))


@query(f"""WITH {STEPS} SELECT episode_id, count(*) AS n, string_agg(step || action, ',' ORDER BY step) AS requests, sum(delta)::BIGINT AS total FROM steps GROUP BY 1""")
def prj11_reprojected(spark, d):
    from ..operators.records import blocks

    b = blocks(steps(spark, d), "episode_id", "step", request=["step", "action"], result=["delta", "position"])
    total = F.aggregate(F.col("steps"), N(0).cast("long"), lambda s, x: s + x["result"]["delta"])
    return b.select("episode_id", F.size("steps").cast("long").alias("n"), F.array_join(F.transform("steps", lambda x: F.concat(x["request"]["step"].cast("string"), x["request"]["action"])), ",").alias("requests"), total.alias("total"))


@query(f"""WITH {STEPS} SELECT episode_id, step, sha256('State: {{"last":"' || action || '","position":' || position || '}}' || chr(10) || 'Choose one of ["U","D"].') AS prompt_sha256 FROM steps""")
def prj12_val6_prompt_hashes(spark, d):
    state = records.canonical_json(last=F.col("action"), position=F.col("position"))
    prompt = F.format_string("State: %s\nChoose one of %s.", state, F.to_json(F.array(N("U"), N("D"))))
    return steps(spark, d).select("episode_id", "step", F.sha2(prompt, 256).alias("prompt_sha256"))


@query("""WITH m AS (SELECT 'open-mask-' || lpad(k::VARCHAR, 2, '0') AS case, array_to_string(list_filter(['U', 'D', 'L', 'R'], lambda x: (k >> (CASE x WHEN 'U' THEN 0 WHEN 'D' THEN 1 WHEN 'L' THEN 2 ELSE 3 END)) & 1 = 1), '') AS value FROM range(1, 16) r(k)),
  a AS (SELECT unnest(['U', 'D', 'L', 'R']) AS x, unnest([0, 1, 2, 3]) AS i), p AS (SELECT row_number() OVER (ORDER BY a.i, b.i, c.i, e.i) - 1 AS n, a.x || b.x || c.x || e.x AS value FROM a, a b, a c, a e WHERE len(list_distinct([a.x, b.x, c.x, e.x])) = 4),
  k AS (SELECT * FROM m UNION ALL SELECT 'history-order-' || lpad(n::VARCHAR, 2, '0'), value FROM p),
  seen AS (SELECT string_agg(action, '' ORDER BY first, action) AS value, count(*) AS moves FROM (SELECT l_orderkey, substr('UDLR', (l_partkey % 4 + 1)::INT, 1) AS action, min(l_linenumber) AS first FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey),
  masks AS (SELECT array_to_string(list_filter(['U', 'D', 'L', 'R'], lambda x: contains(value, x)), '') AS value, count(*) AS n FROM seen GROUP BY 1), orders_ AS (SELECT value, count(*) AS n FROM seen WHERE moves = 4 GROUP BY 1)
  SELECT k.case, k.value, coalesce(CASE WHEN k.case LIKE 'open%' THEN masks.n ELSE orders_.n END, 0) AS n FROM k LEFT JOIN masks ON masks.value = k.value LEFT JOIN orders_ ON orders_.value = k.value""")
def prj13_boundary_cases(spark, d):
    """How often the recorded orders' moves meet each case: the set of moves that one has, and the order in which it first made all four."""
    from ..operators.records import boundary_coverage

    lines = table(spark, d, "lineitem").select("l_orderkey", F.substring(N("UDLR"), (F.col("l_partkey") % 4 + 1).cast("int"), N(1)).alias("action"), "l_linenumber")
    return boundary_coverage(lines, "l_orderkey", "l_linenumber", "action")


# filters


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 = 1")
def flt1_split_and_tier(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("split"), (F.col("o_custkey") % 3).alias("tier"))
    return selection.matching(o, split="F", tier=1).select("o_orderkey", "o_custkey")


@query("""WITH s AS (SELECT l_orderkey, l_partkey, substr('UDLR', (l_partkey % 4 + 1)::INT, 1) AS action, CASE WHEN l_linenumber = 1 THEN l_quantity > 20 END AS flag, l_suppkey % 3 AS k FROM lineitem)
  SELECT l_orderkey, l_partkey, coalesce(flag, CASE k WHEN 0 THEN action IN ('U', 'L') WHEN 1 THEN false END, true) AS legal FROM s""")
def flt5_legal_actions(spark, d):
    k = F.col("l_suppkey") % 3
    seen = F.when(k == 0, "Turn 4\nLegal actions: U, L\nend").when(k == 1, "Legal actions:\n").otherwise("nothing listed")
    action = F.substring(N("UDLR"), (F.col("l_partkey") % 4 + 1).cast("int"), N(1))
    flag = F.when(F.col("l_linenumber") == 1, F.col("l_quantity") > 20)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", records.legal_action(flag, seen, action).alias("legal"))


@query(f"""WITH {EPISODES}, {STEPS}, e AS (SELECT episode_id, bool_or(delta > 0 AND position = 4) AS seen FROM steps GROUP BY 1)
  SELECT episode_id, terminal = 'cleared' AND n_steps % 3 = 0 AND coalesce(seen, false) AS verified FROM episodes LEFT JOIN e USING (episode_id)""")
def flt6_verified_wins(spark, d):
    event = F.when((F.col("delta") > 0) & (F.col("position") == 4), "level_cleared").otherwise("move")
    events = steps(spark, d).groupBy("episode_id").agg(F.collect_list(F.array(event)).alias("events"))
    e = episodes(spark, d).join(events, "episode_id", "left")
    reason = F.when(F.col("terminal") == "cleared", "all_normal_pellets").otherwise(F.col("terminal"))
    return e.select("episode_id", records.verified_win(F.col("terminal") == "cleared", reason, F.col("n_steps") % 3, F.col("events")).alias("verified"))


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_partkey % 5 > 0 AND 60 - p_partkey % 61 BETWEEN 0 AND 20 AND p_size % 13 > 0 AND p_size % 13 < 12")
def flt8_active_states(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 2 == 0).alias("qualified"), (F.col("p_partkey") % 5 > 0).alias("eligible"), (F.col("p_partkey") % 61).alias("measured"), (F.col("p_size") % 13).alias("wins"))
    return reports.active_states(p, 60, 12).select("p_partkey")


@query("""SELECT event_id, unnest(['perf/value', 'train/ok']) AS key, unnest([value, 1.5]) AS metric FROM events WHERE value IS NOT NULL AND event_id % 3 > 0 UNION ALL SELECT event_id, 'train/ok', 1.5 FROM events WHERE value IS NULL OR event_id % 3 = 0""")
def flt9_finite_metrics(spark, d):
    bad = F.when(F.col("event_id") % 3 == 0, N(float("nan"))).otherwise(F.col("value"))
    m = F.map_from_arrays(F.array(*map(N, ("perf/value", "plain", "train/ok", "train/inf"))), F.array(bad, N(2.0), N(1.5), N(float("inf"))))
    return table(spark, d, "events").select("event_id", F.explode(scalar.metrics_only(m)).alias("key", "metric"))


LOGS = """l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS line, CASE doc_id % 4 WHEN 0 THEN 'Train step ' || doc_id || ' done' WHEN 1 THEN 'task_reward avg ' || doc_id || '.5' ELSE 'noise' END AS text, doc_id // 40 AS file FROM documents)"""


def logs(spark, d) -> DataFrame:
    i = F.col("doc_id")
    text = F.when(i % 4 == 0, F.concat(N("\x1b[32mTrain step "), i, N("\x1b[0m done"))).when(i % 4 == 1, F.concat(N("task_reward avg "), i, N(".5 [repeated 7x across cluster]"))).otherwise("noise")
    return table(spark, d, "documents").select("doc_id", F.expr("doc_id div 40").alias("file"), scalar.clean_line(text).alias("text"))


@query(f"""WITH {LOGS}, m AS (SELECT file, doc_id, text, CASE WHEN text LIKE 'Train step%' THEN doc_id END AS mark FROM l),
  c AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY file ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS step FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY file, step ORDER BY doc_id) AS k FROM c WHERE text LIKE 'task_reward%' AND step IS NOT NULL)
  SELECT step AS update, regexp_extract(text, 'avg ([0-9.]+)', 1)::DOUBLE AS reward FROM r WHERE k = 1""")
def flt10_fn10_src9_finished_steps(spark, d):
    """A reward counts for the step that finished before it, once."""
    step = F.nullif(F.regexp_extract("text", "Train step (\\d+) done", 1), N("")).cast("long")
    rows = ordered.as_of(logs(spark, d), "file", ["doc_id"], step, "update").where("update IS NOT NULL AND text LIKE 'task_reward%'")
    first = selection.first_of(rows, ["file", "update"], F.col("doc_id"))
    return first.select("update", F.regexp_extract("text", "avg ([0-9.]+)", 1).cast("double").alias("reward"))


# joins


@query("SELECT l.doc_id, quality, lang FROM labels l JOIN documents USING (doc_id)")
def jn1_labelled_rows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    return selection.strict_join(table(spark, d, "labels").select("doc_id", "quality"), rows, "doc_id")


@query("""SELECT 'labels' AS source, count(DISTINCT doc_id) AS ids, count(*) = count(DISTINCT doc_id) AS distinct_ids, count(*) = count(*) FILTER (doc_id IN (SELECT doc_id FROM documents)) AS known FROM labels
  UNION ALL SELECT 'orders', count(DISTINCT o_custkey), count(*) = count(DISTINCT o_custkey), count(*) = count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 50 > 0)) FROM orders""")
def jn7_known_ids(spark, d):
    """The labels' ids against the documents', and the customers that orders repeat against those that are left of them."""
    left = table(spark, d, "customer").where("c_custkey % 50 > 0").select(F.col("c_custkey").alias("id"))
    found = [selection.known_ids(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id"), selection.known_ids(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), left, "id")]
    return found[0].select(N("labels").alias("source"), "*").unionByName(found[1].select(N("orders").alias("source"), "*"))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) AS only_left, 0::BIGINT AS only_right")
def jn8_set8_key_sets(spark, d):
    return selection.key_differences(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("""WITH b AS (SELECT l_orderkey, list(struct_pack(y := l_partkey % 64, x := l_suppkey % 64)) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, len(list_filter(range(1, len(b)), lambda i: len(list_filter(range(i + 1, len(b) + 1), lambda j: abs(b[j].y - b[i].y) < 16 AND abs(b[j].x - b[i].x) < 16)) > 0)) > 0 AS overlap FROM b""")
def jn11_overlapping_boxes(spark, d):
    boxes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_partkey") % 64).alias("y"), (F.col("l_suppkey") % 64).alias("x"))).alias("b"))
    return boxes.select("l_orderkey", records.overlapping(F.col("b"), 16).alias("overlap"))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT user_id, event_id % 997 AS step FROM events), p AS (SELECT user_id, min(step) AS step FROM s GROUP BY 1 UNION ALL SELECT p.user_id, (SELECT min(s.step) FROM s WHERE s.user_id = p.user_id AND s.step >= p.step + 8) FROM p WHERE p.step IS NOT NULL) SELECT user_id, step FROM p WHERE step IS NOT NULL""")
def jn13_step_gaps(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.col("event_id") % 997)).alias("steps"))
    return s.select("user_id", F.explode(records.spread_picks(F.col("steps"), 8)).alias("step"))


@query("""WITH f AS (SELECT o_orderstatus AS run, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders), b AS (SELECT run, pos // 16 AS batch, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM f GROUP BY 1, 2),
  u AS (SELECT ['F', 'O', 'P'][(c_custkey % 3 + 1)::INT] AS run, c_custkey * 10 AS update, row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_custkey) - 1 AS batch FROM customer WHERE c_custkey % 5 > 0) SELECT run, update, n, total FROM b JOIN u USING (run, batch) WHERE n = 16""")
def jn16_src8_batches_by_position(spark, d):
    """The i-th batch of 16 files of a run belongs to its i-th finished update; a batch that is not full, and one without an update, have none."""
    files = table(spark, d, "orders").select(F.col("o_orderstatus").alias("run"), "o_orderdate", "o_orderkey", "o_totalprice")
    key = F.col("c_custkey")
    updates = table(spark, d, "customer").where("c_custkey % 5 > 0").select(F.element_at(F.array(N("F"), N("O"), N("P")), (key % 3 + 1).cast("int")).alias("run"), (key * 10).alias("update"))
    found = ordered.batches_of_updates(files, updates, "run", ["o_orderdate", "o_orderkey"], ["update"], 16, F.round(F.sum("o_totalprice"), 2).alias("total"))
    return found.select("run", "update", "n", "total")


# order


OPTIONS = f"""{STEPS}, o AS (SELECT episode_id, step, action AS code, (episode_id + step) % 6 = 0 AS called, CASE WHEN (episode_id * step) % 5 = 0 THEN step + 7 ELSE (step - 1) % 3 + 1 END AS option_step, (step - 1) // 3 AS option_id, step % 3 = 0 AS ends FROM steps)"""


@query(f"""WITH {OPTIONS}, l AS (SELECT *, lag(option_step) OVER w AS ls, lag(option_id) OVER w AS li, coalesce(lag(ends) OVER w, true) AS le FROM o WINDOW w AS (PARTITION BY episode_id ORDER BY step))
  SELECT episode_id, step FROM l WHERE CASE WHEN option_step = 1 THEN NOT le ELSE le OR option_id IS DISTINCT FROM li OR option_step <> ls + 1 END""")
def seq3_val15_option_continuity(spark, d):
    s = steps(spark, d)
    step = F.col("step")
    own = s.select("episode_id", "step", F.when(F.col("episode_id") * step % 5 == 0, step + 7).otherwise((step - 1) % 3 + 1).alias("option_step"), F.expr("(step - 1) div 3").alias("option_id"), (step % 3 == 0).alias("ends"))
    return ordered.broken_options(own, ["option_id"]).select("episode_id", "step")


@query(f"""WITH {STEPS}, c AS (SELECT episode_id, step, sum(delta) OVER w AS score, sum((position = 0)::INT) OVER w AS eaten FROM steps WINDOW w AS (PARTITION BY episode_id ORDER BY step)),
  g AS (SELECT *, CASE WHEN score <> coalesce(lag(score) OVER w, 0) OR eaten <> coalesce(lag(eaten) OVER w, 0) THEN 1 ELSE 0 END AS gain FROM c WINDOW w AS (PARTITION BY episode_id ORDER BY step)),
  i AS (SELECT *, sum(gain) OVER (PARTITION BY episode_id ORDER BY step) AS island FROM g) SELECT episode_id, step, (count(*) FILTER (gain = 0) OVER (PARTITION BY episode_id, island ORDER BY step))::BIGINT AS idle FROM i""")
def seq5_no_progress(spark, d):
    w = ordered.by_step().rowsBetween(Window.unboundedPreceding, 0)
    s = steps(spark, d).withColumns({"score": F.sum("delta").over(w), "eaten": F.sum((F.col("position") == 0).cast("int")).over(w)})
    return ordered.idle_counter(s, ["score", "eaten"]).select("episode_id", "step", "idle")


@query(f"""WITH {STEPS}, n AS (SELECT episode_id, step - 1 AS i, count(*) OVER (PARTITION BY episode_id) AS n, position || action AS state, episode_id % 2 = 0 AS died FROM steps),
  p AS (SELECT episode_id, state, i, n - 1 - i AS distance, CASE WHEN i > 0 AND i = n // 6 THEN 'early_1/6 ' ELSE '' END || CASE WHEN i > 0 AND i = n // 3 THEN 'early_1/3 ' ELSE '' END || CASE WHEN died AND n - 1 - i IN (1, 2, 4) THEN 'death_before_' || (n - 1 - i) || ' ' ELSE '' END AS origins FROM n)
  SELECT episode_id, state, count(*) AS positions, min(i) AS first, max_by(distance, -i) AS distance, string_agg(trim(origins), ',' ORDER BY i) AS origins FROM p WHERE origins <> '' GROUP BY 1, 2""")
def seq10_route_captures(spark, d):
    s = steps(spark, d).select("episode_id", (F.col("step") - 1).alias("i"), F.concat(F.col("position").cast("string"), "action").alias("state"), (F.col("episode_id") % 2 == 0).alias("died"))
    found = ordered.route_captures(s, "episode_id", "i", "state", F.col("died"), (1, 2, 4))
    return found.select("episode_id", "state", F.size("sources").cast("long").alias("positions"), F.get("sources", N(0))["i"].alias("first"), F.get("sources", N(0))["distance"].alias("distance"), F.array_join(F.transform("sources", lambda x: F.array_join(x["origins"], " ")), ",").alias("origins"))


@query(f"""WITH {STEPS}, c AS (SELECT * FROM steps WHERE position > 1), l AS (SELECT episode_id, step, action <> lag(action) OVER w OR position <> lag(position) OVER w AS s FROM c WINDOW w AS (PARTITION BY episode_id ORDER BY step)) SELECT episode_id, count(*) AS calls, count(*) FILTER (s) AS switches FROM l GROUP BY 1""")
def seq12_objective_switches(spark, d):
    return ordered.switches(steps(spark, d).where("position > 1"), ["action", "position"])


@query("""WITH a AS (SELECT p_brand AS k, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, 0 AS side FROM part WHERE p_size % 2 = 0), b AS (SELECT p_brand AS k, p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n, 1 AS side FROM part WHERE p_size % 2 = 1),
  u AS (SELECT a.k, a.id, a.n, a.side FROM a SEMI JOIN b USING (k, n) UNION ALL SELECT b.k, b.id, b.n, b.side FROM b SEMI JOIN a USING (k, n)) SELECT k AS brand, id, 2 * (n - 1) + side AS place FROM u""")
def seq14_alternating_zip(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), "p_size")
    return ordered.zipped(p.where("p_size % 2 = 0").drop("p_size"), p.where("p_size % 2 = 1").drop("p_size"), "brand", ["id"])


@query("SELECT p_brand, p_partkey, CASE WHEN (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 3 = 2 THEN 'validation' ELSE 'train' END AS split FROM part")
def seq15_every_third(spark, d):
    return ordered.every_third(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", ["p_partkey"])


# selection


RISK = "r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, ['clear_estimate', 'unknown', 'collision_predicted'][(l_partkey % 3 + 1)::INT] AS motion, l_suppkey % 7 AS margin, CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 9 END AS clearance, l_linenumber % 4 AS exits, l_partkey % 2 = 0 AS dead_end, l_suppkey % 2 = 0 AS reverse FROM lineitem)"


@query(f"""WITH {RISK} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE motion WHEN 'clear_estimate' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, -margin, -coalesce(clearance, 1000000), -exits, dead_end, reverse, l_linenumber, l_partkey, l_suppkey) AS rank FROM r""")
def sel16_risk_ranking(spark, d):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    motion = F.element_at(F.array(*map(N, ("clear_estimate", "unknown", "collision_predicted"))), (p % 3 + 1).cast("int"))
    r = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", motion.alias("motion"), (s % 7).alias("margin"), F.when(p % 5 > 0, p % 9).alias("clearance"), (F.col("l_linenumber") % 4).alias("exits"), (p % 2 == 0).alias("dead_end"), (s % 2 == 0).alias("reverse"))
    return selection.risk_ranked(r, "l_orderkey", F.col("l_linenumber"), p, s).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "rank")


@query("""SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY NOT (3 * (p_size % 7) <= p_size AND p_size % 7 > 0), -(p_partkey % 11), p_partkey) AS place FROM part""")
def sel17_probe_order(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey", ((3 * (F.col("p_size") % 7) <= F.col("p_size")) & (F.col("p_size") % 7 > 0)).alias("early"), (F.col("p_partkey") % 11).alias("distance"))
    return selection.placed(p, "p_brand", F.col("early").desc(), F.col("distance").desc(), F.col("p_partkey")).select("p_brand", "p_partkey", "place")


@query("""SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY -coalesce(CASE WHEN p_size % 3 = 0 THEN p_size % 5 END, (p_size % 13 = 0)::INT), p_partkey % 17, p_partkey) AS place FROM part""")
def sel18_reprobe_order(spark, d):
    size = F.col("p_size")
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.coalesce(F.when(size % 3 == 0, size % 5), (size % 13 == 0).cast("int")).alias("priority"), (F.col("p_partkey") % 17).alias("measured"))
    return selection.placed(p, "p_brand", F.col("priority").desc(), F.col("measured"), F.col("p_partkey")).select("p_brand", "p_partkey", "place")


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN 'ELIMINATE' WHEN o_orderkey % 5 < 3 THEN 'COLLECT' WHEN o_orderkey % 5 = 3 THEN 'AVOID' ELSE 'OTHER' END AS strategy FROM orders) SELECT o_custkey, arg_min(o_orderkey, {'c': CASE strategy WHEN 'ELIMINATE' THEN 0 WHEN 'COLLECT' THEN 1 WHEN 'AVOID' THEN 2 ELSE 3 END, 'k': o_orderkey}) AS chosen FROM c GROUP BY 1""")
def sel19_priority_choice(spark, d):
    at = F.col("o_orderkey") % 5
    c = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(at == 0, "ELIMINATE").when(at < 3, "COLLECT").when(at == 3, "AVOID").otherwise("OTHER").alias("strategy"))
    return selection.first_strategy(c, "o_custkey", "strategy", ("ELIMINATE", "COLLECT", "AVOID"), "o_orderkey").withColumnRenamed("o_orderkey", "chosen")


@query("SELECT episode_id, step FROM (SELECT l_orderkey AS episode_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS step FROM lineitem) WHERE step <= 3")
def sel20_limited_steps(spark, d):
    return reports.limited(steps(spark, d), "step", 3).select("episode_id", "step")


@query("""WITH n AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('11|' || p_partkey), p_partkey) - 1 AS i FROM part) SELECT p_brand, p_partkey, i // 8 AS batch FROM n""")
def sel24_shuffled_batches(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_partkey").withColumn("_h", F.sha2(F.concat_ws("|", N("11"), F.col("p_partkey").cast("string")), 256))
    return ordered.chunked(p, "p_brand", ["_h", "p_partkey"], 8, "batch").drop("_h")


# sets


@query("""WITH s AS (SELECT DISTINCT o_orderstatus AS split, o_custkey % 200 AS seed FROM orders WHERE (o_orderstatus = 'F' AND o_custkey % 200 < 120) OR (o_orderstatus = 'O' AND o_custkey % 200 >= 100) OR o_orderstatus = 'P') SELECT seed, count(*) AS splits FROM s GROUP BY 1 HAVING count(*) > 1""")
def set1_shared_seeds(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("split"), (F.col("o_custkey") % 200).alias("seed"))
    kept = o.where("(split = 'F' AND seed < 120) OR (split = 'O' AND seed >= 100) OR split = 'P'")
    return selection.leaking(kept, "seed", "split").select("seed", "splits")


@query("""WITH p AS (SELECT p_partkey, sha256(p_brand || p_type) AS frame, CASE p_partkey % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS role FROM part),
  f AS (SELECT frame, min(CASE role WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END) AS best FROM p GROUP BY 1) SELECT p_partkey, role FROM p JOIN f USING (frame) WHERE best = CASE role WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END""")
def set3_reserved_by_role(spark, d):
    at = F.col("p_partkey") % 4
    p = table(spark, d, "part").select("p_partkey", F.sha2(F.concat("p_brand", "p_type"), 256).alias("frame"), F.when(at == 0, "test").when(at == 1, "validation").otherwise("train").alias("role"))
    return selection.reserved_in_turn(p, "frame", "role", ("test", "validation", "train")).select("p_partkey", "role")


# functions


@query("""SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"id":' || o_orderkey || ',"open":' || (o_custkey % 2 = 0) || ',"split":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END || '}') AS digest FROM orders""")
def fn1_canonical_json(spark, d):
    text = records.canonical_json(split=F.nullif(F.col("o_orderstatus"), N("P")), id=F.col("o_orderkey"), custkey=F.col("o_custkey"), open=F.col("o_custkey") % 2 == 0)
    return table(spark, d, "orders").select("o_orderkey", F.sha2(text, 256).alias("digest"))


@query("""WITH h AS (SELECT o_orderkey, sha256('7|' || o_orderkey) AS h FROM orders), b AS (SELECT o_orderkey, list_transform(range(0, 8), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM h) SELECT o_orderkey, (b[1] + b[2] * 256 + b[3] * 65536 + b[4] * 16777216)::BIGINT AS low, (b[5] + b[6] * 256 + b[7] * 65536 + b[8] * 16777216)::BIGINT AS high FROM b""")
def fn3_little_endian_seeds(spark, d):
    seed = scalar.seed64_little(F.concat(N("7|"), F.col("o_orderkey").cast("string")))
    big = N(1 << 32).cast("decimal(20,0)")
    return table(spark, d, "orders").select("o_orderkey", seed.alias("s")).select("o_orderkey", (F.col("s") % big).cast("long").alias("low"), F.floor(F.col("s") / big).cast("long").alias("high"))


@query("""WITH k AS (SELECT p_partkey, list_sort(list_distinct(['C' || p_size % 3, 'A' || p_size % 2, 'E0', 'C9'])) AS ids FROM part), o AS (SELECT p_partkey, ids, list_transform(list_sort(list_transform(ids, lambda i: struct_pack(h := sha256(p_partkey || ':order:' || i), i := i))), lambda t: t.i) AS ordered, list_transform(list_sort(list_transform(['0', '1', '2', '3', '4'], lambda c: struct_pack(h := sha256(p_partkey || ':code:' || c), i := c))), lambda t: t.i) AS codes FROM k)
  SELECT p_partkey, array_to_string(ordered, ',') AS ordered, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: ids[i] || codes[i]), ',') AS mapping FROM o""")
def fn5_hash_permutations(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    ids = F.array(F.concat(N("C"), size % 3), F.concat(N("A"), size % 2), N("E0"), N("C9"))
    mapping = records.shuffled_codes(ids, key, tuple("01234"))
    return table(spark, d, "part").select("p_partkey", F.array_join(records.hash_order(ids, key, "order"), ",").alias("ordered"), F.array_join(F.transform(F.map_entries(mapping), lambda e: F.concat(e["key"], e["value"])), ",").alias("mapping"))


@query("SELECT p_partkey, ['C0', 'A1', 'E2'][(p_size % 3 + 1)::INT] AS option FROM part")
def fn13_decoded_options(spark, d):
    codes = F.array(*map(N, "xyz"))
    return table(spark, d, "part").select("p_partkey", records.decoded_option(F.get(codes, (F.col("p_size") % 3).cast("int")), codes, F.array(N("C0"), N("A1"), N("E2"))).alias("option"))


METRICS = """m AS (SELECT event_id, event_id // 8 AS step, CASE WHEN event_id % 8 = 7 THEN NULL ELSE event_id % 100 / 4 END AS loss, event_id % 13 AS n FROM events)"""


@query(f"""WITH {METRICS}, k AS (SELECT step, event_id, unnest(['train/loss', 'perf/n']) AS key, unnest([loss, n::DOUBLE]) AS value FROM m) SELECT step, key, arg_max(value, event_id) AS value FROM k WHERE value IS NOT NULL GROUP BY 1, 2""")
def fn11_ag23_log_literals(spark, d):
    """Metrics of log lines with Python dicts; of one step the later line wins, key by key."""
    i = F.col("event_id")
    loss = F.when(i % 8 == 7, "nan").otherwise((i % 100 / 4).cast("string"))
    line = F.concat(N("\x1b[1mstep "), F.expr("event_id div 8").cast("string"), N(": {'train/loss': "), loss, N(", 'plain': 3, 'perf/n': "), (i % 13).cast("string"), N(", 'perf/up': True, 'perf/text': 'x'} [repeated 2x across cluster]"))
    clean = scalar.clean_line(line)
    rows = table(spark, d, "events").select("event_id", F.regexp_extract(clean, "step (\\d+):", 1).cast("long").alias("step"), records.literal_metrics(F.regexp_extract(clean, "(\\{.*\\})\\s*$", 1)).alias("m"))
    # an outer explode: for a plain one Spark infers a filter, in which the map would be made a second time
    flat = rows.select("event_id", "step", F.explode_outer("m").alias("key", "value")).where("key IS NOT NULL")
    return flat.groupBy("step", "key").agg(F.max_by("value", "event_id").alias("value"))


@query("SELECT event_id, [true, false, false, true, false, false][(event_id % 6 + 1)::INT] AS same FROM events")
def fn14_typed_equality(spark, d):
    pairs = (('{"a":1,"b":[2]}', '{"b":[2],"a":1}'), ('{"a":1}', '{"a":1.0}'), ('{"a":1}', '{"a":true}'), ("[1,[null]]", "[1, [null]]"), ('{"a":1}', "broken"), ("[1,2]", "[2,1]"))
    at = F.col("event_id") % 6
    side = lambda k: F.coalesce(*(F.when(at == i, N(p[k])) for i, p in enumerate(pairs)))
    return table(spark, d, "events").select("event_id", records.same_typed(side(0), side(1)).alias("same"))


BOARD = """c AS (SELECT p_partkey AS id, list_transform(range(0, 12), lambda i: CASE WHEN i = p_partkey % 12 THEN 'P' ELSE substr('#.o -', ((p_partkey * (i + 3)) % 5 + 1)::INT, 1) END) AS t FROM part),
  q AS (SELECT id, t, CASE WHEN id % 7 > 0 THEN list_transform(range(0, 12), lambda i: CASE WHEN id % 3 = 0 AND i = (id * 5) % 12 THEN 'o' WHEN id % 11 = 0 AND i = (id + 1) % 12 THEN 'P' WHEN id % 11 = 0 AND i = id % 12 THEN '.' ELSE t[i + 1] END) END AS p FROM c)"""


def board(spark, d) -> DataFrame:
    i, k = F.col("id"), lambda r, c: r * 4 + c
    truth = lambda n: F.when(n == i % 12, "P").otherwise(F.substring(N("#.o -"), ((i * (n + 3)) % 5 + 1).cast("int"), N(1)))
    guess = lambda n: F.when((i % 3 == 0) & (n == i * 5 % 12), "o").when((i % 11 == 0) & (n == (i + 1) % 12), "P").when((i % 11 == 0) & (n == i % 12), ".").otherwise(truth(n))
    rows = lambda f: F.transform(F.sequence(N(0), N(2)), lambda r: F.array_join(F.transform(F.sequence(N(0), N(3)), lambda c: f(k(r, c))), ""))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return p.select("id", rows(truth).alias("truth"), F.when(i % 7 > 0, rows(guess)).otherwise(F.slice(rows(guess), 1, 2)).alias("guess"))


@query(f"""WITH {BOARD} SELECT id, p IS NOT NULL AS valid, coalesce(p = t, false) AS exact, CASE WHEN p IS NULL THEN 0 ELSE len(list_filter(range(1, 13), lambda i: p[i] = t[i])) END AS cell_correct, 12::BIGINT AS cell_total,
  CASE WHEN p IS NOT NULL AND (p[id % 12 + 1] = 'P' OR p[(id + 1) % 12 + 1] = 'P') THEN 1 ELSE 0 END::BIGINT AS actors_found,
  coalesce(len(list_filter(range(0, 12), lambda i: i <> id % 12 AND i <> (id + 1) % 12 AND p[i + 1] <> t[i + 1])) = 0 AND (p[id % 12 + 1] = 'P' OR p[(id + 1) % 12 + 1] = 'P') AND len(list_filter(p, lambda x: x = 'P')) = 1, false) AS exact_tolerant FROM q""")
def fn15_fn16_fn17_board_scores(spark, d):
    i = F.col("id")
    b = board(spark, d)
    coded = b.withColumn("guess", records.decoded_board(records.spaced_rows(F.col("guess")), N(3), N(4)))
    at = (i % 12).cast("int")
    actors = F.array(F.struct(N("P").alias("symbol"), at.alias("cell"), F.array(at, ((i + 1) % 12).cast("int")).alias("box")))
    scores = records.board_score(F.col("guess"), F.col("truth"), N(4), actors)
    return coded.select("id", *(c.alias(n) for n, c in scores.items()))


@query(f"""WITH {BOARD}, o AS (SELECT id, list_transform(range(0, 12), lambda i: CASE WHEN i = (id * 3) % 12 THEN CASE WHEN id % 2 = 0 THEN 'G' ELSE 'V' END WHEN i = (id * 7) % 12 THEN 'E' ELSE t[i + 1] END) AS s FROM c) SELECT id, array_to_string(s[1:4], '') || '/' || array_to_string(s[5:8], '') || '/' || array_to_string(s[9:12], '') AS shown FROM o""")
def fn18_overlays(spark, d):
    """Two actors share a cell: the one with more pixels is shown, the first one if both show as many."""
    i = F.col("id")
    actor = lambda s, cell, pixels: F.struct(N(s).alias("symbol"), F.floor(cell / 4).cast("int").alias("r"), (cell % 4).cast("int").alias("c"), pixels.alias("pixels"))
    actors = F.array(actor("E", i * 7 % 12, N(3)), actor("G", i * 3 % 12, N(9)), actor("V", i * 3 % 12, F.when(i % 2 == 0, 9).otherwise(10)))
    return board(spark, d).select("id", F.array_join(records.overlaid(F.col("truth"), actors), "/").alias("shown"))


@query(f"""WITH {BOARD}, s AS (SELECT id, array_to_string(t[1:4], '') || chr(10) || array_to_string(t[5:8], '') || chr(10) || array_to_string(t[9:12], '') AS text FROM c) SELECT id, sha256(text) AS layout, sha256(regexp_replace(text, '[^#' || chr(10) || ']', ' ', 'g')) AS topology FROM s""")
def fn20_layout_hashes(spark, d):
    return board(spark, d).select("id", records.layout_hash(F.col("truth")).alias("layout"), records.topology_hash(F.col("truth")).alias("topology"))


@query(f"""WITH {BOARD}, x AS (SELECT *, (id % 12) // 4 AS r, id % 4 AS c, list_transform(t, lambda v: CASE v WHEN '#' THEN 'wall' WHEN '-' THEN 'door' ELSE 'open' END) AS k FROM c) SELECT id, CASE WHEN r > 0 THEN k[r * 4 + c - 3] ELSE 'wall' END AS "U", CASE WHEN r < 2 THEN k[r * 4 + c + 5] ELSE 'wall' END AS "D", CASE WHEN c > 0 THEN k[r * 4 + c] ELSE 'wall' END AS "L", CASE WHEN c < 3 THEN k[r * 4 + c + 2] ELSE 'wall' END AS "R",
  len(list_filter(range(0, 12), lambda i: abs(i // 4 - r) <= 1 AND abs(i % 4 - c) <= 1 AND t[i + 1] = '.')) AS dots, abs(r - 2) + abs(c - 1) AS manhattan FROM x""")
def fn21_neighbourhoods(spark, d):
    r, c = F.floor(F.col("id") % 12 / 4), F.col("id") % 4
    rows = F.col("truth")
    return board(spark, d).select("id", *(x.alias(n) for n, x in records.neighbours(rows, r, c).items()), records.region_count(rows, r.cast("int"), c.cast("int"), 1, ".").alias("dots"), (F.abs(r - 2) + F.abs(c - 1)).cast("long").alias("manhattan"))


@query("""WITH a AS (SELECT l_orderkey, min(n) AS n FROM (SELECT l_orderkey, 64 + l_partkey % 200 AS n FROM lineitem) GROUP BY 1), k AS (SELECT l_orderkey, count(DISTINCT l_partkey % 200) AS k, min(64 + l_partkey % 200) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, (n // 64 * 64)::BIGINT AS prefix FROM k""")
def fn22_shared_prefixes(spark, d):
    """Token lists that agree up to the shortest of them, in blocks of 64."""
    ids = F.sequence(N(1), (64 + F.col("l_partkey") % 200).cast("int"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(ids).alias("rows"))
    return rows.select("l_orderkey", records.common_prefix_of(F.col("rows")).alias("prefix"))


@query("""SELECT o_orderkey, sha256('{"a":' || o_custkey || ',"b":[' || o_orderkey % 5 || ',null]}') AS fingerprint FROM orders""")
def fn23_state_fingerprints(spark, d):
    a, b = F.concat(N('"a": '), F.col("o_custkey").cast("string")), F.concat(N('"b": ['), (F.col("o_orderkey") % 5).cast("string"), N(", null]"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(N("{"), a, N(", "), b, N("}"))).otherwise(F.concat(N("{ "), b, N(","), a, N("}")))
    return table(spark, d, "orders").select("o_orderkey", records.fingerprint(text).alias("fingerprint"))


@query(f"""WITH {STEPS}, f AS (SELECT episode_id, action, min(step) AS first FROM steps GROUP BY 1, 2) SELECT episode_id, string_agg(action, '' ORDER BY first) AS kinds FROM f GROUP BY 1""")
def fn24_ordered_distinct(spark, d):
    lists = steps(spark, d).groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("step", "action"))).alias("l"))
    return lists.select("episode_id", F.array_join(F.array_distinct(F.transform("l", lambda x: x["action"])), "").alias("kinds"))


@query("""WITH c AS (SELECT p_partkey AS id, [p_brand, reverse(p_brand)] AS rows FROM (SELECT p_partkey, substr(p_brand || 'xyz', 1, 2) AS p_brand FROM part)), v AS (SELECT id, rows[1][1] AS a, rows[1][2] AS b, rows[2][1] AS c, rows[2][2] AS d FROM c) SELECT id, list_min([a||b||'/'||c||d, b||a||'/'||d||c, c||d||'/'||a||b, d||c||'/'||b||a, a||c||'/'||b||d, c||a||'/'||d||b, b||d||'/'||a||c, d||b||'/'||c||a]) AS canonical FROM v""")
def fn19_canonical_layouts(spark, d):
    from ..operators import grids

    two = F.substring(F.concat("p_brand", N("xyz")), 1, 2)
    return grids.canonical_layouts(table(spark, d, "part").select(F.col("p_partkey").alias("map_id"), F.array(two, F.reverse(two)).alias("rows"))).withColumnRenamed("map_id", "id")


@query("SELECT l_orderkey, l_partkey, round(least(exp(l_discount * 20), 2.0), 6)::DOUBLE AS weight, exp(l_discount * 20) > 2 AS cut FROM lineitem")
def nm17_truncated_weights(spark, d):
    from ..functions import statistics

    r = F.exp(F.col("l_discount") * 20)
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.round(statistics.truncated_weight(r), 6).alias("weight"), (r > 2).alias("cut"))
