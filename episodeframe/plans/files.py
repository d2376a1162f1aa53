"""Queries of readers and sinks: rows of a test table are written to the shared folder as the files in question and read again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..sources import growing, readers, sinks
from ..sources.bindings import EPISODES, STEPS, episodes, steps, table
from .core import query

L = F.lit


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, by the file system of the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def nations(spark, d) -> list:
    """25 rows: few enough to be written one file each."""
    return sorted(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect())


def nation_files(spark, d, name: str) -> str:
    path = sinks.shared_path(spark, name)
    for r in nations(spark, d):
        put(spark, f"{path}/{r.n_nationkey}--sample-{r.n_regionkey + (r.n_nationkey == 7)}.json", json.dumps({"id": str(r.n_nationkey), "trajectory_sample_id": str(r.n_regionkey), "won": r.n_nationkey % 2 == 0, "total_shaped_reward": r.n_nationkey / 4}, indent=1))
    return path


FILE = "id string, trajectory_sample_id string, won boolean, total_shaped_reward double"


@query("SELECT n_nationkey::VARCHAR AS id, n_nationkey % 2 = 0 AS won, n_nationkey / 4 AS reward, n_nationkey || '--sample-' || (n_regionkey + (n_nationkey = 7)::INT) || '.json' AS file FROM nation")
def src1_json_files(spark, d):
    return readers.json_files(spark, nation_files(spark, d, "src1"), FILE).select("id", "won", F.col("total_shaped_reward").alias("reward"), F.col("_file").alias("file"))


@query("SELECT count(*) AS files, true AS ordered, count(*) AS places FROM nation")
def src2_chronological_files(spark, d):
    """Places follow (time, name) without a gap."""
    from pyspark.sql import Window

    f = readers.chronological(readers.json_files(spark, nation_files(spark, d, "src2"), FILE))
    w = Window.orderBy("_place")  # 25 files
    stamp = F.struct("_modified", "_file")
    marked = f.withColumn("_ok", F.coalesce(F.lag(stamp).over(w) < stamp, L(True)))
    return marked.agg(F.count(L(1)).alias("files"), F.bool_and("_ok").alias("ordered"), F.max("_place").alias("places"))


@query("SELECT '7' AS id")
def src3_misnamed_files(spark, d):
    return readers.misnamed(readers.json_files(spark, nation_files(spark, d, "src3"), FILE)).select("id")


def orders_lines(spark, d, name: str) -> str:
    path = sinks.shared_path(spark, name)
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    line = F.to_json(F.struct("o_orderkey", "o_orderstatus"))
    o.select(F.explode(F.array(line, L(" "))).alias("value")).write.text(path)
    return path


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def src4_json_lines(spark, d):
    """Blank lines between the rows are passed over."""
    return readers.json_lines(spark, orders_lines(spark, d, "src4"), "o_orderkey long, o_orderstatus string")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def src5_strict_json_lines(spark, d):
    path = sinks.shared_path(spark, "src5")
    table(spark, d, "orders").select(F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("value")).write.text(path)
    return readers.json_lines(spark, path, "o_orderkey long, o_orderstatus string", allow_blank=False)


@query("SELECT 'update' || n_nationkey AS label, n_nationkey % 2 = 0 AS won FROM nation")
def src6_labelled_files(spark, d):
    path = sinks.shared_path(spark, "src6")
    for r in nations(spark, d):
        put(spark, f"{path}/update{r.n_nationkey}/greedy.json", json.dumps({"won": r.n_nationkey % 2 == 0}))
        put(spark, f"{path}/update{r.n_nationkey}/sampled.json", json.dumps({"won": None}))
    return readers.labelled_files(spark, path, "won boolean", "greedy.json")


@query("SELECT n_nationkey AS rank FROM nation WHERE n_nationkey < 20")
def src7_numbered_shards(spark, d):
    path = sinks.shared_path(spark, "src7")
    for r in nations(spark, d):
        put(spark, f"{path}/{'rank' if r.n_nationkey < 20 else 'other'}-{r.n_nationkey}-call-0.json", json.dumps({"rank": r.n_nationkey}))
    return readers.json_files(spark, path, "rank int", "rank-*-call-*.json").select("rank")


@query("SELECT n_nationkey::VARCHAR AS id, n_nationkey % 2 = 0 AS won, n_nationkey / 4 AS reward FROM nation")
def src8_partial_scan(spark, d):
    found = readers.partial_scan(spark, nation_files(spark, d, "src8"), {"id": '"id"\\s*:\\s*"([^"]+)"', "won": '"won"\\s*:\\s*(true|false)', "reward": '"total_shaped_reward"\\s*:\\s*([-+0-9.eE]+)'})
    return found.select("id", F.col("won").cast("boolean").alias("won"), F.col("reward").cast("double").alias("reward"))


@query("SELECT 'line ' || doc_id AS line FROM documents")
def src9_log_lines(spark, d):
    path = sinks.shared_path(spark, "src9")
    table(spark, d, "documents").select(F.concat(L("\x1b[32mline\x1b[0m "), "doc_id").alias("value")).write.text(path)
    return readers.log_lines(spark, path).select("line")


@query("SELECT true AS equal, false AS equal_without_one")
def src10_directory_equals_lines(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    path = sinks.shared_path(spark, "src10")
    o.write.parquet(path)
    kept, lines = spark.read.parquet(path), readers.json_lines(spark, orders_lines(spark, d, "src10"), "o_orderkey long, o_orderstatus string")
    return spark.createDataFrame([(sinks.same_rows(kept, lines), sinks.same_rows(kept.where("o_orderkey > 3"), lines))], "equal boolean, equal_without_one boolean")


@query("SELECT n_nationkey || '.txt' AS file, r::INT AS r, c::INT AS c, ((n_nationkey * 3 + r * 5 + c * 7) % 11)::INT AS tile FROM nation, range(0, 4) r(r), range(0, 6) c(c)")
def src12_level_tiles(spark, d):
    path = sinks.shared_path(spark, "src12")
    for n in nations(spark, d):
        rows = "\n".join(" ".join(str((n.n_nationkey * 3 + r * 5 + c * 7) % 11) for c in range(6)) for r in range(4))
        put(spark, f"{path}/{n.n_nationkey}.txt", f"# lvlwidth 6\n# lvlheight 4\n# bgcolor 0 0 0\n\n# startleveldata\n{rows}\n# endleveldata\n")
    return readers.level_tiles(readers.level_files(spark, path)).withColumnRenamed("_file", "file")


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN '#P.#/# ' || repeat('.', (doc_id % 4)::INT) || '#' END AS grid FROM documents")
def src13_grid_blocks(spark, d):
    i = F.col("doc_id")
    rows = F.concat(L("#P.#\n# "), F.repeat(L("."), (i % 4).cast("int")), L("#"))
    text = F.when(i % 3 == 0, F.concat(L("Turn 3\nGrid:\n"), rows, L("\n\n#after"))).when(i % 3 == 1, F.concat(L("Grid:\n"), rows, L("\nLegal actions: U"))).otherwise(F.concat(L("no grid\n"), rows))
    return table(spark, d, "documents").select("doc_id", F.array_join(readers.grid_block(text), "/").alias("grid"))


@query("SELECT n_nationkey || '.safetensors' AS file, unnest(['a', 'b']) AS tensor, unnest([0, 8]) AS begin, unnest([8, 8 + n_regionkey * 4]) AS end, n_nationkey % 5 > 0 AS contiguous FROM nation")
def src14_tensor_headers(spark, d):
    path = sinks.shared_path(spark, "src14")
    for n in nations(spark, d):
        size = 8 + n.n_regionkey * 4
        head = json.dumps({"__metadata__": {"x": "y"}, "b": {"dtype": "F32", "shape": [n.n_regionkey], "data_offsets": [8, size]}, "a": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}}).encode()
        body = len(head).to_bytes(8, "little") + head + b"\0" * (size + (n.n_nationkey % 5 == 0))
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n.n_nationkey}.safetensors")
        out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
        out.write(bytearray(body))
        out.close()
    found = readers.tensor_headers(spark, path)
    return found.select(F.col("_file").alias("file"), "tensor", F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"), "contiguous")


@query("""WITH parts AS (SELECT p_partkey % 5 AS file, p_partkey, p_size, (p_partkey % 5 = 2) AS ends FROM part)
  SELECT file, p_partkey AS source_step, p_size AS size, ends AS done FROM parts WHERE NOT ends OR p_partkey <= (SELECT max(p_partkey) // 2 FROM part)""")
def src15_st11_complete_lines(spark, d):
    """Five journals followed while they grow: each trigger takes the lines completed since the one before, a half line waits, and an end line closes its file."""
    p = table(spark, d, "part").select("p_partkey", "p_size")
    last = p.agg(F.max("p_partkey")).first()[0]
    path, keep = sinks.shared_path(spark, "src15"), sinks.shared_path(spark, "src15-kept")
    # the end of the growth so far falls into a line, and half of a line is all that a later one adds to some files
    line = F.concat(L('{"source_step": '), "p_partkey", L(', "size": '), "p_size", L("}"))
    for upto, broken in ((last // 3, True), (last // 2, False), (last // 2, True), (last, False)):
        own = p.where(F.col("p_partkey") <= upto).select((F.col("p_partkey") % 5).alias("file"), "p_partkey", line.alias("line"))
        if upto == last:  # an end line in the middle of a file
            own = own.unionByName(spark.range(1).select(L(2).cast("long").alias("file"), L(last // 2).cast("long").alias("p_partkey"), L("END").alias("line")))
        named = own.select(F.concat(F.col("file").cast("string"), L(".jsonl")).alias("name"), "p_partkey", "line")
        growing.rewrite(named, path, [F.col("p_partkey"), F.col("line") == "END"], '{"source_step": ' if broken else "")
        rows = growing.complete_lines(spark, path)
        rows.writeStream.format("parquet").option("path", keep).option("checkpointLocation", f"{keep}-state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("file string, offset long, line string, closed boolean").parquet(keep)
    value = F.from_json("line", "source_step int, size int")
    over = found.where("closed").select("file", L(True).alias("_over"))  # a row a file
    rows = found.where("NOT closed").join(F.broadcast(over), "file", "left")
    return rows.select(F.regexp_extract("file", "^(\\d+)", 1).cast("int").alias("file"), value.alias("v"), F.coalesce("_over", L(False)).alias("done")).select("file", "v.source_step", "v.size", "done")


@query("SELECT p_partkey, unnest([p_size, 100, 101, 102]) AS seed FROM part")
def src17_seed_ranges(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), L(", 100-102")).alias("expression"))
    return readers.seeds(p, "expression").select("p_partkey", F.col("seed").cast("int").alias("seed"))


@query("SELECT n_nationkey, 'n_' || n_nationkey || '--' || n_regionkey AS name FROM nation WHERE n_nationkey <> 3")
def snk1_fn8_episode_files(spark, d):
    """A folder an episode, none if a rule is broken."""
    path = sinks.shared_path(spark, "snk1")
    n = table(spark, d, "nation").select("n_nationkey", F.concat(L("n/"), "n_nationkey").alias("id"), "n_regionkey")
    rules = [audit.Rule("key", F.col("n_nationkey") == 3)]
    refused = False
    try:
        sinks.write_episodes(n, f"{path}-refused", rules, "id", "n_regionkey")
    except ValueError:
        refused = True
    sinks.write_episodes(n.where("n_nationkey <> 3"), path, rules, "id", "n_regionkey")
    kept = spark.read.schema("n_nationkey int, id string, n_regionkey int, _name string").json(path)
    return kept.where(L(refused)).select("n_nationkey", F.col("_name").alias("name"))


@query("""SELECT o_orderkey AS id, '{"id":' || o_orderkey || ',"split":"' || o_orderstatus || '"}' AS line, (SELECT count(*) FROM orders) AS rows, true AS same_digest FROM orders""")
def snk2_canonical_lines(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("split"), F.col("o_orderkey").alias("id"))
    path = sinks.shared_path(spark, "snk2")
    first, again = sinks.write_canonical(o, path, "id"), sinks.write_canonical(o.repartition(3), f"{path}-again", "id")
    facts = first.withColumnRenamed("digest", "_d").crossJoin(again.select(F.col("digest").alias("_e")))  # one row each
    lines = spark.read.text(path).select(F.get_json_object("value", "$.id").cast("long").alias("id"), F.col("value").alias("line"))
    return lines.crossJoin(F.broadcast(facts)).select("id", "line", "rows", (F.col("_d") == F.col("_e")).alias("same_digest"))


@query("SELECT true AS refused, count(*) AS rows FROM orders")
def snk3_no_replacement(spark, d):
    from pyspark.errors import AnalysisException

    o, path = table(spark, d, "orders"), sinks.shared_path(spark, "snk3")
    sinks.write_once(o, path)
    try:
        o.limit(1).write.mode("errorifexists").parquet(path)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).agg(L(refused).alias("refused"), F.count(L(1)).alias("rows"))


@query("SELECT true AS wrote, false AS wrote_again, true AS other_refused")
def snk5_write_once(spark, d):
    o, path = table(spark, d, "orders"), sinks.shared_path(spark, "snk5")
    wrote, again = sinks.write_once(o, path), sinks.write_once(o, path)
    try:
        sinks.write_once(o.where("o_orderkey > 5"), path)
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(wrote, again, refused)], "wrote boolean, wrote_again boolean, other_refused boolean")


@query(f"WITH {EPISODES} SELECT episode_id, unnest([1, 2]) AS attempt, fault FROM episodes")
def snk7_appended_attempts(spark, d):
    path = sinks.shared_path(spark, "snk7")
    e = episodes(spark, d).select("episode_id", "fault")
    for n in (1, 2):
        sinks.append_attempts(e.withColumn("attempt", L(n)), path)
    return spark.read.schema("episode_id long, attempt int, fault boolean").json(path)


@query(f"""WITH {STEPS} SELECT episode_id, '# Episode ' || episode_id || chr(10) || chr(10) || '| step | action | delta |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || step || ' | ' || action || ' | ' || delta || ' |', chr(10) ORDER BY step) AS text FROM steps GROUP BY 1""")
def snk8_markdown_reports(spark, d):
    return sinks.reports(steps(spark, d), "episode_id", "step", ["step", "action", "delta"], "Episode")


@query("SELECT n_nationkey, 2::BIGINT AS update, true AS refused, true AS damage_seen FROM nation WHERE n_nationkey % 2 = 0")
def snk9_joint_checkpoint(spark, d):
    n, path = table(spark, d, "nation").select("n_nationkey"), sinks.shared_path(spark, "snk9")
    sinks.publish(n, path, 1, {"tier": "0"})
    sinks.publish(n.where("n_nationkey % 2 = 0"), path, 2, {"tier": "1"})
    try:
        sinks.publish(n, path, 1, {})
        refused = False
    except ValueError:
        refused = True
    df, _ = sinks.restore(spark, path, n.schema)
    n.limit(3).write.mode("append").parquet(f"{path}/data/0000001")
    try:
        sinks.restore(spark, path, n.schema, 1)
        seen = False
    except ValueError:
        seen = True
    return df.select("n_nationkey", L(2).cast("long").alias("update"), L(refused).alias("refused"), L(seen).alias("damage_seen"))
