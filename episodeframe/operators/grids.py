"""Grid boards as tables of edges: distances, shortest routes, gates and canonical forms."""

from __future__ import annotations

import itertools
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Moves in their tie order (fixed values).
MOVES = (("U", -1, 0), ("D", 1, 0), ("L", 0, -1), ("R", 0, 1))
#: Frontiers that are looked through one by one before they are put together again.
LAYERS = 16


def edges_of(cells: DataFrame, width: int, portal_row: int | None = None) -> DataFrame:
    """(map_id, src, action, rank, dst) between open cells (map_id, r, c) of boards of one width; a cell is r * width + c, rank is the move's tie order.

    In the portal row the left and right ends are joined.
    """
    moves = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(i).alias("rank"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for i, (a, dr, dc) in enumerate(MOVES)))
    to = cells.select("map_id", "r", "c", F.explode(moves).alias("m")).select("map_id", (F.col("r") * width + F.col("c")).alias("src"), "m.action", "m.rank", (F.col("r") + F.col("m.dr")).alias("r"), (F.col("c") + F.col("m.dc")).alias("c"))
    if portal_row is not None:
        to = to.withColumn("c", F.when(F.col("r") == portal_row, F.expr(f"pmod(c, {width})")).otherwise(F.col("c")))
    return to.join(cells.select("map_id", "r", "c"), ["map_id", "r", "c"]).select("map_id", "src", "action", "rank", (F.col("r") * width + F.col("c")).cast("long").alias("dst"))


def _checkpoints(spark) -> None:
    if spark.sparkContext.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="episodeframe-"))


def frontier_distances(edges: DataFrame, sources: DataFrame, limit: int | None = None, by: tuple[str, ...] = ("map_id",)) -> DataFrame:
    """(by..., node, distance) from the sources over edges (map_id, src, dst), one frontier join a step.

    For graphs of any size: each step joins the frontier alone, until it is empty; only a caller's `limit`
    stops the search after so many steps. With more columns in `by` each of their values searches by
    itself. A step is checkpointed in the shared folder (only a local session may do without one named), so plans stay short
    and a lost executor costs one step; every LAYERS steps the layers found so far are put together.
    """
    _checkpoints(edges.sparkSession)
    key = [*by, "node"]
    own = edges.select("map_id", "src", "dst").distinct()
    frontier = sources.select(*key).distinct().withColumn("distance", F.lit(0).cast("long")).checkpoint()
    seen, layers = frontier, 1
    for d in itertools.count(1) if limit is None else range(1, limit + 1):
        reached = frontier.withColumnRenamed("node", "src").join(own, ["map_id", "src"]).select(*by, F.col("dst").alias("node")).distinct()
        frontier = reached.join(seen.select(*key), key, "left_anti").withColumn("distance", F.lit(d).cast("long")).checkpoint()
        if frontier.isEmpty():
            break
        seen, layers = seen.unionByName(frontier), layers + 1
        if layers == LAYERS:
            seen, layers = seen.repartition(*key).checkpoint(), 1
    return seen


def all_distances(edges: DataFrame) -> DataFrame:
    """(map_id, src, node, distance) between all pairs of cells that are joined."""
    cells = edges.select("map_id", "src").unionByName(edges.select("map_id", F.col("dst").alias("src"))).distinct()
    return frontier_distances(edges, cells.withColumn("origin", F.col("src")).withColumnRenamed("src", "node"), by=("map_id", "origin")).withColumnRenamed("origin", "src")


def first_moves(edges: DataFrame, distances: DataFrame) -> DataFrame:
    """(map_id, src, node, distance, actions, first): all first moves of shortest routes, in tie order, and the first of them."""
    step = edges.select("map_id", "src", "action", "rank", F.col("dst").alias("_via"))
    rest = distances.select("map_id", F.col("src").alias("_via"), "node", F.col("distance").alias("_left"))
    both = distances.where("distance > 0").join(step, ["map_id", "src"]).join(rest, ["map_id", "_via", "node"]).where(F.col("_left") == F.col("distance") - 1)
    moves = both.groupBy("map_id", "src", "node", "distance").agg(F.array_sort(F.collect_set(F.struct("rank", "action"))).alias("_m"))
    return moves.select("map_id", "src", "node", "distance", F.array_join(F.transform("_m", lambda m: m["action"]), "").alias("actions"), F.get("_m", F.lit(0))["action"].alias("first"))


def nearest_targets(distances: DataFrame, targets: DataFrame) -> DataFrame:
    """(map_id, src, target, distance) of the target (map_id, node) nearest to each cell; the least cell on a tie."""
    hit = distances.join(targets.select("map_id", "node"), ["map_id", "node"])
    return hit.groupBy("map_id", "src").agg(F.min(F.struct("distance", "node")).alias("m")).select("map_id", "src", F.col("m.node").alias("target"), "m.distance")


def route_margins(routes: DataFrame, threats: DataFrame, distances: DataFrame) -> DataFrame:
    """(route_id, margin): over the cells of a route (route_id, map_id, step from 1, node) the least of the nearest threat's arrival less one's own; null without a threat that arrives."""
    arrival = distances.join(threats.select("map_id", F.col("node").alias("src")), ["map_id", "src"]).groupBy("map_id", "node").agg(F.min("distance").alias("_eta"))
    return routes.join(arrival, ["map_id", "node"], "left").groupBy("route_id").agg(F.min(F.col("_eta") - F.col("step")).alias("margin"))


def connectivity(cells: DataFrame, reached: DataFrame, wanted: Column) -> DataFrame:
    """(map_id, wanted, reached, passed): whether all wanted cells (map_id, node, ...) were reached, and there is one at least."""
    marked = cells.where(wanted).join(reached.select("map_id", "node").withColumn("_in", F.lit(True)), ["map_id", "node"], "left")
    n, got = F.count(F.lit(1)), F.count_if("_in")
    return marked.groupBy("map_id").agg(n.alias("wanted"), got.alias("reached"), (n == got).alias("passed"))


def route_summaries(moves: DataFrame, edges: DataFrame, cap: int = 4) -> DataFrame:
    """Of routes (route_id, map_id, step from 0, src, action, dst): length, junctions (three ways or more), turns, portals (jumps over more than one cell), the moves up to the first
    junction, portal or the cap, and an id from the content."""
    degree = edges.select("map_id", "src", "dst").distinct().groupBy("map_id", F.col("src").alias("_at")).agg(F.count(F.lit(1)).alias("_ways"))
    w = Window.partitionBy("route_id").orderBy("step")
    here = degree.withColumnsRenamed({"_at": "src", "_ways": "_from"})
    there = degree.withColumnsRenamed({"_at": "dst", "_ways": "_to"})
    rows = moves.join(here, ["map_id", "src"], "left").join(there, ["map_id", "dst"], "left").withColumns({"_turn": F.col("action") != F.lag("action").over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy("route_id"))})
    stop = F.when(F.col("portal"), "portal_exit").when(F.col("_to") >= 3, "junction")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "src", "action"))), lambda s: F.concat(s["src"].cast("string"), s["action"])), ",")
    found = rows.groupBy("route_id").agg(
        F.count(F.lit(1)).alias("moves"), F.count_if(F.col("_from") >= 3).alias("junctions"), F.count_if("_turn").alias("turns"), F.count_if("portal").alias("portals"),
        F.min(F.when((F.col("step") < cap) & stop.isNotNull(), F.struct("step", stop.alias("why")))).alias("_stop"), F.concat(F.lit("r"), F.substring(F.sha2(text, 256), 1, 16)).alias("content_id"),
    )
    return found.select(
        "route_id", "moves", "junctions", "turns", "portals", F.coalesce(F.col("_stop.step") + 1, F.least("moves", F.lit(cap))).cast("long").alias("segment"),
        F.coalesce(F.col("_stop.why"), F.when(F.col("moves") > cap, "segment_cap").otherwise("route_end")).alias("boundary"), "content_id",
    )


def canonical_layouts(boards: DataFrame) -> DataFrame:
    """(map_id, canonical): the least of the eight turned and mirrored forms of a board's rows (array of strings)."""

    @F.pandas_udf("string")
    def least(rows: pd.Series) -> pd.Series:
        def forms(lines: list[str]) -> list[str]:
            out = []
            for _ in range(4):
                lines = ["".join(col) for col in zip(*lines[::-1], strict=True)]
                out += ["/".join(lines), "/".join(x[::-1] for x in lines)]
            return out

        return rows.map(lambda x: min(forms(list(x))))

    return boards.select("map_id", least("rows").alias("canonical"))


def components_without(edges: DataFrame, cells: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """(map_id, removed, node, component) of boards (cells map_id, node) after taking out one cell, for each of `removed` (map_id, removed; all cells, by default).

    component is its least cell. Each step passes the least label on to the neighbours and takes a label's own label, so
    long ways need about as many steps as their length has digits; boards and removals search side by side.
    """
    _checkpoints(edges.sparkSession)
    own = edges.select("map_id", F.col("src").alias("node"), "dst").where("node <> dst").distinct()
    gone = cells.select("map_id", F.col("node").alias("removed")).distinct() if removed is None else removed
    now = gone.join(cells.select("map_id", "node").distinct(), "map_id").where("removed <> node").withColumn("component", F.col("node")).checkpoint()
    while True:
        passed = now.join(own, ["map_id", "node"]).where("dst <> removed").select("map_id", "removed", F.col("dst").alias("node"), "component")
        least = now.unionByName(passed).groupBy("map_id", "removed", "node").agg(F.min("component").alias("_least"))
        higher = now.select("map_id", "removed", F.col("node").alias("_least"), F.col("component").alias("_up"))
        after = least.join(higher, ["map_id", "removed", "_least"]).select("map_id", "removed", "node", F.least("_least", "_up").alias("component")).checkpoint()
        if after.exceptAll(now).isEmpty():
            return after
        now = after


def choke_points(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """(map_id, node, parts, parts_without, choke) of every cell: how many components its board has with and without it; a choke point leaves more."""
    every = cells.select("map_id", "node").distinct()
    none = every.select("map_id", F.lit(-1).cast("long").alias("removed")).distinct()
    count = lambda rows: rows.groupBy("map_id", "removed").agg(F.count_distinct("component").alias("_n"))
    found = count(components_without(edges, every, none.unionByName(every.select("map_id", F.col("node").alias("removed")))))
    whole = found.where("removed = -1").select("map_id", F.col("_n").alias("parts"))
    without = found.select("map_id", F.col("removed").alias("node"), F.col("_n").alias("parts_without"))
    rows = every.join(whole, "map_id").join(without, ["map_id", "node"], "left").fillna(0, ["parts_without"])
    return rows.withColumn("choke", F.col("parts_without") > F.col("parts"))


def least_routes(edges: DataFrame, sources: DataFrame, by: tuple[str, ...], avoid: str | None = None, limit: int | None = None) -> DataFrame:
    """(by..., node, route, path): of the shortest routes from sources (by..., node, route, path) the first in tie order; route is the ranks of its moves, path its cells.

    A cell's route is the least of its neighbours' routes and a move: one frontier join a step, as frontier_distances(). Cells equal to the column
    `avoid` are never entered, and with `limit` the search stops after so many steps.
    """
    _checkpoints(edges.sparkSession)
    key, own = [*by, "node"], edges.select("map_id", F.col("src").alias("node"), "rank", "dst")
    frontier = sources.select(*key, "route", "path").checkpoint()
    seen = frontier
    for _ in itertools.count() if limit is None else range(limit):
        to = frontier.join(own, ["map_id", "node"]).where(F.col("dst") != F.col(avoid) if avoid else F.lit(True))
        step = F.struct(F.concat("route", F.col("rank").cast("string")).alias("route"), F.concat("path", F.array("dst")).alias("path"))
        reached = to.groupBy(*by, F.col("dst").alias("node")).agg(F.min_by(step, step["route"]).alias("_r")).select(*key, "_r.*")
        frontier = reached.join(seen.select(*key), key, "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def alternative_routes(edges: DataFrame, pairs: DataFrame, slack: int = 8, top: int = 12, reach: int = 4) -> DataFrame:
    """(map_id, start, target, route, place): up to `top` routes for pairs (map_id, start, target) of different cells, shortest first, then by their letters.

    For every first move the shortest continuation that doesn't come back to the start; and ways by a junction (three moves or more) within
    `reach` moves, from there the shortest, if no cell comes twice. Routes longer than the direct one by more than `slack` are left out.
    """
    starts = pairs.select("map_id", "start").distinct()
    at = starts.select("map_id", "start", F.col("start").alias("node"), F.lit("").alias("route"), F.array("start").alias("path"))
    first = at.drop("route").join(edges.select("map_id", F.col("src").alias("node"), "rank", "dst"), ["map_id", "node"])
    first = first.where("dst <> start").select("map_id", "start", F.col("rank").alias("first"), F.col("dst").alias("node"), F.col("rank").cast("string").alias("route"), F.concat("path", F.array("dst")).alias("path"))
    ways = least_routes(edges, first, ("map_id", "start", "first"), avoid="start")
    wanted = pairs.where("start <> target").select("map_id", "start", "target").distinct()
    by_move = ways.withColumnRenamed("node", "target").join(wanted, ["map_id", "start", "target"]).select("map_id", "start", "target", "route")
    direct = by_move.groupBy("map_id", "start", "target").agg(F.min(F.length("route")).alias("_direct"))
    # ways by a junction: what is longer than allowed goes before the cells of two parts are put together
    junctions = edges.groupBy("map_id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_ways")).where("_ways >= 3").select("map_id", "node")
    near = least_routes(edges, at, ("map_id", "start"), limit=reach).where("route <> ''").join(junctions, ["map_id", "node"])
    places = near.select("map_id", F.col("node").alias("via")).distinct()
    rest = least_routes(edges, places.select("map_id", "via", F.col("via").alias("node"), F.lit("").alias("route"), F.array("via").alias("path")), ("map_id", "via"))
    rest = rest.where("route <> ''").select("map_id", F.col("via").alias("node"), F.col("node").alias("target"), F.col("route").alias("_rest"), F.col("path").alias("_cells"))
    over = near.join(rest, ["map_id", "node"]).join(direct, ["map_id", "start", "target"]).where(F.length("route") + F.length("_rest") <= F.col("_direct") + slack)
    cells = F.concat("path", F.slice("_cells", 2, F.size("_cells")))
    by_junction = over.where(F.size(F.array_distinct(cells)) == F.size(cells)).select("map_id", "start", "target", F.concat("route", "_rest").alias("route"))
    every = by_move.unionByName(by_junction).distinct().join(direct, ["map_id", "start", "target"]).where(F.length("route") <= F.col("_direct") + slack)
    named = every.withColumn("route", F.translate("route", "0123", "".join(m[0] for m in MOVES)))
    place = F.row_number().over(Window.partitionBy("map_id", "start", "target").orderBy(F.length("route"), "route"))
    return named.withColumn("place", place).where(F.col("place") <= top).drop("_direct")
