"""Queries of grid boards: a brand is a board of 5 x 7 cells, open where it has a part that is not of a third of the sizes; row 2 is a tunnel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grids
from ..sources.bindings import table
from .core import query

CELLS = """cells AS (SELECT DISTINCT p_brand AS map_id, p_partkey % 35 // 7 AS r, p_partkey % 35 % 7 AS c FROM part WHERE p_size % 3 <> 0),
  moves AS (SELECT unnest(['U', 'D', 'L', 'R']) AS action, unnest([0, 1, 2, 3]) AS rank, unnest([-1, 1, 0, 0]) AS dr, unnest([0, 0, -1, 1]) AS dc),
  edges AS (SELECT a.map_id, a.r * 7 + a.c AS src, action, rank, b.r * 7 + b.c AS dst FROM cells a, moves m, cells b WHERE a.map_id = b.map_id AND b.r = a.r + dr AND b.c = CASE WHEN a.r + dr = 2 THEN (a.c + dc + 7) % 7 ELSE a.c + dc END)"""
PAIRS = f"""RECURSIVE {CELLS}, w AS (SELECT map_id, r * 7 + c AS src, r * 7 + c AS node, 0::BIGINT AS distance FROM cells UNION SELECT w.map_id, w.src, e.dst, distance + 1 FROM w JOIN edges e ON w.map_id = e.map_id AND w.node = e.src WHERE distance < 34),
  pairs AS (SELECT map_id, src, node, min(distance) AS distance FROM w GROUP BY 1, 2, 3)"""


def cells(spark, d) -> DataFrame:
    at = F.col("p_partkey") % 35
    return table(spark, d, "part").where("p_size % 3 <> 0").select(F.col("p_brand").alias("map_id"), F.floor(at / 7).alias("r"), (at % 7).alias("c")).distinct()


def edges(spark, d) -> DataFrame:
    return grids.edges_of(cells(spark, d), 7, portal_row=2)


def pairs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Edges, and the distances of all pairs of open cells (a cell without a way out reaches itself)."""
    e = edges(spark, d)
    alone = cells(spark, d).select("map_id", (F.col("r") * 7 + F.col("c")).alias("src"))
    found = grids.all_distances(e)
    own = alone.select("map_id", "src", F.col("src").alias("node"), F.lit(0).cast("long").alias("distance"))
    return e, found.unionByName(own.join(found.select("map_id", "src").distinct(), ["map_id", "src"], "left_anti"))


@query(f"""WITH RECURSIVE {CELLS}, s AS (SELECT map_id, min(r * 7 + c) AS node FROM cells GROUP BY 1), w AS (SELECT map_id, node, 0::BIGINT AS distance FROM s UNION SELECT w.map_id, e.dst, distance + 1 FROM w JOIN edges e ON w.map_id = e.map_id AND w.node = e.src WHERE distance < 34)
  SELECT map_id, node, min(distance) AS distance FROM w GROUP BY 1, 2""")
def gr1_frontier_distances(spark, d):
    sources = cells(spark, d).groupBy("map_id").agg(F.min(F.col("r") * 7 + F.col("c")).alias("node"))
    return grids.frontier_distances(edges(spark, d), sources)


@query(f"WITH {PAIRS}, t AS (SELECT *, row_number() OVER (PARTITION BY map_id, src ORDER BY distance, node) AS k FROM pairs WHERE node % 5 = 0) SELECT map_id, src, node AS target, distance FROM t WHERE k = 1")
def gr1_nearest_targets(spark, d):
    _, found = pairs(spark, d)
    targets = cells(spark, d).select("map_id", (F.col("r") * 7 + F.col("c")).alias("node")).where("node % 5 = 0")
    return grids.nearest_targets(found, targets)


@query(f"""WITH {PAIRS} SELECT p.map_id, p.src, p.node, p.distance, string_agg(DISTINCT e.action, '' ORDER BY CASE e.action WHEN 'U' THEN 0 WHEN 'D' THEN 1 WHEN 'L' THEN 2 ELSE 3 END) AS actions, arg_min(e.action, e.rank) AS first
  FROM pairs p JOIN edges e ON p.map_id = e.map_id AND p.src = e.src JOIN pairs q ON q.map_id = p.map_id AND q.src = e.dst AND q.node = p.node WHERE p.distance > 0 AND q.distance = p.distance - 1 GROUP BY 1, 2, 3, 4""")
def gr2_gr8_first_moves(spark, d):
    e, found = pairs(spark, d)
    return grids.first_moves(e, found)


@query(f"""WITH {PAIRS}, r AS (SELECT map_id, src AS node, row_number() OVER (PARTITION BY map_id ORDER BY src) AS step FROM (SELECT DISTINCT map_id, src FROM pairs WHERE src // 7 = 2)), a AS (SELECT map_id, node, min(distance) AS eta FROM pairs WHERE src % 9 = 4 GROUP BY 1, 2)
  SELECT r.map_id AS route_id, min(eta - step) AS margin FROM r LEFT JOIN a USING (map_id, node) GROUP BY 1""")
def gr5_route_margins(spark, d):
    from pyspark.sql import Window

    _, found = pairs(spark, d)
    own = cells(spark, d).select("map_id", (F.col("r") * 7 + F.col("c")).alias("node"))
    step = F.row_number().over(Window.partitionBy("map_id").orderBy("node")).cast("long")
    routes = own.where("floor(node / 7) = 2").select(F.col("map_id").alias("route_id"), "map_id", "node", step.alias("step"))
    return grids.route_margins(routes, own.where("node % 9 = 4"), found)


@query(f"""WITH {PAIRS}, s AS (SELECT map_id, min(src) AS src FROM pairs GROUP BY 1), g AS (SELECT map_id, node FROM pairs JOIN s USING (map_id, src)), k AS (SELECT map_id, r * 7 + c AS node FROM cells WHERE c % 2 = 0)
  SELECT map_id, count(*) AS wanted, count(g.node) AS reached, count(*) = count(g.node) AS passed FROM k LEFT JOIN g USING (map_id, node) GROUP BY 1""")
def gr6_connectivity_gates(spark, d):
    own = cells(spark, d).select("map_id", (F.col("r") * 7 + F.col("c")).alias("node"), "c")
    reached = grids.frontier_distances(edges(spark, d), own.groupBy("map_id").agg(F.min("node").alias("node")))
    return grids.connectivity(own, reached, F.col("c") % 2 == 0)


@query(f"""WITH {CELLS}, deg AS (SELECT map_id, src, count(DISTINCT dst) AS ways FROM edges GROUP BY 1, 2), m AS (SELECT map_id, src, arg_min(action, rank) AS action, arg_min(dst, rank) AS dst FROM edges WHERE action IN ('D', 'R') GROUP BY 1, 2),
  n AS (SELECT map_id || '-' || src // 7 AS route_id, map_id, src, action, dst, row_number() OVER (PARTITION BY map_id, src // 7 ORDER BY src) - 1 AS step FROM m),
  x AS (SELECT n.*, coalesce(a.ways, 0) AS f, coalesce(b.ways, 0) AS t, action <> lag(action) OVER (PARTITION BY route_id ORDER BY step) AS turn, abs(n.dst // 7 - n.src // 7) + abs(n.dst % 7 - n.src % 7) > 1 AS portal FROM n LEFT JOIN deg a ON a.map_id = n.map_id AND a.src = n.src LEFT JOIN deg b ON b.map_id = n.map_id AND b.src = n.dst),
  g AS (SELECT route_id, count(*) AS moves, count(*) FILTER (f >= 3) AS junctions, count(*) FILTER (turn) AS turns, count(*) FILTER (portal) AS portals, min(step) FILTER (step < 4 AND (portal OR t >= 3)) AS stop, arg_min(portal, step) FILTER (step < 4 AND (portal OR t >= 3)) AS by_portal, 'r' || substr(sha256(string_agg(src || action, ',' ORDER BY step)), 1, 16) AS content_id FROM x GROUP BY 1)
  SELECT route_id, moves, junctions, turns, portals, coalesce(stop + 1, least(moves, 4)) AS segment, CASE WHEN stop IS NOT NULL THEN CASE WHEN by_portal THEN 'portal_exit' ELSE 'junction' END WHEN moves > 4 THEN 'segment_cap' ELSE 'route_end' END AS boundary, content_id FROM g""")
def gr12_route_summaries(spark, d):
    from pyspark.sql import Window

    e = edges(spark, d)
    one = e.where("action IN ('D', 'R')").groupBy("map_id", "src").agg(F.min_by("action", "rank").alias("action"), F.min_by("dst", "rank").alias("dst"))
    row = F.floor(F.col("src") / 7)
    step = F.row_number().over(Window.partitionBy("map_id", row).orderBy("src")) - 1
    jump = F.abs(F.floor(F.col("dst") / 7) - row) + F.abs(F.col("dst") % 7 - F.col("src") % 7) > 1
    moves = one.select(F.concat_ws("-", "map_id", row.cast("string")).alias("route_id"), "map_id", "src", "action", "dst", step.alias("step"), jump.alias("portal"))
    return grids.route_summaries(moves, e)


@query(f"""WITH RECURSIVE {CELLS}, n AS (SELECT map_id, r * 7 + c AS node FROM cells), g AS (SELECT map_id, node AS removed FROM n UNION ALL SELECT DISTINCT map_id, -1 FROM n),
  w AS (SELECT g.map_id, removed, node AS src, node FROM g JOIN n USING (map_id) WHERE removed <> node UNION SELECT w.map_id, removed, w.src, e.dst FROM w JOIN edges e ON e.map_id = w.map_id AND e.src = w.node WHERE e.dst <> removed),
  l AS (SELECT map_id, removed, src, min(node) AS component FROM w GROUP BY 1, 2, 3), k AS (SELECT map_id, removed, count(DISTINCT component) AS parts FROM l GROUP BY 1, 2)
  SELECT n.map_id, n.node, a.parts, coalesce(b.parts, 0) AS parts_without, coalesce(b.parts, 0) > a.parts AS choke FROM n JOIN k a ON a.map_id = n.map_id AND a.removed = -1 LEFT JOIN k b ON b.map_id = n.map_id AND b.removed = n.node""")
def gr3_gr4_choke_points(spark, d):
    return grids.choke_points(edges(spark, d), cells(spark, d).select("map_id", (F.col("r") * 7 + F.col("c")).alias("node")))


@query(f"""WITH RECURSIVE {CELLS}, n AS (SELECT map_id, r * 7 + c AS node FROM cells), w AS (SELECT map_id, gone AS removed, node AS src, node FROM (SELECT map_id, min(node) AS gone FROM n GROUP BY 1) JOIN n USING (map_id) WHERE node <> gone
    UNION SELECT w.map_id, removed, w.src, e.dst FROM w JOIN edges e ON e.map_id = w.map_id AND e.src = w.node WHERE e.dst <> removed) SELECT map_id, removed, src AS node, min(node) AS component FROM w GROUP BY 1, 2, 3""")
def gr3_components_without(spark, d):
    own = cells(spark, d).select("map_id", (F.col("r") * 7 + F.col("c")).alias("node"))
    return grids.components_without(edges(spark, d), own, own.groupBy("map_id").agg(F.min("node").alias("removed")))


@query(f"""WITH {PAIRS}, o AS (SELECT map_id, min(r * 7 + c) AS start FROM cells GROUP BY 1),
  v AS (SELECT c.map_id, c.r * 7 + c.c AS src, c.r * 7 + c.c AS node, 0::BIGINT AS distance FROM cells c JOIN o USING (map_id) WHERE c.r * 7 + c.c <> start UNION SELECT v.map_id, v.src, e.dst, distance + 1 FROM v JOIN o USING (map_id) JOIN edges e ON e.map_id = v.map_id AND e.src = v.node WHERE e.dst <> start AND distance < 34),
  away AS (SELECT map_id, src, node AS target, min(distance) AS distance FROM v GROUP BY 1, 2, 3),
  -- by first move: from the next cell along the least moves that come nearer, without the start
  a AS (SELECT o.map_id, start, e.dst AS here, t.target, e.action AS route FROM o JOIN edges e ON e.map_id = o.map_id AND e.src = start JOIN away t ON t.map_id = o.map_id AND t.src = e.dst WHERE e.dst <> start
    UNION ALL SELECT a.map_id, a.start, m.dst, a.target, a.route || m.action FROM a, LATERAL (SELECT arg_min(e.dst, e.rank) AS dst, arg_min(e.action, e.rank) AS action FROM edges e JOIN away x ON x.map_id = e.map_id AND x.src = a.here AND x.target = a.target JOIN away y ON y.map_id = e.map_id AND y.src = e.dst AND y.target = a.target
      WHERE e.map_id = a.map_id AND e.src = a.here AND y.distance = x.distance - 1) m WHERE a.here <> a.target AND m.dst IS NOT NULL),
  -- least shortest routes from the start and from cells within four moves
  s AS (SELECT p.map_id, p.node AS origin FROM pairs p JOIN o ON o.map_id = p.map_id AND p.src = start WHERE distance <= 4),
  b AS (SELECT s.map_id, origin, origin AS here, p.node AS target, '' AS route, [origin] AS path FROM s JOIN pairs p ON p.map_id = s.map_id AND p.src = origin
    UNION ALL SELECT b.map_id, b.origin, m.dst, b.target, b.route || m.action, list_append(b.path, m.dst) FROM b, LATERAL (SELECT arg_min(e.dst, e.rank) AS dst, arg_min(e.action, e.rank) AS action FROM edges e JOIN pairs x ON x.map_id = e.map_id AND x.src = b.here AND x.node = b.target JOIN pairs y ON y.map_id = e.map_id AND y.src = e.dst AND y.node = b.target
      WHERE e.map_id = b.map_id AND e.src = b.here AND y.distance = x.distance - 1) m WHERE b.here <> b.target AND m.dst IS NOT NULL),
  done AS (SELECT * FROM b WHERE here = target), deg AS (SELECT map_id, src FROM edges GROUP BY 1, 2 HAVING count(*) >= 3),
  j AS (SELECT o.map_id, start, y.target, x.route || y.route AS route, list_concat(x.path, y.path[2:]) AS path FROM o JOIN done x ON x.map_id = o.map_id AND x.origin = start AND length(x.route) BETWEEN 1 AND 4 JOIN deg ON deg.map_id = o.map_id AND deg.src = x.target JOIN done y ON y.map_id = o.map_id AND y.origin = x.target AND y.route <> ''),
  every AS (SELECT map_id, start, target, route FROM a WHERE here = target UNION SELECT map_id, start, target, route FROM j WHERE len(list_distinct(path)) = len(path)),
  kept AS (SELECT e.*, row_number() OVER (PARTITION BY e.map_id, start, target ORDER BY length(route), route) AS place FROM every e JOIN pairs p ON p.map_id = e.map_id AND p.src = start AND p.node = target WHERE length(route) <= distance + 8)
  SELECT map_id, start, target, route, place::INT AS place FROM kept WHERE place <= 12""")
def gr11_alternative_routes(spark, d):
    """From each board's first cell to every other."""
    own = cells(spark, d).select("map_id", (F.col("r") * 7 + F.col("c")).alias("target"))
    return grids.alternative_routes(edges(spark, d), own.join(own.groupBy("map_id").agg(F.min("target").alias("start")), "map_id"))
