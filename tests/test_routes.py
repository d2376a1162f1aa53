"""Components, choke points and alternative routes of boards drawn by hand."""

from episodeframe.operators import grids


def board(spark, *rows):
    cells = spark.createDataFrame([("m", r, c) for r, line in enumerate(rows) for c, x in enumerate(line) if x != "#"], "map_id string, r long, c long")
    edges = grids.edges_of(cells, len(rows[0]))
    return edges, cells.selectExpr("map_id", f"r * {len(rows[0])} + c AS node")


def test_choke_points(spark):
    edges, cells = board(spark, "...", "#.#", "..#", "##.")
    got = {r.node: (r.parts, r.parts_without, r.choke) for r in grids.choke_points(edges, cells).collect()}
    # a T of five cells, two below it, and a cell apart
    assert got[1] == (2, 4, True) and got[4] == (2, 3, True) and got[7] == (2, 3, True)
    assert got[0] == (2, 2, False) and got[11] == (2, 1, False) and got[6] == (2, 2, False)
    found = {(r.node, r.component) for r in grids.components_without(edges, cells, spark.createDataFrame([("m", 4)], "map_id string, removed long")).collect()}
    assert found == {(0, 0), (1, 0), (2, 0), (6, 6), (7, 6), (11, 11)}


def test_a_long_corridor_is_one_component(spark):
    edges, cells = board(spark, "." * 90)
    found = grids.components_without(edges, cells, spark.createDataFrame([("m", 45)], "map_id string, removed long"))
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0 if i < 45 else 46) for i in range(90) if i != 45}


def test_alternative_routes(spark):
    """A ring round a wall: both ways round, the shorter first; no way back over the start."""
    edges, _ = board(spark, "....", ".##.", "....")
    pairs = spark.createDataFrame([("m", 0, 3), ("m", 0, 0), ("m", 0, 8)], "map_id string, start long, target long")
    got = sorted((r.target, r.place, r.route) for r in grids.alternative_routes(edges, pairs).collect())
    assert got == [(3, 1, "RRR"), (3, 2, "DDRRRUU"), (8, 1, "DD"), (8, 2, "RRRDDLLL")]
    assert [r.route for r in grids.alternative_routes(edges, pairs.where("target = 3"), slack=3).collect()] == ["RRR"]


def test_routes_by_junctions(spark):
    edges, _ = board(spark, "#.#..", ".....", "#.#.#")
    pairs = spark.createDataFrame([("m", 5, 4)], "map_id string, start long, target long")
    # R leads everywhere; at the junction 8 the way goes up first or right first, and both are as long
    got = [r.route for r in grids.alternative_routes(edges, pairs).orderBy("place").collect()]
    assert got == ["RRRUR"]
