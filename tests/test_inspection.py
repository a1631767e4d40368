"""What an inspected point says: which library its part uses and out of which candidates."""

from roadframe.operators import routing as R

INDEX = "part string, pair_id long, patches long, size_px int, confidence double, weight double, rejections long, acceptances long, cooldown long, rank long"


def index(spark, *rows):
    return spark.createDataFrame([(p, i, n, 8, 0.6, 10.0 - k, 0, 0, c, k) for p, i, n, c, k in rows], INDEX)


def chosen(choices):
    return {r.part: (r.route, r.rank, r.candidates, r.rejected, r.exhausted) for r in choices.collect()}


def test_parts_prefer_the_pair_of_open_road_and_fall_back_to_priming(spark):
    x = index(spark, ("open", 1, 50, 1, 1), ("open", 2, 50, 0, 2), ("open", 3, 5, 0, 3), ("edge", 9, 50, 0, 1), ("edge", 2, 50, 0, 2))
    c = R.part_choices(x)
    assert chosen(c) == {"open": ("material.open@2", 2, 3, 1, False), "edge": ("material.edge@2", 2, 3, 0, False),
                         "junction": ("material.junction.primed", 1, 1, 0, False)}
    rows = {(r.part, r["rank"]): (r.route, r.rejected, r.chosen) for r in R.part_candidates(x, c).collect()}
    assert rows == {("open", 1): ("material.open@1", True, False), ("open", 2): ("material.open@2", False, True), ("open", 3): ("material.open.primed", False, False),
                    ("edge", 1): ("material.edge@9", False, False), ("edge", 2): ("material.edge@2", False, True), ("edge", 3): ("material.edge.primed", False, False),
                    ("junction", 1): ("material.junction.primed", False, True)}


def test_a_part_without_any_free_candidate_is_exhausted_and_takes_the_first(spark):
    x = index(spark, ("open", 1, 50, 1, 1), ("open", 2, 50, 2, 2))
    no = spark.createDataFrame([("material|junction=n|part=open", "material.open.primed"), ("material|junction=n|part=open", "material.open.primed"),
                                ("material|junction=n|part=open", "material.edge.primed"), ("other", "material.junction.primed")], "key string, route string")
    assert chosen(R.part_choices(x, no)) == {"open": ("material.open@1", 1, 3, 3, True), "edge": ("material.edge.primed", 1, 1, 0, False),
                                             "junction": ("material.junction.primed", 1, 1, 0, False)}


def test_points_off_the_road_say_nothing_and_junctions_are_named(spark):
    pts = spark.createDataFrame([(1, 7, 0, 0), (2, 7, 0, 1), (3, 7, 0, 2), (4, 7, 0, 3), (5, 7, 9, 9)], "placement_id long, image_id long, y int, x int")
    codes = spark.createDataFrame([(7, 0, 0, 0, 0), (7, 0, 1, 1, 3), (7, 0, 2, 3, 3), (7, 0, 3, 1, 0)], "image_id long, y int, x int, code int, junction_id long")
    dt = spark.createDataFrame([(7, 0, 1, 2.0)], "image_id long, y int, x int, dist double")
    js = spark.createDataFrame([(7, 3, "crossroads")], "image_id long, jid long, type string")
    c = R.part_choices(index(spark, ("open", 1, 50, 0, 1)))
    got = {r.placement_id: (r.on_road, r.part, r.edge_m, r.junction_id, r.junction_type, r.route) for r in R.inspect_point(pts, codes, dt, js, c, 0.25).collect()}
    assert got == {1: (False, None, None, None, None, None), 2: (True, "junction", 0.5, 3, "crossroads", "material.junction.primed"),
                   3: (True, "open", 0.0, None, None, "material.open@1"), 4: (True, "junction", 0.0, None, None, "material.junction.primed")}
