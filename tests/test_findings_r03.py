"""Inputs of the third review round that gave wrong results or large broadcasts."""

import math
import random

from pyspark.sql import functions as F

import __spark_entry__
from roadframe.operators import geometry as Q, memory as M, mesh as E, raster as A, training as TR
from roadframe.sources import fixtures as X


def test_width_classes_are_medians_of_the_groups(spark):
    widths = [.10] * 4 + [.20] * 3 + [.30] * 2 + [.40]
    streets = spark.createDataFrame(list(enumerate(widths)), "street_id long, width_m double")
    centres, near = E.dash_width_classes(streets)
    assert sorted(r["cm"] for r in centres.collect()) == [10, 20, 30]
    assert [r["cm"] for r in near.orderBy("street_id").collect()] == [10] * 4 + [20] * 3 + [30] * 3


def test_a_share_above_one_keeps_its_tenths(spark):
    v = spark.createDataFrame([(0.25,), (1.0,), (1.04,), (1.12,)], "v double")
    key = M.situation_key(F.lit("t"), {"share": ("share", F.col("v")), "speed": ("number", F.col("v"))})
    assert [r["k"] for r in v.orderBy("v").select(key.alias("k")).collect()] == [
        "t|share=0.2|speed=0.2", "t|share=1.0|speed=1.0", "t|share=1.0|speed=1", "t|share=1.1|speed=1"]


def test_joins_are_not_broadcast_by_estimates(spark, sf):
    """An exploded table is estimated at its size before, a written one at its compressed size."""
    plan = __spark_entry__.queries()["crossing_pair"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


def test_grids_have_partitions_by_their_pixels(spark, sf, monkeypatch):
    monkeypatch.setattr(X, "PIXELS_A_TASK", 64 * 64 // 8, raising=False)
    images = X.table(spark, sf, "supplier").count()
    assert X.mask_px(spark, sf).rdd.getNumPartitions() >= 8 * images


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_short_streets_and_rings_are_not_a_python_call_each(spark, sf):
    """Thousands of short groups took a call each: hours at a hundred times the rows."""
    for name in ("row_keep", "adaptive_keep", "taubin_smooth"):
        plan = plan_of(__spark_entry__.queries()[name](spark, sf))
        assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan


def test_walks_of_many_streets_in_one_frame(spark):
    rnd, rows, want = random.Random(2), [], set()
    for street in range(40):
        n = rnd.randint(1, 30)
        nx = [min(i + rnd.randint(1, 9), n - 1) if i < n - 1 else None for i in range(n)]
        rows += [(street, i, v) for i, v in enumerate(nx)]
        cur = 0
        while cur is not None:
            want.add((street, cur))
            cur = nx[cur]
    d = spark.createDataFrame(rows, "street_id long, seq long, nx long")
    for chunk in (12, 65536):
        got = [tuple(r) for r in Q.greedy_keep(d, ["street_id"], chunk).select("street_id", "seq").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_only_streets_with_open_rows_look_further(spark):
    far = [(1, i, i == 500) for i in range(501)] + [(2, i, i % 7 == 6) for i in range(70)]
    d = spark.createDataFrame(far, "street_id long, seq int, stop boolean")
    got = {(r.street_id, r.seq): r.nx for r in Q.next_where(d, ["street_id"], ["stop"], lambda j: j["stop"]).collect()}
    assert len(got) == 571
    for s, i, _ in far:
        assert got[s, i] == min((j for t, j, stop in far if t == s and j > i and stop), default=None)


def test_a_ring_without_coordinates_leaves_its_neighbours_alone(spark):
    rings = [(r, i, 32 + 20 * math.cos(i / 2) + r, 32 + 20 * math.sin(i / 2)) for r in range(3) for i in range(12)]
    schema = "ring_id long, seq int, x double, y double"
    alone = {tuple(r) for r in Q.taubin_smooth(spark.createDataFrame([r for r in rings if r[0] != 1], schema), 4, 64.0, 64.0).collect()}
    odd = [(r, i, None if r == 1 and i == 11 else x, y) for r, i, x, y in rings]
    together = {tuple(r) for r in Q.taubin_smooth(spark.createDataFrame(odd, schema).coalesce(1), 4, 64.0, 64.0).collect()}
    assert {r for r in together if r[0] != 1} == alone


def test_pairs_without_a_share_are_not_ordered(spark):
    """The patches of the last pair would not fit one array."""
    libs = [("open", p, 1 if p else 10 ** 6, 5, 8) for p in range(50)] + [("open", 50, 1, 2 ** 31 - 1, 8)]
    chosen = TR.merge_libraries(spark.createDataFrame(libs, "part string, pair_id long, pixels long, patches long, size_px int"), 3).collect()
    assert len(chosen) == 3 and {r.pair_id for r in chosen} == {0}


def test_pixels_of_faces_are_summed_up_in_hash_tables(spark, sf):
    plan = plan_of(__spark_entry__.queries()["rasterise_faces"](spark, sf))
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_meshes_are_spread_before_they_are_expanded(spark, sf, monkeypatch):
    monkeypatch.setattr(X, "ROWS_A_TASK", 8, raising=False)
    for fixture in (X.mesh_vertex, X.mesh_quad, X.ring, X.lattice_street):
        assert fixture(spark, sf).rdd.getNumPartitions() > 1


def test_sizes_are_spread_before_they_become_origins(spark, monkeypatch):
    """Sizes are few: all origins of a corpus came out of one task."""
    sizes = spark.createDataFrame([(i, 64, 64, 8 + i % 3) for i in range(60)], "image_id long, h int, w int, size int").coalesce(1)
    whole = {tuple(r) for r in A.patch_origins(sizes, 4).collect()}
    monkeypatch.setattr(A, "ORIGINS_A_TASK", 1000, raising=False)
    org = A.patch_origins(sizes, 4)
    assert org.rdd.getNumPartitions() > 1
    assert {tuple(r) for r in org.collect()} == whole and len(whole) == 60 * 160


def test_scans_of_many_small_files_are_many_tasks(spark, sf, tmp_path):
    """Small files were packed up to 128 MB, and a compressed pixel takes less than a byte."""
    spark.range(0, 12, 1, 12).write.parquet(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        __spark_entry__.queries()["grain"](spark, sf)
        assert spark.read.parquet(f"{tmp_path}/t").rdd.getNumPartitions() >= 3
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_dashes_are_read_off_line_counts(spark, sf):
    """Pixels were joined with the boxes of their images, and a task held millions of them."""
    gray = X.photo_px(spark, sf).select("image_id", "y", "x", F.lit(255).alias("v"))
    plan = plan_of(A.dash_pattern(gray))
    assert "explode" not in plan.lower() and "Scan parquet" in plan


def test_dashes_of_a_column_and_of_too_little_paint(spark):
    rows = [(1, y, x, 255 if x in (3, 4) and y % 12 < 7 else 0) for y in range(48) for x in range(10)]
    rows += [(2, y, x, 255 if x == 3 and y < 19 else 0) for y in range(48) for x in range(10)]
    got = A.dash_pattern(spark.createDataFrame(rows, "image_id long, y int, x int, v int")).collect()
    assert [(r.image_id, r.found, r.orientation, r.dash_px, r.gap_px, r.width_px, r.dashes_measured) for r in got] == [
        (1, True, "vertical", 7.0, 5.0, 2, 4)]


def test_a_crowd_in_one_spot_is_compared_once(spark, monkeypatch):
    seen = []
    found = Q.nearest_segment
    monkeypatch.setattr(Q, "nearest_segment", lambda p, s, *a: seen.append((p.count(), s.count())) or found(p, s, *a))
    pts = spark.createDataFrame([(1, i, float(i % 2), 0.0) for i in range(200)], "image_id long, pid long, x double, y double")
    refs = spark.createDataFrame([(1, i, float(i % 2), 3.0) for i in range(100)], "image_id long, rid long, x double, y double")
    got = {r.pid: (r.rid, r.dist) for r in Q.nearest_neighbour(pts, refs, ["image_id"], 8.0).collect()}
    assert got == {i: (i % 2, 3.0) for i in range(200)}
    assert seen == [(2, 2)]
