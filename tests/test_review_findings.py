"""Inputs that earlier versions cut or got wrong: long chains, many pairs, late rows, tolerance borders."""

import os
import subprocess
import sys

import pytest

from roadframe.operators import bridges as B, memory as M, network as N, raster as A, routing as R, training as T
from roadframe.streaming import log_streams as S


def test_deep_tree_keeps_its_leaf_and_a_cycle_is_an_error(spark):
    schema = "tree string, node int, parent int, answer string, route_id string, primed_id string"
    chain = [("t", k, k - 1 if k else None, f"a{k}", "leaf" if k == 20 else None, None) for k in range(21)]
    got = R.index_routes(spark.createDataFrame(chain, schema)).collect()
    assert [r["route_id"] for r in got] == ["leaf"] and got[0]["path"].count("/") == 19
    looped = [("t", 0, None, "a", None, None), ("t", 1, 0, "b", None, None), ("t", 1, 1, "c", None, None)]
    with pytest.raises(ValueError):
        R.index_routes(spark.createDataFrame(looped, schema))


def test_walk_of_a_hundred_streets(spark):
    n = 70
    ends = [(1, s, w, s + w, 10.0 * s + (1 + 8 * w), 0.0, 1.0 if w == 0 else -1.0, 0.0, 8.0) for s in range(n) for w in (0, 1)]
    ends = spark.createDataFrame(ends, "image_id long, street_id int, which int, node int, x double, y double, ux double, uy double, length double")
    nodes = spark.createDataFrame([(1, k, 10.0 * k, 0.0) for k in range(n + 1)], "image_id long, node int, cx double, cy double")
    walkers = spark.createDataFrame([(1, 1, 0, 0, 1e9)], "walker long, image_id long, street_id int, which int, need double")
    got = B.follow_straightest(walkers, ends, nodes)
    assert got.count() == n


def test_merged_library_takes_every_pair(spark):
    libs = spark.createDataFrame([("a", k, 100, 3, 8) for k in range(400)], "part string, pair_id long, pixels long, patches long, size_px int")
    assert T.merge_libraries(libs).select("pair_id").distinct().count() == 400
    shares = T.merge_shares(libs, 300).select("pair_id", "kept").collect()
    assert len(shares) == 400 and sum(r["kept"] for r in shares) == 300


def test_two_restores_get_versions_of_their_own(spark):
    v = spark.createDataFrame([("t", k, k * 10, "s", f"d{k}") for k in (1, 2)], "name string, version long, step_id long, source string, data string")
    w = spark.createDataFrame([("t", 1), ("t", 2)], "name string, restore long")
    assert sorted((r["version"], r["data"], r["step_id"]) for r in M.restore_tree(v, w).collect()) == [(3, "d1", 21), (4, "d2", 22)]


def test_border_arms_give_way_to_accepted_ones_only(spark):
    js = spark.createDataFrame([(1, 7, 5.0, 40.0, 20.0)], "image_id long, root long, cy double, cx double, r double")
    road = spark.createDataFrame([(1, 0, x, True) for x in (40, 42, 44)], "image_id long, y int, x int, road boolean")
    dims = spark.createDataFrame([(1, 64, 64)], "image_id long, h int, w int")
    arms = spark.createDataFrame([], "image_id long, root long, segment long, angle double, width_px double, off_image boolean")
    got = sorted(r["angle"] for r in N.border_arms(js, road, dims, arms).collect())
    assert [round(a, 1) for a in got] == [51.3, 90.0]


def test_missing_images_are_reported(spark):
    px = lambda i: [(i, y, x, 200) for y in range(2) for x in range(2)]
    one, both = (spark.createDataFrame(r, "image_id long, y int, x int, v int") for r in (px(1), px(1) + px(2)))
    assert {r["image_id"]: r["ok"] for r in T.check_alignment(both, one).collect()} == {1: True, 2: False}
    rgb = lambda d: d.selectExpr("image_id", "y", "x", "v r", "v g", "v b")
    diff, bad = A.isolate_noise(rgb(one), rgb(both))
    assert [r["image_id"] for r in bad.collect()] == [2] and diff.count() == 4


def _stream(spark, tmp_path, schema, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in os.listdir(f"{tmp_path}/in/{k}"):
            os.utime(f"{tmp_path}/in/{k}/{f}", (1000 + k, 1000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def test_rows_two_months_late_are_appended_once(spark, tmp_path):
    schema = "step_id long, ts timestamp"
    from datetime import datetime as D
    s = _stream(spark, tmp_path, schema, [[(1, D(2024, 3, 1)), (2, D(2024, 3, 2))], [(3, D(2024, 1, 1)), (1, D(2024, 3, 1))]])
    S.append_once(s, f"{tmp_path}/out", "step_id")
    assert sorted(r["step_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]


def test_new_pairs_across_a_cell_border(spark, tmp_path):
    s = _stream(spark, tmp_path, "request_id long, mask_id long, photo_id long, scale double",
                [[(1, 1, 1, 0.1000004), (2, 1, 1, 0.5)], [(3, 1, 1, 0.1000006), (4, 1, 1, 0.7), (5, 1, 1, 0.9000019)]])
    trained = spark.createDataFrame([(1, 1, 0.9000011)], "mask_id long, photo_id long, scale double")
    S.append_new_pairs(s, trained, f"{tmp_path}/out")
    assert sorted(r["scale"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0.1000004, 0.5, 0.7]


def test_a_review_a_million_steps_late_is_settled(spark, tmp_path):
    schema = "part string, pair_id long, step_id long, outcome string"
    early, rest = [("p", 1, 5, "rejected")], [("p", 1, 2_000_000 + k, "accepted") for k in range(3)]
    library = spark.createDataFrame([("p", 1, 10, 3, 8, 0.5)], "part string, pair_id long, pixels long, patches long, size_px int, confidence0 double")
    s = _stream(spark, tmp_path, schema, [rest[:2], [("p", 1, 3_000_000, "accepted")], early + rest[2:]])
    S.run_available(S.stream_replay_index(s, library), "update", f"{tmp_path}/out")
    log = spark.createDataFrame(early + rest + [("p", 1, 3_000_000, "accepted")], schema)
    raw = S.latest(spark, f"{tmp_path}/out", ["part", "pair_id"])
    assert raw.first()["too_late"] == 1
    got, want = S.settle_late(raw, log, library).first(), M.replay_index(library, log, ranked=False).first()
    assert (got["confidence"], got["rejections"], got["acceptances"]) == (want["confidence"], 1, 4)


def test_workers_need_no_installed_package(tmp_path):
    """A query whose Python functions call module functions runs from another folder, without the package on the path."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
import __spark_entry__ as E
print("ROWS", E.queries()["variation_factor"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in run.stdout, run.stderr[-2000:]
