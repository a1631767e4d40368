"""Findings of the second advice."""

from roadframe.operators import bridges


def test_walks_end_at_nodes_without_a_patch_and_list_side_streets(spark):
    ends = [(1, 0, 9, 0.0), (1, 1, 1, 10.0), (2, 0, 1, 10.0), (2, 1, 2, 20.0), (3, 0, 2, 20.0), (3, 1, 8, 30.0)]
    rows = [(1, s, w, n, x, 0.0, 1.0 if w == 0 else -1.0, 0.0, 10.0) for s, w, n, x in ends] + [(1, 4, 0, 1, 10.0, 0.0, 0.0, 1.0, 10.0), (1, 4, 1, 7, 10.0, 10.0, 0.0, -1.0, 10.0)]
    e = spark.createDataFrame(rows, "image_id int, street_id int, which int, node int, x double, y double, ux double, uy double, length double")
    nodes = [(1, 1, 10.0, 0.0, True), (1, 2, 20.0, 0.0, False), (1, 9, 0.0, 0.0, True), (1, 8, 30.0, 0.0, True), (1, 7, 10.0, 10.0, True)]
    n = spark.createDataFrame(nodes, "image_id int, node int, cx double, cy double, patch boolean")
    w = spark.createDataFrame([(1, 1, 1, 0, 100.0)], "walker int, image_id int, street_id int, which int, need double")
    walked = bridges.follow_straightest(w, e, n)
    assert sorted((r["hop"], r["street_id"]) for r in walked.collect()) == [(0, 1), (1, 2)]
    assert [tuple(r) for r in bridges.side_streets(walked, e).collect()] == [(1, 1, 1, 1, 4, 0)]
    assert bridges.follow_straightest(w, e, n.drop("patch")).count() == 3


def test_new_pairs_of_one_batch_are_kept_by_the_last_accepted_scale(spark, tmp_path):
    from roadframe.streaming import log_streams
    schema, scales = "request_id long, mask_id long, photo_id long, scale double", [0.5, 0.5000006, 0.5000012, 0.7000001, 0.7000007, 0.7000013]
    spark.createDataFrame([(n, 1, 1, s) for n, s in enumerate(scales)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    trained = spark.createDataFrame([(1, 1, 0.7)], "mask_id long, photo_id long, scale double")
    log_streams.append_new_pairs(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), trained, f"{tmp_path}/out")
    assert sorted(r["scale"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0.5, 0.5000012, 0.7000013]
