"""The paths that only matter on large inputs, forced with tiny chunks and tiles and compared with brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadframe.operators import common as C, geometry as Q, memory as M, network as N, routing as R, synth as S, training as T


def half_even(u):
    h, odd = divmod(u, 2)
    return h + (odd and h % 2)


def test_confidence_replay_in_chunks(spark):
    rnd = random.Random(3)
    rows = [("open", 1 if rnd.random() < 0.7 else rnd.randint(2, 6), s, rnd.random() < 0.5) for s in range(3000)]
    rows += [("open", 7, 10_000 + i, True) for i in range(8)] + [("open", 8, 20_000 + i, False) for i in range(9)]
    ev = spark.createDataFrame(rows, "part string, pair_id long, step_id long, reject boolean")
    start = spark.createDataFrame([("open", i, 0.6) for i in range(1, 10)], "part string, pair_id long, confidence double")
    got = {r.pair_id: r.confidence for r in M.confidence_replay(ev, start, chunk=50, fan=4, raw=5).collect()}
    want = {i: 6000 for i in range(1, 10)}
    for _, p, _, rej in sorted(rows, key=lambda r: r[2]):
        want[p] = max(100, half_even(want[p])) if rej else min(9800, want[p] + 500)
    assert got == {p: round(u / 1e4, 4) for p, u in want.items()}
    assert got[7] == 0.01 and got[8] == 0.98 and got[9] == 0.6


def test_clamped_replay_in_chunks(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(1, 3), s, "grain", rnd.choice([-15, 15])) for s in range(500)]
    d = spark.createDataFrame(rows, "session int, step_id long, setting string, delta int")
    got = {r.session: r.grain for r in R.apply_adjustments(d, chunk=7).collect()}
    want = {1: 50, 2: 50, 3: 50}
    for k, _, _, v in rows:
        want[k] = max(0, min(100, want[k] + v))
    assert got == want


def test_range_rank_matches_window(spark):
    d = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 501).alias("v"))
    got = sorted((r.k, r.v, r.rank) for r in M.range_rank(d, ["k"], [F.col("v").desc()], "rank").collect())
    by = {}
    for k in range(3):
        for i, v in enumerate(sorted((x * 7919 % 501 for x in range(500) if x % 3 == k), reverse=True), 1):
            by[(k, v)] = i
    assert got == sorted((k, v, i) for (k, v), i in by.items())


def test_prefix_sum_and_running_max_across_chunks(spark):
    d = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("seq"), (F.col("id") * 37 % 11).cast("double").alias("v"))
    v = [float(i * 37 % 11) for i in range(100)]
    s = {r.seq: r.s for r in C.prefix_sum(d, ["k"], "seq", F.col("v"), "s", 7).collect()}
    m = {r.seq: r.m for r in C.running_max(d, ["k"], "seq", F.col("v"), "m", 7).collect()}
    assert all(s[i] == sum(v[:i + 1]) and m[i] == max(v[:i + 1]) for i in range(100))


def test_exact_quantiles(spark):
    rnd = np.random.default_rng(1)
    v = np.concatenate([rnd.normal(size=300), np.zeros(200)])
    d = spark.createDataFrame([(1, float(x)) for x in v] + [(2, 5.0)], "k int, v double")
    got = {r.k: r for r in C.exact_quantiles(d, ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.95}, buckets=16).collect()}
    for q, p in (("a", 5), ("b", 50), ("c", 95)):
        assert abs(got[1][q] - np.percentile(v, p)) < 1e-12 and got[2][q] == 5.0


def test_components_on_a_long_path_and_a_star(spark):
    edges = [(1, i, i + 1) for i in range(1, 200)] + [(1, 1000, 1000 + i) for i in range(1, 50)] + [(2, 5, 5)]
    got = {(r.g, r.id): r.label for r in C.connected_components(spark.createDataFrame(edges, "g int, u long, v long"), ["g"]).collect()}
    assert all(got[(1, i)] == 1 for i in range(1, 201)) and all(got[(1, 1000 + i)] == 1000 for i in range(50))


def brute_labels(px, eight):
    left, out = set(px), {}
    while left:
        seed = min(left)
        todo, comp = [seed], set()
        while todo:
            y, x = todo.pop()
            if (y, x) not in left:
                continue
            left.discard((y, x))
            comp.add((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if eight or abs(dy) + abs(dx) == 1:
                        todo.append((y + dy, x + dx))
        for p in comp:
            out[p] = min(comp)
    return out


@pytest.mark.parametrize("eight", [False, True])
def test_regions_across_tiles(spark, eight):
    rnd = np.random.default_rng(7)
    a = rnd.random((40, 40)) < 0.55
    px = [(int(y), int(x)) for y, x in zip(*np.nonzero(a))]
    d = spark.createDataFrame([(1, y, x) for y, x in px], "image_id long, y int, x int")
    got = {(r.y, r.x): (r.label >> 31, r.label & ((1 << 31) - 1)) for r in C.label_regions(d, eight, tile=7).collect()}
    assert got == brute_labels(px, eight)


def dense(spark, a, name="inside"):
    return spark.createDataFrame([(1, int(y), int(x), bool(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], f"image_id long, y int, x int, {name} boolean")


def test_distance_transform_brute_force(spark):
    rnd = np.random.default_rng(2)
    a = rnd.random((25, 30)) < 0.85
    got = {(r.y, r.x): r.dist for r in N.distance_transform(dense(spark, a)).collect()}
    off = np.argwhere(~a)
    for (y, x), d in got.items():
        assert abs(d - math.sqrt(((off - [y, x]) ** 2).sum(1).min())) < 1e-9


def test_distance_of_an_image_without_background(spark):
    assert all(r.dist is None for r in N.distance_transform(dense(spark, np.ones((4, 5), bool))).collect())


def test_fill_nearest_tie_break(spark):
    d = spark.createDataFrame([(1, 0, x, x in (0, 4), float(x)) for x in range(5)], "image_id long, y int, x int, f boolean, v double")
    got = {r.x: r.v for r in S.fill_nearest(d, "f", ["v"]).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0, 3: 4.0, 4: 4.0}


def test_thinning_does_not_depend_on_tiles(spark):
    rnd = np.random.default_rng(4)
    a = np.zeros((60, 60), bool)
    a[20:33, :] = a[:, 25:38] = a[5:15, 5:50] = True
    a &= rnd.random(a.shape) < 0.995
    d = spark.createDataFrame([(1, int(y), int(x)) for y, x in np.argwhere(a)], "image_id long, y int, x int")
    one = {(r.y, r.x) for r in N.skeleton(d, tile=256, rounds=32).collect()}
    many = {(r.y, r.x) for r in N.skeleton(d, tile=9, rounds=2).collect()}
    assert one == many and one


def test_blur_across_tiles(spark):
    rnd = np.random.default_rng(6)
    a = rnd.random((20, 23))
    d = spark.createDataFrame([(1, y, x, float(a[y, x])) for y in range(20) for x in range(23)], "image_id long, y int, x int, v double")
    from roadframe.functions.kernels import gaussian_weights
    w = gaussian_weights(1.5)
    r = len(w) // 2
    for wrap in (False, True):
        ext = np.pad(a, r, mode="wrap" if wrap else "symmetric")
        want = C.weigh(ext, w)
        got = C.stencil(d, ["v"], r, lambda t: {"v": C.weigh(t["v"], w)}, ["v"], tile=8, wrap=wrap).collect()
        assert len(got) == 460 and all(abs(g.v - want[g.y, g.x]) < 1e-12 for g in got)


def street(spark, n=60, seed=1):
    rnd = random.Random(seed)
    pts, x, y = [], 0.0, 0.0
    for i in range(n):
        pts.append((1, i, x, y, 3.0 + rnd.random()))
        x, y = x + 1 + rnd.random(), y + rnd.uniform(-1, 1)
    return spark.createDataFrame(pts, "street_id long, seq int, x double, y double, hw double"), pts


def test_line_operators_do_not_depend_on_chunks(spark):
    d, _ = street(spark)
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    for op in (lambda c: Q.smooth_path(d, 7, chunk=c), lambda c: Q.smooth_line(d, 9, chunk=c).select("street_id", "seq", "x", "y"),
               lambda c: Q.arc_length(d, chunk=c).select("seq", "arc"), lambda c: Q.tangents(d, chunk=c).select("seq", "tx", "ty"),
               lambda c: Q.robust_width(d, 0.3, 1.0, chunk=c).select("seq", "width")):
        assert rows(op(10)) == rows(op(65536))


def test_greedy_keep_across_chunks(spark):
    rnd = random.Random(9)
    nx = [min(i + rnd.randint(1, 9), 199) for i in range(199)] + [None]
    d = spark.createDataFrame([(1, i, v) for i, v in enumerate(nx)], "street_id long, seq long, nx long")
    want, cur = [], 0
    while cur is not None:
        want.append(cur)
        cur = nx[cur]
    for chunk in (12, 65536):
        assert sorted(r.seq for r in Q.greedy_keep(d, ["street_id"], chunk).collect()) == want


def test_nearest_segment_grows_its_search(spark):
    rnd = random.Random(4)
    segs = [(1, i, *[rnd.uniform(0, 300) for _ in range(4)]) for i in range(12)]
    pts = [(1, i, rnd.uniform(-200, 500), rnd.uniform(-200, 500)) for i in range(60)]
    s = spark.createDataFrame(segs, "k int, sid int, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame(pts, "k int, pid int, x double, y double")

    def dist(px, py, x0, y0, x1, y1):
        dx, dy = x1 - x0, y1 - y0
        t = max(0, min(1, ((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy)))
        return math.hypot(px - x0 - t * dx, py - y0 - t * dy)

    got = {r.pid: r.dist for r in Q.nearest_segment(p, s, ["k"], cell=4.0).collect()}
    assert len(got) == 60
    for _, i, x, y in pts:
        assert abs(got[i] - min(dist(x, y, *g[2:]) for g in segs)) < 1e-8


def test_lengths_of_short_streets(spark):
    d = spark.createDataFrame([(1, 0, 5.0, 5.0, 1.0), (2, 0, 0.0, 0.0, 1.0), (2, 1, 0.0, 0.0, 1.0), (3, 0, 0.0, 0.0, 1.0), (3, 1, 3.0, 4.0, 1.0)], "street_id long, seq int, x double, y double, hw double")
    arc = {(r.street_id, r.seq): r.arc for r in Q.arc_length(d).collect()}
    assert arc == {(1, 0): 0.0, (2, 0): 0.0, (2, 1): 0.0, (3, 0): 0.0, (3, 1): 5.0}
    r = sorted((x.street_id, x.seq, x.x, x.y) for x in Q.resample_line(d, 2.5).collect())
    assert [t for t in r if t[0] == 3] == [(3, 0, 0.0, 0.0), (3, 1, 1.5, 2.0), (3, 2, 3.0, 4.0)]
    assert (1, 0, 5.0, 5.0) in r


def test_taubin_across_chunks(spark):
    n = 50
    ring = spark.createDataFrame([(1, i, 32 + 20 * math.cos(i / n * 6.283) + (i * 7 % 3), 32 + 20 * math.sin(i / n * 6.283)) for i in range(n)], "ring_id long, seq int, x double, y double")
    rows = lambda c: sorted((r.seq, round(r.x, 9), round(r.y, 9)) for r in Q.taubin_smooth(ring, 6, 64.0, 64.0, chunk=c).collect())
    assert rows(13) == rows(4096) and len(rows(13)) == n


def test_spur_is_pruned_and_border_road_stays(spark):
    line = [(30, x) for x in range(60)] + [(y, 30) for y in range(26, 30)]
    sk = spark.createDataFrame([(1, y, x) for y, x in line], "image_id long, y int, x int")
    dt = sk.withColumn("dist", F.lit(2.0))
    dims = spark.createDataFrame([(1, 60, 60)], "image_id long, h int, w int")
    out, n = N.prune_spurs(sk, dt, dims)
    left = {(r.y, r.x) for r in out.collect()}
    assert n.first().pruned == 1 and not any(y < 29 for y, _ in left) and (30, 0) in left and (30, 59) in left


def test_clean_mask_fills_specks_and_drops_small_roads(spark):
    a = np.zeros((40, 40), int)
    a[10:30, :] = 255
    a[18, 20] = 0              # speck
    a[2:5, 2:5] = 255          # nine stray road pixels
    d = spark.createDataFrame([(1, y, x, int(a[y, x])) for y in range(40) for x in range(40)], "image_id long, y int, x int, v int")
    road, counts = N.clean_mask(d)
    on = {(r.y, r.x) for r in road.filter("road").collect()}
    assert (18, 20) in on and (3, 3) not in on and counts.first().specks_filled == 1


def test_empty_mask(spark):
    d = spark.createDataFrame([(1, y, x, 0) for y in range(8) for x in range(8)], "image_id long, y int, x int, v int")
    road, _ = N.clean_mask(d)
    assert road.filter("road").count() == 0
    assert N.skeleton(road.filter("road").select("image_id", "y", "x")).count() == 0


def test_choose_pair_when_everything_sits_out(spark):
    idx = spark.createDataFrame([("open", 1, 1, 9, 1, 0.5), ("open", 2, 2, 3, 0, 0.5)], "part string, pair_id long, rank long, patches long, cooldown long, confidence double")
    asks = spark.createDataFrame([(1, "open", None, False), (2, "open", None, True), (3, "edge", 5, False)], "ask_id int, part string, prefer_pair long, primed_rejected boolean")
    got = {r.ask_id: (r.route, r.exhausted) for r in R.choose_pair(idx, asks).collect()}
    assert got == {1: ("material.open.primed", False), 2: ("material.open@1", True), 3: ("material.edge.primed", False)}


def test_stream_replay_takes_late_rows(spark):
    from roadframe.operators import common
    from roadframe.streaming import log_streams as L
    schema = "part string, pair_id long, step_id long, outcome string"
    path = L.new_folder(spark, "late")
    first = [("open", 1, s, "accepted" if s % 3 else "rejected") for s in range(10, 20)]
    late = [("open", 1, s, "rejected") for s in range(5, 8)] + first[:2]
    for rows in (first, late):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    lib = spark.createDataFrame([("open", 1, 0.6)], "part string, pair_id long, confidence0 double")
    out = L.new_folder(spark, "late-out")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    L.run_available(L.stream_replay_index(src, lib), "update", out)
    u = 6000
    for _, _, _, o in sorted({r[2]: r for r in first + late}.values(), key=lambda r: r[2]):
        u = max(100, half_even(u)) if o == "rejected" else min(9800, u + 500)
    row = L.latest(spark, out, ["part", "pair_id"]).first()
    assert row.confidence == round(u / 1e4, 4) and row.too_late == 0 and row.rejections + row.acceptances == 13
