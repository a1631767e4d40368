"""Measuring aligned mask/photo pairs, part by part, and folding them into the library index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from roadframe.functions.scalars import clip, mix, pick
from roadframe.operators import network as N, raster as A
from roadframe.operators.common import label_regions, lines, let, materialize, scatter_offsets
from roadframe.operators.memory import last_wins, range_rank, set_index
from roadframe.operators.synth import resize_to

IMG = "image_id"
# fixed values of the training rules
EDGE_METRES = 1.5
MIN_PATCHES = 6
DEFAULT_WIDTH = 8.0


def check_alignment(mask: DataFrame, photo: DataFrame) -> DataFrame:
    """Sizes of each mask and its photo; an image that only one side has is not ok, and the missing sizes are null."""
    a, b = A.dims(mask), A.dims(photo).withColumnsRenamed({"h": "photo_h", "w": "photo_w"})
    ok = (F.col("h") == F.col("photo_h")) & (F.col("w") == F.col("photo_w"))
    return a.join(b, IMG, "full").select(IMG, "h", "w", "photo_h", "photo_w", F.coalesce(ok, F.lit(False)).alias("ok"))


def kerb_band(sk: DataFrame, dt: DataFrame, images: DataFrame, mpp: float) -> DataFrame:
    """Road width per image and the kerb band: 1.5 m, but at most a quarter of the road."""
    wd = sk.select(IMG, "y", "x").join(dt.select(IMG, "y", "x", "dist"), [IMG, "y", "x"]).groupBy(IMG).agg(
        (F.percentile("dist", F.lit(0.5)) * 2).alias("road_width"))
    d = images.select(IMG).join(wd, IMG, "left").select(IMG, F.coalesce("road_width", F.lit(DEFAULT_WIDTH)).alias("road_width"))
    band = F.least(F.lit(EDGE_METRES), F.greatest(F.lit(0.05), F.col("road_width") * mpp * 0.25))
    return d.withColumn("band_m", band).withColumn("capped", F.col("band_m") < EDGE_METRES - 1e-6)


def classify_pixels(surface: DataFrame, js: DataFrame, bands: DataFrame, mpp: float) -> DataFrame:
    """surface(image_id, y, x, dist) -> part per pixel: junction disc, then kerb band, then open road."""
    discs = js.filter("type not in ('interchange (flagged)', 'not a junction')").select(IMG, "root", "cy", "cx", "r")
    hit = N.in_discs(surface.select(IMG, "y", "x"), discs).select(IMG, "y", "x").distinct().withColumn("_j", F.lit(True))
    d = surface.join(hit, [IMG, "y", "x"], "left").join(bands.select(IMG, "band_m"), IMG)
    part = F.when(F.col("_j"), "junction").when(F.col("dist") * mpp <= F.col("band_m"), "edge").otherwise("open")
    return d.select(IMG, "y", "x", "dist", part.alias("part"))


def paint_threshold(road_gray: DataFrame) -> DataFrame:
    """Robust brightness limit per image over road pixels; grey levels are 8-bit, so medians are exact and small."""
    med = road_gray.groupBy(IMG).agg(F.percentile("v", F.lit(0.5)).alias("med"))
    mad = road_gray.join(med, IMG).groupBy(IMG).agg(F.first("med").alias("med"), F.percentile(F.abs(F.col("v") - F.col("med")), F.lit(0.5)).alias("mad"))
    m = F.greatest(F.col("mad") * 1.4826, F.lit(1.0))
    return mad.select(IMG, "med", "mad", (F.col("med") + F.greatest(m * 3.0, F.lit(25.0))).alias("threshold"))


def paint_pixels(road_gray: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paint core, paint grown by one pixel inside the road)."""
    core = road_gray.join(limits.select(IMG, "threshold"), IMG).filter("v > threshold").select(IMG, "y", "x")
    plus = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
    grown = scatter_offsets(core, plus).distinct().join(road_gray.select(IMG, "y", "x"), [IMG, "y", "x"], "left_semi")
    return core, grown


def neighbour_diff(gray: DataFrame) -> DataFrame:
    """Per pixel mean absolute difference to the four neighbours, wrapping at the borders."""
    rows = lines(gray, [IMG, "y"], "x", ["v"]).select(IMG, "y", F.transform("a", lambda s: s["v"].cast("double")).alias("a"))
    h = rows.groupBy(IMG).agg(F.count(F.lit(1)).alias("h"))
    d = rows.join(h, IMG)
    side = lambda n, step: rows.select(IMG, F.col("y").alias(f"y_{n}"), F.col("a").alias(n))
    d = d.withColumn("y_up", F.pmod(F.col("y") - 1, F.col("h")).cast("int")).withColumn("y_dn", F.pmod(F.col("y") + 1, F.col("h")).cast("int"))
    d = d.join(side("up", -1), [IMG, "y_up"]).join(side("dn", 1), [IMG, "y_dn"])

    def per_row(s):
        n = F.size(s["a"])
        at = lambda arr, i: F.get(arr, F.pmod(i, n))
        one = lambda i: let(F.get(s["a"], i), lambda v: (F.abs(v - at(s["a"], i - 1)) + F.abs(v - at(s["a"], i + 1))
                                                        + F.abs(v - F.get(s["up"], i)) + F.abs(v - F.get(s["dn"], i))) / 4.0)
        return F.transform(F.sequence(F.lit(0), n - 1), one)

    z = d.select(IMG, "y", F.posexplode(let(F.struct("a", "up", "dn"), per_row)).alias("x", "diff"))
    return z


def group_stats(parts: DataFrame, gray: DataFrame) -> DataFrame:
    """Tone, contrast and grain per (image, part); fewer than 50 pixels only give their number."""
    fine = A.fine_detail(gray)
    d = parts.select(IMG, "y", "x", "part").join(fine, [IMG, "y", "x"]).join(neighbour_diff(gray), [IMG, "y", "x"])
    g = d.groupBy(IMG, "part").agg(
        F.count(F.lit(1)).alias("pixels"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", F.lit(0.05)).alias("p5"),
        F.percentile("v", F.lit(0.95)).alias("p95"), F.avg("diff").alias("local_contrast"), F.stddev_pop("fine").alias("grain"))
    few = F.col("pixels") < 50
    # fixed values: the readings' texts
    reading = (F.when(few, "too few pixels to measure").when(F.col("grain") < 1.0, "flat, almost no grain")
               .when(F.col("grain") < 6, "fine grain").otherwise("coarse, heavily worn"))
    total = g.groupBy(IMG).agg(F.sum("pixels").alias("_all"))
    keep = [F.when(~few, F.col(c)).alias(c) for c in ("mean", "std", "p5", "p95", "local_contrast", "grain")]
    return g.join(total, IMG).select(IMG, "part", "pixels", *keep, reading.alias("reading"), (F.col("pixels") / F.col("_all")).alias("share"))


def line_width_ratio(core: DataFrame, widths: DataFrame, dims: DataFrame) -> DataFrame:
    """Painted line width along its own centreline and as a share of the road width."""
    total = core.groupBy(IMG).agg(F.count(F.lit(1)).alias("paint_px"))
    lab = materialize(label_regions(core))
    big = lab.groupBy(IMG, "label").agg(F.count(F.lit(1)).alias("n")).filter("n >= 12")
    strokes = materialize(lab.join(big.select(IMG, "label"), [IMG, "label"], "left_semi").select(IMG, "y", "x"))
    n = strokes.groupBy(IMG).agg(F.count(F.lit(1)).alias("stroke_px"))
    enough = n.filter("stroke_px >= 50").join(total.filter("paint_px >= 50"), IMG).select(IMG)
    s = strokes.join(enough, IMG, "left_semi")
    # only the neighbourhood of the strokes matters: each stroke pixel and the ring around it
    ring = scatter_offsets(s, [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]).distinct()
    grid = dims.join(enough, IMG, "left_semi").select(IMG, "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y")).select(
        IMG, "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))
    dense = grid.join(s.withColumn("inside", F.lit(True)), [IMG, "y", "x"], "left").select(IMG, "y", "x", F.coalesce("inside", F.lit(False)).alias("inside"))
    dt = N.distance_transform(dense).filter("inside")
    wid = N.skeleton(s).join(dt, [IMG, "y", "x"]).groupBy(IMG).agg(F.percentile(F.col("dist") * 2 - 1, F.lit(0.5)).alias("line_width_px"))
    d = widths.select(IMG, "road_width").join(total, IMG, "left").join(n, IMG, "left").join(wid, IMG, "left")
    ok = F.col("line_width_px") > 0
    return d.select(IMG, F.when(ok, F.col("line_width_px")).alias("line_width_px"),
                    F.when(ok, F.col("line_width_px") / F.col("road_width")).alias("line_ratio"),
                    F.when(ok, F.col("stroke_px")).otherwise(F.coalesce("paint_px", F.lit(0))).alias("paint_px"))


def patch_size_rule(d: DataFrame, mpp: float) -> DataFrame:
    """d(image_id, road_width, band_m, junction_r): patch sizes that fit the road, the band and the junctions."""
    rnd = lambda c: F.bround(c, 0).cast("int")
    w, band_px = F.col("road_width"), F.col("band_m") / max(mpp, 1e-6)
    return d.select(IMG, clip(rnd(w * 0.9), 6, 64).alias("open"), clip(rnd(F.least(w * 0.5, band_px * 0.9)), 4, 48).alias("edge"),
                    clip(rnd(F.coalesce("junction_r", w) * 0.9), 6, 64).alias("junction"))


def build_library(sizes: DataFrame, px: DataFrame, count: int, attempts: int = 4, seed: int = 7, tries: int = 40) -> DataFrame:
    """sizes(image_id, part, size, h, w); px(image_id, y, x, part or null, exclude, tone).

    All shrinking attempts are measured together and the first with enough patches (or the last) is kept.
    """
    nxt = lambda s: F.greatest(F.lit(4), F.floor(s * 0.6 + 1e-9).cast("int"))
    d = sizes.withColumn("_s0", F.least(F.col("size"), F.floor(F.col("h") / 2).cast("int"), F.floor(F.col("w") / 2).cast("int")))
    for i in range(1, attempts):
        d = d.withColumn(f"_s{i}", F.when(F.col(f"_s{i - 1}") > 4, nxt(F.col(f"_s{i - 1}"))))
    d = d.select(IMG, "part", "h", "w", F.posexplode(F.array(*[F.col(f"_s{i}") for i in range(attempts)])).alias("attempt", "size")).filter("size is not null")
    org = A.patch_origins(d.select(IMG, "h", "w", "size").distinct(), count, tries, seed)
    parts = ("junction", "edge", "open")
    f = [*[f"in_{p}" for p in parts], "exclude"]
    sat = A.integral(px.select(IMG, "y", "x", "exclude", *[F.when(F.col("part") == p, 1).otherwise(0).alias(f"in_{p}") for p in parts]), f)
    s = A.window_sums(org, sat, f)
    e = d.select(IMG, "part", "attempt", "size").join(s, [IMG, "size"])
    area = F.col("size") * F.col("size")
    inside = F.when(F.col("part") == "junction", F.col("sum_in_junction")).when(F.col("part") == "edge", F.col("sum_in_edge")).otherwise(F.col("sum_in_open"))
    ok = (inside / area >= F.when(F.col("part") == "edge", 0.5).otherwise(0.6)) & (F.col("sum_exclude") == 0)
    n = e.groupBy(IMG, "part", "attempt", "size").agg(F.least(F.count_if(ok), F.lit(count)).alias("patches"))
    rank = F.struct((F.col("patches") < MIN_PATCHES) & (F.col("size") > 4), F.when(F.col("patches") >= MIN_PATCHES, F.col("attempt")).otherwise(-F.col("attempt")))
    best = n.groupBy(IMG, "part").agg(F.min_by(F.struct("attempt", "size", "patches"), rank).alias("b"))
    return best.select(IMG, "part", "b.attempt", "b.size", "b.patches", (F.col("b.patches") >= MIN_PATCHES).alias("usable"))


def usable_groups(libs: DataFrame, widths: DataFrame) -> DataFrame:
    return libs.join(widths.select(IMG, "road_width"), IMG).select(
        IMG, "part", "patches", (F.col("patches") >= MIN_PATCHES).alias("usable"), (F.col("road_width") >= 20).alias("resolution_ok"))


def train_incremental(requests: DataFrame, trained: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Requests (mask_id, photo_id, scale) that no trained pair answers within the scale tolerance."""
    from roadframe.operators.memory import find_trained_pair
    done = find_trained_pair(trained, requests, tol)
    return requests.join(done.select("request_id"), "request_id", "left_anti")


def rebuild_index(groups: DataFrame, old: DataFrame) -> DataFrame:
    """groups(part, pair_id, pixels, patches, size_px, usable): index of the usable ones, earlier trust kept."""
    return set_index(groups.filter("usable"), old)


def weighted_line_ratio(samples: DataFrame) -> DataFrame:
    """Weighted median of line ratios: samples(ratio, paint_px). Ratios have four decimals, so the running total
    is over a bounded list of distinct values."""
    v = samples.filter("ratio is not null").groupBy(F.round("ratio", 4).alias("ratio")).agg(F.sum("paint_px").alias("w"), F.count(F.lit(1)).alias("n"))
    w = W.orderBy("ratio")
    d = v.withColumn("run", F.sum("w").over(w.rowsBetween(W.unboundedPreceding, 0)))
    total = v.agg(F.sum("w")).scalar()
    pairs = v.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return d.filter(F.col("run") >= total / 2).agg(F.min("ratio").alias("line_ratio")).withColumn("pairs", pairs)


def accumulate_groups(measured: DataFrame) -> DataFrame:
    """measured(part, pair_id, usable, pixels, mean, grain, local_contrast, patches, size_px): pixel-weighted totals per
    part, and which pairs they come from.

    pair_ids and skipped_ids list the pairs that were added and those that were not, in order. library_patches and
    library_sizes run along pair_ids: the patch libraries that a part can draw from. A pair without `usable` is skipped.
    A part without pixels is not usable.
    """
    u = F.coalesce(F.col("usable"), F.lit(False))
    on = lambda e: F.sum(F.when(u, e))
    # structs keep the pairs that have no id
    listed = lambda c, *cols: F.array_sort(F.collect_list(F.when(c, F.struct(*cols))))
    g = measured.groupBy("part").agg(
        on(F.col("pixels")).alias("pixels"), on(F.col("patches")).alias("patches"), on(F.col("mean") * F.col("pixels")).alias("t"),
        on(F.col("grain") * F.col("pixels")).alias("g"), on(F.col("local_contrast") * F.col("pixels")).alias("c"),
        F.count_if(u).alias("pairs"), F.count_if(~u).alias("skipped"), listed(u, "pair_id", "patches", "size_px").alias("_libs"), listed(~u, "pair_id").alias("_skipped"))
    n = F.nullif(F.col("pixels"), F.lit(0))
    return g.select("part", F.coalesce(n > 0, F.lit(False)).alias("usable"), "pixels", "patches", (F.col("t") / n).alias("tone"), (F.col("g") / n).alias("grain"),
                    (F.col("c") / n).alias("contrast"), "pairs", "skipped", F.col("_libs.pair_id").alias("pair_ids"), F.col("_skipped.pair_id").alias("skipped_ids"),
                    F.col("_libs.patches").alias("library_patches"), F.col("_libs.size_px").alias("library_sizes"))


def merge_shares(libs: DataFrame, cap: int | None = None) -> DataFrame:
    """libs(part, pair_id, pixels, patches, size_px): how many patches each pair gives (`kept`) to a merged library.

    Without a cap every pair gives all its patches. A cap is shared over all pairs of the part by pixels, with the
    largest remainders rounded up; a pair never gives more than it has.
    """
    tot = libs.groupBy("part").agg(F.sum("pixels").alias("_t"), F.percentile("size_px", F.lit(0.5)).cast("int").alias("common_size"))
    d = libs.join(tot, "part")
    if cap is None:
        return d.withColumn("kept", F.col("patches").cast("bigint")).drop("_t")
    share = F.col("pixels") * F.lit(cap).cast("bigint")
    d = d.withColumn("_base", F.expr(f"(pixels * {cap}L) div _t")).withColumn("_rest", share % F.col("_t"))
    given = d.groupBy("part").agg((F.lit(cap) - F.sum("_base")).alias("_spare"))
    d = range_rank(d, ["part"], [F.col("_rest").desc(), F.col("pair_id").asc()], "_pos").join(given, "part")
    kept = F.least(F.col("_base") + (F.col("_pos") <= F.col("_spare")).cast("bigint"), F.col("patches"))
    return d.withColumn("kept", kept.cast("bigint")).drop("_t", "_base", "_rest", "_pos", "_spare")


def _chosen(libs: DataFrame, cap: int | None) -> DataFrame:
    # pairs that give nothing need no order of their patches
    s = merge_shares(libs, cap).select("part", "pair_id", "patches", "size_px", "common_size", "kept").filter("patches > 0 and kept > 0")
    d = s.withColumn("patch", F.explode(F.sequence(F.lit(0), (F.col("patches") - 1).cast("int"))))
    if cap is None:
        return d
    d = d.withColumn("_h", mix(F.col("pair_id"), F.col("patch")))
    # one pair's patches are one library, a bounded group
    k = F.row_number().over(W.partitionBy("part", "pair_id").orderBy("_h", "patch"))
    return d.withColumn("_k", k).filter(F.col("_k") <= F.col("kept"))


def merge_libraries(libs: DataFrame, cap: int | None = None) -> DataFrame:
    """Chosen patches (part, pair_id, patch): a hashed sample without replacement of each pair's share."""
    return _chosen(libs, cap).select("part", "pair_id", "patch", "common_size")


def library_measures(patches: DataFrame, value: str) -> DataFrame:
    """patches(part, pair_id, patch, y, x, value) -> (part, pair_id, pixels, patches, size_px, mean, grain, local_contrast):
    grain is the deviation of all pixels of the pair, local contrast the mean deviation inside a patch."""
    v = F.col(value)
    one = patches.groupBy("part", "pair_id", "patch").agg(F.count(v).alias("_n"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"), F.stddev_pop(v).alias("_d"),
                                                          (F.max("y") + 1).alias("_side"))
    n, mean = F.sum("_n"), F.sum("_s") / F.sum("_n")
    return one.groupBy("part", "pair_id").agg(n.alias("pixels"), F.count(F.lit(1)).alias("patches"), F.max("_side").alias("size_px"), mean.alias("mean"),
                                              F.sqrt(F.greatest(F.sum("_q") / n - mean * mean, F.lit(0.0))).alias("grain"), F.avg("_d").alias("local_contrast"))


def merged_patches(libs: DataFrame, patches: DataFrame, fields: list[str], cap: int | None = None) -> DataFrame:
    """The merged library's pixels (part, pair_id, patch, size_px, y, x, *fields): chosen patches at the common size.

    patches(part, pair_id, patch, y, x, *fields), patch numbers from 0 in each pair. Pixels are shuffled once.
    """
    key = ["part", "pair_id", "patch"]
    d = patches.select(*key, "y", "x", *fields).join(_chosen(libs, cap).select(*key, F.col("size_px").alias("_side"), "common_size"), key)
    return resize_to(d.withColumn("size_px", F.col("common_size")), [*key, "size_px"], "_side", "common_size", fields)


def merged_statistics(libs: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per part: size_px, count, pairs, pixels, tone, grain, contrast, sizes_seen.

    libs(part, pair_id, pixels, patches, size_px, mean, grain, local_contrast). Tone, grain and contrast weigh every pair
    by its pixels; a measure that is missing counts as 0. Pairs without patches take no part.
    """
    n = F.greatest(F.sum("pixels"), F.lit(1))
    pooled = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)) * F.col("pixels")) / n
    g = merge_shares(libs.filter("patches > 0"), cap).groupBy("part").agg(
        F.first("common_size").alias("size_px"), F.sum("kept").alias("count"), F.count(F.lit(1)).alias("pairs"), F.sum("pixels").alias("pixels"),
        pooled("mean").alias("tone"), pooled("grain").alias("grain"), pooled("local_contrast").alias("contrast"),
        F.array_sort(F.collect_set("size_px")).alias("sizes_seen"))  # patch sides: a few dozen values
    return g.select("part", "size_px", "count", "pairs", "pixels", F.round("tone", 2).alias("tone"), F.round("grain", 3).alias("grain"),
                    F.round("contrast", 3).alias("contrast"), "sizes_seen")


def upgrade_routes(routes: DataFrame, measured: DataFrame) -> DataFrame:
    """routes(route_id, part, fallbacks, confidence, source, primed_id) with the measurement of their part."""
    m = measured.select("part", "usable", "pairs", F.col("tone").alias("_tone"), F.col("pixels").alias("_px"))
    d = routes.join(m, "part", "left")
    on = F.coalesce("usable", F.lit(False))
    plural = F.when(F.col("pairs") > 1, "s").otherwise("")
    primed = F.coalesce("primed_id", F.when(F.col("source").startswith("stage A"), F.concat("route_id", F.lit(".primed"))))
    falls = F.concat_ws(",", primed, F.array_join(F.filter(F.split("fallbacks", ","), lambda f: (f != "") & ~F.equal_null(f, primed)), ","))
    return d.select(
        "route_id", "part",
        F.when(on, F.round(F.least(F.lit(0.85), F.lit(0.6) + F.col("pairs") * 0.05), 2)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(on, F.concat(F.lit("stage B, "), F.col("pairs").cast("string"), F.lit(" pair"), plural)).otherwise(F.col("source")).alias("source"),
        F.when(on, F.regexp_replace(falls, ",$", "")).otherwise(F.col("fallbacks")).alias("fallbacks"),
        F.when(on, primed).otherwise(F.col("primed_id")).alias("primed_id"),
        F.when(on, F.concat(F.lit("from "), F.col("_px").cast("string"), F.lit(" pixels"))).otherwise(F.lit("left as primed")).alias("lesson"))
