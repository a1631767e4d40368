"""Raster statistics over pixel tables (image_id, y, x, value).

Work is grouped by (image, row) or (image, column), never by image alone, so one huge image is spread over its
lines; per-image results come from partial aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from roadframe.functions.scalars import gray601, mix, pick
from roadframe.operators.common import N4, N8, blur, label_regions, lines, materialize, stencil, weigh

IMG = "image_id"
PAINT = 128                  # brighter than this is paint, or road in a mask
MARK = 20                    # brighter than this is a mark in a noise image
ORIGINS_A_TASK = 1 << 18


def dims(px: DataFrame) -> DataFrame:
    return px.groupBy(IMG).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def to_gray(px: DataFrame, how: str = "luma") -> DataFrame:
    v = gray601("r", "g", "b") if how == "luma" else (F.col("r") + F.col("g") + F.col("b")) / 3.0
    return px.select(IMG, "y", "x", v.alias("v"))


# ---------------------------------------------------------------- neighbours and tone
def _next_rows(gray: DataFrame) -> DataFrame:
    """Raster rows as arrays, each with the following row (wrapping), so vertical neighbours share a record."""
    rows = lines(gray, [IMG, "y"], "x", ["v"]).select(IMG, "y", F.transform("a", lambda s: s["v"].cast("double")).alias("a"))
    h = rows.groupBy(IMG).agg(F.count(F.lit(1)).alias("h"))
    nxt = rows.select(IMG, F.col("y").alias("ny"), F.col("a").alias("b"))
    return rows.join(h, IMG).withColumn("ny", F.pmod(F.col("y") + 1, F.col("h")).cast("int")).join(nxt, [IMG, "ny"])


def local_contrast(gray: DataFrame) -> DataFrame:
    """Mean absolute difference to the eight neighbours, wrapping at the borders.

    Wrapping makes every pair count twice, so half of the directions are enough: right, and the three below.
    """
    r = _next_rows(gray).withColumn("n", F.size("a"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")

    def add(acc, i):
        at = lambda arr, k: F.get(arr, F.pmod(k, n))
        v = F.get(a, i)
        return (acc + F.abs(v - at(a, i + 1)) + F.abs(v - at(b, i - 1)) + F.abs(v - F.get(b, i)) + F.abs(v - at(b, i + 1)))

    r = r.withColumn("s", F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), add))
    return r.groupBy(IMG).agg((F.sum("s") * 2 / (F.sum("n") * 8)).alias("local_contrast"))


def tone_stats(gray: DataFrame, keys=(IMG,)) -> DataFrame:
    """Mean, population deviation and linear 5/95 percentiles. Values are 8-bit, so the exact percentile
    aggregate holds at most 256 counts per group."""
    return gray.groupBy(*keys).agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.percentile("v", F.lit(0.05)).alias("p5"), F.percentile("v", F.lit(0.95)).alias("p95"))


def gaussian_blur(px: DataFrame, sigma: float, fields=("v",), mode: str = "reflect") -> DataFrame:
    return blur(px, list(fields), sigma, mode)


def fine_detail(gray: DataFrame, sigma: float = 2.0) -> DataFrame:
    """v and v minus its blur, from the same tile, so nothing has to be joined back."""
    from roadframe.functions.kernels import gaussian_weights
    w = gaussian_weights(sigma)
    r = len(w) // 2

    def fine(a):
        v = a["v"]
        inner = v[r:v.shape[0] - r, r:v.shape[1] - r]
        return {"v": inner, "fine": inner - weigh(v, w)}

    return stencil(gray, ["v"], r, fine, ["v", "fine"])


def grain(gray: DataFrame) -> DataFrame:
    return fine_detail(gray).groupBy(IMG).agg(F.stddev_pop("fine").alias("grain"))


def grain_size(fine: DataFrame, max_lag: int = 11) -> DataFrame:
    """First horizontal lag whose autocorrelation drops under 0.2, else the last lag.

    Sums of products, heads and tails per row are enough to centre afterwards, so one pass does it.
    """
    rows = lines(fine, [IMG, "y"], "x", ["fine"]).select(IMG, F.transform("a", lambda s: s["fine"]).alias("a"))
    lag = F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag")
    r = rows.select(IMG, "a", F.size("a").alias("n"), lag).filter("lag < n")
    head, tail = F.slice("a", F.lit(1), F.col("n") - F.col("lag")), F.slice("a", F.col("lag") + 1, F.col("n") - F.col("lag"))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    per = r.select(IMG, "lag", total(F.zip_with(head, tail, lambda p, q: p * q)).alias("pq"), total(head).alias("p"),
                   total(tail).alias("q"), (F.col("n") - F.col("lag")).alias("m"))
    s = per.groupBy(IMG, "lag").agg(*[F.sum(c).alias(c) for c in ("pq", "p", "q", "m")])
    z = s.groupBy(IMG).agg(F.max(F.when(F.col("lag") == 0, F.col("p") / F.col("m"))).alias("mu"),
                           F.collect_list(F.struct("lag", "pq", "p", "q", "m")).alias("l"))
    z = z.withColumn("c", F.transform("l", lambda e: F.struct(
        e["lag"].alias("lag"), (e["pq"] - F.col("mu") * (e["p"] + e["q"]) + F.col("mu") * F.col("mu") * e["m"]).alias("c"))))
    c0 = F.element_at(F.filter("c", lambda e: e["lag"] == 0), 1)["c"]
    c0 = F.when(c0 == 0, F.lit(1.0)).otherwise(c0)
    first = F.array_min(F.transform(F.filter("c", lambda e: (e["lag"] > 0) & (e["c"] / c0 < 0.2)), lambda e: e["lag"]))
    return z.select(IMG, F.coalesce(first, F.lit(max_lag)).alias("grain_size_px"))


def structure_tensor(gray: DataFrame) -> DataFrame:
    """Anisotropy and direction of the gradient field.

    A symmetric kernel with mirrored borders keeps totals, so the summed blurred products are the plain sums.
    """
    b = blur(gray.select(IMG, "y", "x", F.col("v").cast("double").alias("v")), ["v"], 1.0)

    def grad(line, pos):
        w = W.partitionBy(IMG, line).orderBy(pos)
        lo, hi = F.lag("v").over(w), F.lead("v").over(w)
        return F.when(lo.isNull() & hi.isNull(), 0.0).when(lo.isNull(), hi - F.col("v")).when(
            hi.isNull(), F.col("v") - lo).otherwise((hi - lo) / 2)

    d = b.withColumn("gy", grad("x", "y")).withColumn("gx", grad("y", "x"))
    s = d.groupBy(IMG).agg(F.sum(F.col("gx") * F.col("gx")).alias("jxx"), F.sum(F.col("gy") * F.col("gy")).alias("jyy"),
                           F.sum(F.col("gx") * F.col("gy")).alias("jxy"))
    tr, det = F.col("jxx") + F.col("jyy"), F.col("jxx") * F.col("jyy") - F.col("jxy") * F.col("jxy")
    disc = F.sqrt(F.greatest(tr * tr / 4 - det, F.lit(0.0)))
    l1, l2 = tr / 2 + disc, tr / 2 - disc
    return s.select(IMG, F.when(l1 > 1e-9, (l1 - l2) / l1).otherwise(0.0).alias("anisotropy"),
                    F.pmod(F.degrees(F.atan2(F.col("jxy") * 2, F.col("jxx") - F.col("jyy")) * 0.5), F.lit(180.0)).alias("direction_deg"))


def surface_reading(grain_c: Column, size_c: Column) -> Column:
    return F.when(grain_c < 1.0, "flat colour, no grain").when(size_c <= 3, "fine even grain").otherwise("coarse grain")


# ---------------------------------------------------------------- repetition
def profiles(gray: DataFrame) -> DataFrame:
    """Column means (axis 'x') and row means (axis 'y')."""
    one = lambda axis: gray.groupBy(IMG, F.col(axis).alias("pos")).agg(F.avg("v").alias("p")).select(
        IMG, F.lit(axis).alias("axis"), "pos", "p")
    return one("x").unionByName(one("y"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _lag_sums(p: pd.Series, mu: pd.Series, lags: pd.Series) -> pd.Series:
    """Sums of products of a centred profile with itself, shifted by 0 .. lags - 1 and padded with zeros."""
    out = []
    for v, m, k in zip(p, mu, lags):
        c = np.asarray(v, float) - m
        size = 1 << (2 * len(c) - 1).bit_length()
        s = np.fft.irfft(np.abs(np.fft.rfft(c, size)) ** 2, size)[:k]
        whole = float(c @ c)
        out.append(np.round(s / whole, 10) * whole if whole > 0 else np.zeros(len(s)))
    return pd.Series(out)


def autocorrelation(prof: DataFrame, max_share: int = 3) -> DataFrame:
    """Zero-padded autocorrelation of each centred profile for lags up to a third of the shorter side, plus one.

    One transform per profile gives all its lags, n log n in the side of the image; only the lags go on. Sums are
    rounded to ten decimals of the sum at lag 0, so that equal lags stay equal.
    """
    p = prof.groupBy(IMG, "axis").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("p"),
        F.stddev_pop("p").alias("variation"), F.avg("p").alias("mu"))
    short = p.groupBy(IMG).agg(F.min(F.floor(F.size("p") / max_share)).cast("int").alias("max_period"))
    d = p.join(short, IMG).withColumn("n", F.size("p"))
    sums = _lag_sums("p", "mu", F.least(F.col("max_period"), F.col("n") - 1) + 1)
    d = d.select(IMG, "axis", "variation", "max_period", "n", F.posexplode(sums).alias("lag", "s"))
    w = W.partitionBy(IMG, "axis")
    zero = F.max(F.when(F.col("lag") == 0, F.col("s"))).over(w)
    return d.select(IMG, "axis", "lag", "variation", "max_period", "n",
                    (F.col("s") / F.when(zero == 0, 1.0).otherwise(zero)).alias("ac"))


def periodicity(ac: DataFrame) -> DataFrame:
    """Strongest prominent peak per axis, then the stronger axis (x on a tie)."""
    w = W.partitionBy(IMG, "axis").orderBy("lag")
    d = (ac.withColumn("prev", F.lag("ac").over(w)).withColumn("next", F.lead("ac").over(w))
           .withColumn("trough", F.min(F.when(F.col("lag") >= 3, F.col("ac"))).over(w.rowsBetween(W.unboundedPreceding, -1))))
    trough = F.when(F.col("lag") > 3, F.col("trough")).otherwise(F.col("ac"))
    peak = ((F.col("lag") >= 3) & (F.col("lag") < F.least("max_period", F.col("n") - 1)) & (F.col("ac") > F.col("prev"))
            & (F.col("ac") >= F.col("next")) & (F.col("ac") > 0.35) & (F.col("ac") - trough > 0.08)
            & (F.col("variation") >= 0.5))
    per = d.groupBy(IMG, "axis").agg(
        F.max_by("lag", F.when(peak, F.struct("ac", -F.col("lag")))).alias("period_px"),
        F.coalesce(F.max(F.when(peak, F.col("ac"))), F.lit(0.0)).alias("strength"), F.first("variation").alias("variation"))
    both = per.groupBy(IMG).agg(
        F.max(F.when(F.col("axis") == "x", F.col("period_px"))).alias("period_x"),
        F.max(F.when(F.col("axis") == "y", F.col("period_px"))).alias("period_y"),
        F.max_by("period_px", F.struct(F.round("strength", 3), F.col("axis") == "x")).alias("period_px"),
        F.max("strength").alias("strength"))
    return both.withColumn("repeats", F.col("period_px").isNotNull())


# ---------------------------------------------------------------- runs and dashes
def run_length(flags: DataFrame, keys: list[str], pos: str, flag: str) -> DataFrame:
    """Maximal runs of equal flags along an ordered line (keys must name one image line)."""
    w = W.partitionBy(*keys).orderBy(pos)
    start = F.when(F.coalesce(F.lag(flag).over(w) != F.col(flag), F.lit(True)), 1).otherwise(0)
    d = flags.withColumn("_s", start).withColumn("_r", F.sum("_s").over(w))
    return d.groupBy(*keys, F.col("_r").alias("run")).agg(
        F.min(pos).alias("start"), F.count(F.lit(1)).alias("len"), F.first(flag).alias("value")).withColumn(
        "run", F.col("run").cast("bigint"))


def dash_pattern(gray: DataFrame) -> DataFrame:
    """Dash and gap lengths read off the paint of each image.

    Paint is counted per row and per column at once; everything after looks at these counts, not at pixels.
    """
    at = F.explode(F.array(F.struct(F.lit(True).alias("vertical"), F.col("y").alias("pos")),
                           F.struct(F.lit(False).alias("vertical"), F.col("x").alias("pos")))).alias("_at")
    per = materialize(gray.select(IMG, (F.col("v") > PAINT).alias("paint"), at).groupBy(IMG, "_at.vertical", "_at.pos").agg(
        F.count_if("paint").alias("n")).withColumn("line", F.col("n") > 0))
    extent = lambda on: (F.max(F.when(on & F.col("line"), F.col("pos"))) - F.min(F.when(on & F.col("line"), F.col("pos"))))
    box = per.groupBy(IMG).agg(
        F.sum(F.when(F.col("vertical"), F.col("n"))).alias("paint_px"), extent(F.col("vertical")).alias("ey"), extent(~F.col("vertical")).alias("ex"))
    box = box.filter(F.col("paint_px") >= 20).withColumn("vertical", F.col("ey") >= F.col("ex")).select(IMG, "paint_px", "vertical")
    proj = per.join(box, [IMG, "vertical"]).select(IMG, "vertical", "pos", "n", "line")
    width = proj.filter("line").groupBy(IMG).agg(F.percentile("n", F.lit(0.5)).cast("int").alias("width_px"))
    runs = run_length(proj, [IMG, "vertical"], "pos", "line")
    ends = runs.groupBy(IMG).agg(F.max("run").alias("last"))
    r = runs.join(ends, IMG).groupBy(IMG, "vertical").agg(
        F.percentile(F.when(F.col("value"), F.col("len")), F.lit(0.5)).alias("dash"),
        F.percentile(F.when(~F.col("value") & (F.col("run") > 1) & (F.col("run") < F.col("last")), F.col("len")), F.lit(0.5)).alias("gap"),
        F.count_if("value").alias("dashes_measured"))
    out = box.select(IMG, "paint_px").join(r, IMG).join(width, IMG)
    found = F.col("dash").isNotNull() & F.col("gap").isNotNull()
    keep = lambda c: F.when(found, c)
    return out.select(IMG, found.alias("found"), keep(F.when(F.col("vertical"), "vertical").otherwise("horizontal")).alias("orientation"),
                      keep(F.col("dash")).alias("dash_px"), keep(F.col("gap")).alias("gap_px"),
                      keep(F.col("dash") + F.col("gap")).alias("cycle_px"), keep(F.col("width_px")).alias("width_px"),
                      keep(F.col("dash") / F.col("gap")).alias("ratio"), keep(F.col("dashes_measured")).alias("dashes_measured"))


# ---------------------------------------------------------------- patches
def integral(px: DataFrame, fields: list[str]) -> DataFrame:
    """Summed-area table of integer fields: value at (y, x) is the exact sum over all pixels up and left of it."""
    wx = W.partitionBy(IMG, "y").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    wy = W.partitionBy(IMG, "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    d = px.select(IMG, "y", "x", *[F.sum(F.col(f).cast("bigint")).over(wx).alias(f) for f in fields])
    return d.select(IMG, "y", "x", *[F.sum(f).over(wy).alias(f) for f in fields])


def window_sums(origins: DataFrame, sat: DataFrame, fields: list[str], size: str = "size") -> DataFrame:
    """Box sums for origins(image_id, oid.., y, x, size): four corner look-ups instead of size x size pixels."""
    corners = F.array(*[F.struct(F.lit(s).alias("s"), (F.col("y") + a * F.col(size) - 1).alias("cy"),
                                 (F.col("x") + b * F.col(size) - 1).alias("cx")) for s, a, b in ((1, 1, 1), (-1, 0, 1), (-1, 1, 0), (1, 0, 0))])
    rest = origins.columns
    ask = origins.withColumn("_c", F.explode(corners)).select(*rest, F.col("_c.s").alias("_s"), F.col("_c.cy").alias("_cy"), F.col("_c.cx").alias("_cx"))
    hit = ask.filter("_cy >= 0 and _cx >= 0").join(
        sat.select(IMG, F.col("y").alias("_cy"), F.col("x").alias("_cx"), *[F.col(f).alias(f"_f_{f}") for f in fields]), [IMG, "_cy", "_cx"])
    return hit.groupBy(*rest).agg(*[F.sum(F.col(f"_f_{f}") * F.col("_s")).alias(f"sum_{f}") for f in fields])


def patch_origins(sizes: DataFrame, count: int, tries: int = 40, seed: int = 7) -> DataFrame:
    """Hashed candidate origins for sizes(image_id, h, w, size): up to count*tries per image.

    Sizes are few and would come in one task, so they are dealt out before each becomes count*tries rows.
    """
    sizes = materialize(sizes)
    n = sizes.count() * count * tries // ORIGINS_A_TASK
    d = (sizes.repartition(n, IMG, "size") if n > 1 else sizes).withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(count * tries - 1))))
    a = mix(F.col(IMG), F.lit(seed))
    return d.select(IMG, "try", "size",
                    pick(a, F.col("try") * 2, F.greatest(F.lit(1), F.col("h") - F.col("size"))).cast("int").alias("y"),
                    pick(a, F.col("try") * 2 + 1, F.greatest(F.lit(1), F.col("w") - F.col("size"))).cast("int").alias("x"))


def patch_size(size: Column, h: Column, w: Column, avoid: Column | None = None) -> Column:
    """Requested size limited to half the image, stepped off a multiple of the source period."""
    s = F.least(size, F.floor(h / 2).cast("int"), F.floor(w / 2).cast("int"))
    s = F.when(s <= 0, 8).otherwise(s)
    if avoid is None:
        return s
    step = F.greatest(F.lit(8), s + F.greatest(F.lit(1), F.floor(avoid / 2).cast("int")))
    return F.when((avoid > 1) & (F.pmod(s, avoid) == 0), step).otherwise(s)


def patch_sample(origins: DataFrame, px: DataFrame, count: int, min_coverage: float = 0.6, max_exclude: float = 0.0,
                 extra: tuple = ()) -> DataFrame:
    """Keep the first `count` origins whose window is covered and clear of paint.

    px(image_id, y, x, inside 0/1, exclude 0/1, tone int = r+g+b, plus `extra`); adds window sums.
    """
    px = px.withColumn("tone2", F.col("tone").cast("bigint") * F.col("tone"))
    f = ["inside", "exclude", "tone", "tone2", *extra]
    s = window_sums(origins, integral(px, f), f)
    area = F.col("size") * F.col("size")
    covered = F.col("sum_inside") / area >= min_coverage
    clear = F.col("sum_exclude") / area <= max_exclude
    s = s.withColumn("ok", covered & clear).withColumn("painted", covered & ~clear)
    # tries per image are bounded by count * tries, so ordering them is a small window
    w = W.partitionBy(IMG, "size").orderBy("try").rowsBetween(W.unboundedPreceding, 0)
    s = s.withColumn("k", F.sum(F.col("ok").cast("int")).over(w))
    live = (F.col("k") < count) | (F.col("ok") & (F.col("k") == count))
    return s.filter(live)


def patch_stats(sampled: DataFrame) -> DataFrame:
    """Library statistics per (image, size) from window sums; tone is three times the mean of the bands."""
    area = F.col("size") * F.col("size")
    mean = F.col("sum_tone") / (area * 3.0)
    var = (F.col("sum_tone2") * area - F.col("sum_tone") * F.col("sum_tone")) / (area * area * 9.0)
    d = sampled.select(IMG, "size", "ok", "painted", F.when(F.col("ok"), mean).alias("m"), F.when(F.col("ok"), F.sqrt(var)).alias("s"))
    return d.groupBy(IMG, "size").agg(
        F.count_if("ok").alias("count"), F.avg("m").alias("patch_mean"), F.avg("s").alias("patch_std"),
        F.stddev_pop("m").alias("variation"), (F.count_if("ok") * 8).alias("placements"),
        F.count_if("painted").alias("rejected_for_paint"))


def orient(y: Column, x: Column, size: Column, k: Column, flip: Column) -> tuple[Column, Column]:
    """Where a patch pixel lands after k counter-clockwise quarter turns and an optional left-right flip."""
    last = size - 1
    ny = F.when(k == 0, y).when(k == 1, last - x).when(k == 2, last - y).otherwise(x)
    nx = F.when(k == 0, x).when(k == 1, y).when(k == 2, last - x).otherwise(last - y)
    return ny, F.when(flip == 1, last - nx).otherwise(nx)


def patch_orientations(patch: DataFrame, size: int) -> DataFrame:
    d = patch.withColumn("code", F.explode(F.sequence(F.lit(0), F.lit(7))))
    ny, nx = orient(F.col("y"), F.col("x"), F.lit(size), F.floor(F.col("code") / 2), F.col("code") % 2)
    return d.withColumn("_y", ny.cast("int")).withColumn("_x", nx.cast("int")).drop("y", "x").withColumnsRenamed({"_y": "y", "_x": "x"})


# ---------------------------------------------------------------- paint and noise
def paint_tone(px: DataFrame) -> DataFrame:
    d = px.withColumn("v", gray601("r", "g", "b"))
    p = F.col("v") > PAINT
    on = lambda c: F.when(p, F.col(c))
    return d.groupBy(IMG).agg(
        F.avg(on("v")).alias("mean"), F.stddev_pop(on("v")).alias("std"),
        F.percentile(on("v"), F.lit(0.05)).alias("p5"), F.percentile(on("v"), F.lit(0.95)).alias("p95"),
        (F.count_if(p) / F.count(F.lit(1))).alias("coverage"), F.avg(on("r")).alias("mean_r"),
        F.avg(on("g")).alias("mean_g"), F.avg(on("b")).alias("mean_b"))


def noise_features(gray: DataFrame) -> DataFrame:
    """Share, number, median size and thickness of the marks in a noise image."""
    from roadframe.operators.network import distance_transform
    d = gray.withColumn("strong", F.col("v") > MARK)
    total = d.groupBy(IMG).agg((F.count_if("strong") / F.count(F.lit(1))).alias("coverage"))
    areas = label_regions(d.filter("strong")).groupBy(IMG, "label").agg(F.count(F.lit(1)).alias("area"))
    marks = areas.groupBy(IMG).agg(F.count(F.lit(1)).alias("features"), F.percentile("area", F.lit(0.5)).alias("median_area"))
    dt = distance_transform(d.select(IMG, "y", "x", F.col("strong").alias("inside")))
    thick = dt.filter("inside").groupBy(IMG).agg((F.avg("dist") * 2).alias("thickness_px"))
    return total.join(marks, IMG, "left").join(thick, IMG, "left").select(
        IMG, "coverage", F.coalesce("features", F.lit(0)).alias("features"),
        F.coalesce("median_area", F.lit(0.0)).alias("median_area"), F.coalesce("thickness_px", F.lit(0.0)).alias("thickness_px"))


def isolate_noise(clean: DataFrame, noisy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(difference pixels, images refused because their sizes differ or one side is missing)."""
    a, b = dims(clean), dims(noisy).withColumnsRenamed({"h": "h2", "w": "w2"})
    bad = a.join(b, IMG, "full").filter("NOT (h <=> h2 AND w <=> w2)").select(IMG, "h", "w", "h2", "w2")
    tot = lambda d, n: d.select(IMG, "y", "x", (F.col("r") + F.col("g") + F.col("b")).alias(n))
    diff = tot(clean, "ta").join(tot(noisy, "tb"), [IMG, "y", "x"]).join(bad.select(IMG), IMG, "left_anti").select(
        IMG, "y", "x", F.least(F.lit(255), F.abs(F.col("ta") - F.col("tb"))).alias("v"))
    return diff, bad


def noise_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy(IMG).agg(F.avg("v").alias("mean"), F.max("v").alias("max"),
                                 (F.count_if(F.col("v") > MARK) / F.count(F.lit(1))).alias("covered"))


def road_pixels(mask: DataFrame) -> DataFrame:
    return mask.groupBy(IMG).agg(F.count_if(F.col("v") > PAINT).alias("road_px"))


# fixed values: the leaves of the three starting trees (tree, path, route, fallbacks)
PRIME_LEAVES = [
    ("material", "yes", "material.junction", "material.open"),
    ("material", "no/under 1.5 m", "material.edge", "material.open"),
    ("material", "no/1.5 m or more", "material.open", ""),
    ("noise", "yes", "noise.junction", "noise.open"),
    ("noise", "no", "noise.open", "noise.junction"),
    ("lines", "yes/yes", "lines.junction_clear", ""),
    ("lines", "yes/no", "lines.dash", ""),
    ("lines", "no", "lines.none", ""),
]


def prime_trees(measured: DataFrame) -> DataFrame:
    """Leaf rows of the three starting trees for measured(image_id, tone, grain, coverage, thickness, cycle_px)."""
    t = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("tree", "path", "route_id", "fallbacks"))]) for r in PRIME_LEAVES])
    d = measured.withColumn("_t", F.explode(t)).select(IMG, "tone", "grain", "coverage", "thickness", "cycle_px", "_t.*")
    on = lambda tree, c, ids: F.when(F.col("route_id").isin(ids), F.col(c))
    return d.select(IMG, "tree", "path", "route_id", "fallbacks", F.lit(0.5).alias("confidence"),
                    on("material", "tone", ["material.open"]).alias("tone"), on("material", "grain", ["material.open"]).alias("grain"),
                    on("noise", "coverage", ["noise.junction", "noise.open"]).alias("coverage"),
                    on("noise", "thickness", ["noise.open"]).alias("thickness"), on("lines", "cycle_px", ["lines.dash"]).alias("cycle_px"))
