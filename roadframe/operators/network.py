"""Road masks to junctions, arms and streets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from roadframe.operators.common import (N8, connected_components, label_regions, lines, materialize, pixel_code,
                                        scatter_offsets, tile_halo)
from roadframe.operators.discs import disc_components

IMG = "image_id"
FAR = 1 << 20                    # image sides are limited to this many pixels


# ---------------------------------------------------------------- distances
def nearest_target(px: DataFrame, target: str, keep: tuple = ()) -> DataFrame:
    """For every pixel the squared distance to the nearest target pixel and where it is (ties: smallest y, then x).

    Two passes, exact: along each column the nearest target above and below by running windows, then along each
    row the lower envelope of the parabolas that the columns' distances span, linear in the row's length. Pixels of an image without any target get null.
    """
    hit = F.when(F.col(target), F.col("y"))
    up = W.partitionBy(IMG, "x").orderBy("y").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(IMG, "x").orderBy(F.desc("y")).rowsBetween(W.unboundedPreceding, 0)
    d = px.select(IMG, "y", "x", *keep, F.max(hit).over(up).alias("_u"), F.min(hit).over(down).alias("_d"))
    du, dd = F.coalesce(F.col("y") - F.col("_u"), F.lit(FAR)), F.coalesce(F.col("_d") - F.col("y"), F.lit(FAR))
    d = d.select(IMG, "y", "x", *keep, F.least(du, dd).alias("_g"), F.when(du <= dd, F.col("_u")).otherwise(F.col("_d")).alias("_ty"))
    row = lines(d, [IMG, "y"], "x", ["_g", "_ty", *keep]).select(
        IMG, "y", "a", F.transform("a", lambda s: s["_g"]).alias("g"), F.transform("a", lambda s: s["_ty"]).alias("ty"))
    out = row.select(IMG, "y", "a", _row_search("g", "ty").alias("b")).select(
        IMG, "y", F.posexplode(F.arrays_zip("a", "b.d2", "b.ty", "b.tx")).alias("x", "e"))
    known = F.col("e.d2") >= 0
    return out.select(IMG, "y", "x", *[F.col("e.a").getField(k).alias(k) for k in keep],
                      *[F.when(known, F.col(f"e.{c}")).alias(c) for c in ("d2", "ty", "tx")])


@F.pandas_udf(T.StructType([T.StructField("d2", T.ArrayType(T.LongType())), T.StructField("ty", T.ArrayType(T.IntegerType())),
                            T.StructField("tx", T.ArrayType(T.IntegerType()))]))
def _row_search(g: pd.Series, ty: pd.Series) -> pd.DataFrame:
    """Minimum over a row of column distance squared plus offset squared, rows of equal length together."""
    d2, oy, ox = [None] * len(g), [None] * len(g), [None] * len(g)
    length = g.map(len).to_numpy()
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        for part in np.array_split(rows, max(1, int(len(rows) * n // 2_000_000))):
            gg = np.stack([np.asarray(g.iat[i], np.int64) for i in part])
            has = gg < FAR
            yy = np.where(has, np.nan_to_num(np.stack([np.asarray(ty.iat[i], float) for i in part]), nan=0.0), 0).astype(np.int64)
            if n > FAR or yy.max(initial=0) >= FAR:
                raise ValueError(f"image sides are limited to {FAR} pixels")
            col = lower_envelope(gg, yy, has)
            found = has.any(axis=1)
            near = np.take_along_axis(gg, col, axis=1) ** 2 + (np.arange(n) - col) ** 2
            row = np.take_along_axis(yy, col, axis=1)
            for r, i in enumerate(part):
                d2[i] = near[r] if found[r] else np.full(n, -1)
                oy[i] = row[r].astype(np.int32)
                ox[i] = col[r].astype(np.int32)
    return pd.DataFrame({"d2": d2, "ty": oy, "tx": ox})


def lower_envelope(g: np.ndarray, ty: np.ndarray, has: np.ndarray) -> np.ndarray:
    """For every x of every row the column j that minimises (g_j^2 + (x - j)^2, ty_j, j), over columns that have a target.

    All columns are parabolas of one curvature, the target row a fraction of their offset, so two of them change order
    once, at a whole number. One sweep keeps the columns that are best somewhere and the first x of each: linear in the
    row length, all rows of a batch side by side.
    """
    many, n = g.shape
    offset = g * g * FAR + ty
    every = np.arange(many)
    kept, first = np.zeros((many, n), np.int64), np.zeros((many, n), np.int64)
    top = np.full(many, -1)

    def overtakes(r, j, k):
        """First x from which column k is better than column j < k."""
        return (offset[r, k] - offset[r, j] + FAR * (k * k - j * j)) // (2 * FAR * (k - j)) + 1

    for k in range(n):
        r = every[has[:, k]]
        if not len(r):
            continue
        x, look = np.full(len(r), -(1 << 40)), np.flatnonzero(top[r] >= 0)
        while len(look):
            rows = r[look]
            x[look] = overtakes(rows, kept[rows, top[rows]], k)
            beaten = x[look] <= first[rows, top[rows]]
            look, gone = look[beaten], rows[beaten]
            top[gone] -= 1
            x[look[top[gone] < 0]] = -(1 << 40)
            look = look[top[gone] >= 0]
        top[r] += 1
        kept[r, top[r]], first[r, top[r]] = k, x
    at = np.zeros((many, n), np.int64)
    r, c = np.nonzero((np.arange(n) <= top[:, None]) & (first < n))
    np.maximum.at(at, (r, np.maximum(first[r, c], 0)), c)
    return np.take_along_axis(kept, np.maximum.accumulate(at, axis=1), axis=1)


def distance_transform(px: DataFrame, keep: tuple = ()) -> DataFrame:
    """px(image_id, y, x, inside): exact Euclidean distance of inside pixels to the nearest outside pixel, else 0."""
    d = nearest_target(px.withColumn("_out", ~F.col("inside")), "_out", ("inside", *keep))
    return d.select(IMG, "y", "x", *keep, "inside", F.sqrt(F.col("d2").cast("double")).alias("dist"))


def label_components(px: DataFrame, eight: bool = False) -> DataFrame:
    return label_regions(px, eight)


# ---------------------------------------------------------------- cleaning
def clean_mask(mask: DataFrame, divider_limit: float = 6.0, road_over: int = 128) -> tuple[DataFrame, DataFrame]:
    """(clean road pixels (image_id, y, x, road), one row of counts per image).

    Background regions that are tiny specks or thin dividers become road; road regions under 60 px are dropped.
    """
    px = mask.select(IMG, "y", "x", (F.col("v") > road_over).alias("road"))
    gap = materialize(distance_transform(px.select(IMG, "y", "x", (~F.col("road")).alias("inside"))).filter("inside"))
    lab = label_regions(gap)
    hole = materialize(gap.join(lab, [IMG, "y", "x"]).select(IMG, "y", "x", "label", "dist"))
    region = hole.groupBy(IMG, "label").agg((F.max("dist") * 2).alias("gap"), F.count(F.lit(1)).alias("area"))
    speck = (F.col("gap") <= 3.0) & (F.col("area") < 40)
    merge = (F.col("gap") <= divider_limit) & (F.col("area") >= 40)
    left = (F.col("area") >= 40) & (F.col("gap") / 2 <= 12)
    region = region.withColumn("what", F.when(speck, "speck").when(merge, "divider").when(left, "left"))
    counts = region.groupBy(IMG).agg(F.count_if(F.col("what") == "speck").alias("specks_filled"),
                                     F.count_if(F.col("what") == "divider").alias("dividers_merged"),
                                     F.count_if(F.col("what") == "left").alias("gaps_left_split"))
    filled = hole.join(region.filter(F.col("what").isin("speck", "divider")).select(IMG, "label"), [IMG, "label"], "left_semi")
    on = px.filter("road").select(IMG, "y", "x").unionByName(filled.select(IMG, "y", "x"))
    road = materialize(label_regions(on))
    big = road.groupBy(IMG, "label").agg(F.count(F.lit(1)).alias("n")).filter("n >= 60").select(IMG, "label")
    keep = road.join(big, [IMG, "label"], "left_semi").select(IMG, "y", "x", F.lit(True).alias("road"))
    out = px.select(IMG, "y", "x").join(keep, [IMG, "y", "x"], "left").select(
        IMG, "y", "x", F.coalesce("road", F.lit(False)).alias("road"))
    images = px.select(IMG).distinct()
    return out, images.join(counts, IMG, "left").na.fill(0)


# ---------------------------------------------------------------- thinning
def _thin(a: np.ndarray, rounds: int) -> tuple[np.ndarray, bool]:
    """Up to `rounds` Zhang-Suen rounds on a tile with a clear rim; also tells whether it may go on."""
    a = a.copy()
    for _ in range(rounds):
        removed = False
        for second in (False, True):
            n, s, w, e = a[:-2, 1:-1], a[2:, 1:-1], a[1:-1, :-2], a[1:-1, 2:]
            ring = [n, a[:-2, 2:], e, a[2:, 2:], s, a[2:, :-2], w, a[:-2, :-2]]
            near = sum(p.astype(np.int8) for p in ring)
            rise = sum((~p & q).astype(np.int8) for p, q in zip(ring, ring[1:] + ring[:1]))
            blocked = (n & e & w) | (n & s & w) if second else (n & e & s) | (e & s & w)
            gone = a[1:-1, 1:-1] & (near >= 2) & (near <= 6) & (rise == 1) & ~blocked
            if gone.any():
                removed = True
                a[1:-1, 1:-1] &= ~gone
        if not removed:
            return a, False
    return a, True


def skeleton(px: DataFrame, tile: int = 256, rounds: int = 16) -> DataFrame:
    """One-pixel centrelines of sparse road pixels by Zhang-Suen thinning; all images advance together.

    A pixel's fate in one round depends on pixels at most two away, so a tile with a halo of twice the rounds can
    take that many rounds on its own. The job repeats only while some tile has not come to rest.
    """
    halo = 2 * rounds
    key = px.schema[IMG]
    schema = T.StructType([key, T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("more", T.BooleanType())])

    def run(pdf):
        ty, tx = int(pdf["_ty"].iat[0]), int(pdf["_tx"].iat[0])
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        y0, x0 = y.min() - 1, x.min() - 1
        a = np.zeros((y.max() - y0 + 2, x.max() - x0 + 2), bool)
        a[y - y0, x - x0] = True
        a, more = _thin(a, rounds)
        yy, xx = np.nonzero(a)
        yy, xx = yy + y0, xx + x0
        core = (yy // tile == ty) & (xx // tile == tx)
        return pd.DataFrame({IMG: pdf[IMG].iat[0], "y": yy[core].astype(np.int32), "x": xx[core].astype(np.int32), "more": more})

    cur = px.select(IMG, "y", "x")
    while True:
        cur = materialize(tile_halo(cur, halo, tile).groupBy(IMG, "_ty", "_tx").applyInPandas(run, schema))
        again = not cur.filter("more").isEmpty()
        cur = cur.select(IMG, "y", "x")
        if not again:
            return cur


def skeleton_degree(sk: DataFrame) -> DataFrame:
    """Eight-neighbour count of every skeleton pixel."""
    near = scatter_offsets(sk.select(IMG, "y", "x"), N8).groupBy(IMG, "y", "x").agg(F.count(F.lit(1)).cast("int").alias("deg"))
    return sk.select(IMG, "y", "x").join(near, [IMG, "y", "x"], "left").select(IMG, "y", "x", F.coalesce("deg", F.lit(0)).alias("deg"))


def prune_spurs(sk: DataFrame, dt: DataFrame, dims: DataFrame, rounds: int = 4,
                longest: int = 80) -> tuple[DataFrame, DataFrame]:
    """Remove short dead ends that reach a branch pixel; dead ends near the image border are roads leaving it.

    A spur is a region of non-branch pixels that holds an end point, so the walk along it is a region label. Part of
    the rule, not limits on the work: at most `rounds` passes (a pass can lay bare new dead ends), and a dead end of
    more than `longest` pixels is a road however wide its junction.
    """
    cur, dropped = materialize(sk.select(IMG, "y", "x")), None
    d = dt.select(IMG, "y", "x", "dist")
    for _ in range(rounds):
        deg = materialize(skeleton_degree(cur).join(d, [IMG, "y", "x"], "left"))
        thin = deg.filter("deg <= 2")
        lab = materialize(label_regions(thin, eight=True).join(deg, [IMG, "y", "x"]))
        margin = F.greatest(F.lit(6), F.floor(F.col("dist") * 2).cast("int"))
        inner = ((F.col("y") >= margin) & (F.col("x") >= margin) & (F.col("y") < F.col("h") - margin) & (F.col("x") < F.col("w") - margin))
        ends = lab.filter("deg = 1").join(dims, IMG).filter(inner).select(IMG, "label").distinct()
        branch = scatter_offsets(deg.filter("deg >= 3").select(IMG, "y", "x", F.col("dist").alias("bd")), N8)
        size = lab.groupBy(IMG, "label").agg(F.count(F.lit(1)).alias("len"))
        meet = lab.select(IMG, "y", "x", "label").join(branch, [IMG, "y", "x"]).groupBy(IMG, "label").agg(F.max("bd").alias("bd"))
        spur = size.join(ends, [IMG, "label"], "left_semi").join(meet, [IMG, "label"]).filter(
            (F.col("len") < F.greatest(F.lit(4.0), F.col("bd") * 2.5)) & (F.col("len") <= longest))
        gone = materialize(lab.join(spur.select(IMG, "label"), [IMG, "label"], "left_semi").select(IMG, "y", "x", "label"))
        if gone.isEmpty():
            break
        n = gone.groupBy(IMG).agg(F.count_distinct("label").alias("pruned"))
        dropped = n if dropped is None else dropped.unionByName(n)
        cur = materialize(cur.join(gone.select(IMG, "y", "x"), [IMG, "y", "x"], "left_anti"))
    counts = dims.select(IMG)
    counts = (counts.withColumn("pruned", F.lit(0).cast("bigint")) if dropped is None else
              counts.join(dropped.groupBy(IMG).agg(F.sum("pruned").alias("pruned")), IMG, "left").na.fill(0))
    return skeleton(cur), counts


# ---------------------------------------------------------------- junctions
def junction_candidates(deg: DataFrame, dt: DataFrame, reach: int = 6) -> DataFrame:
    """Clusters of branch pixels: centre and the largest half width in a box around it."""
    plus = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
    grown = scatter_offsets(deg.filter("deg >= 3").select(IMG, "y", "x"), plus).distinct()
    spots = label_regions(grown.join(deg.select(IMG, "y", "x"), [IMG, "y", "x"], "left_semi"))
    c = materialize(spots.groupBy(IMG, F.col("label").alias("cand_id")).agg(F.avg("y").alias("y"), F.avg("x").alias("x")))
    side = F.sequence(F.lit(-reach), F.lit(reach))
    box = (c.withColumn("dy", F.explode(side)).withColumn("dx", F.explode(side))
            .select(IMG, "cand_id", (F.floor("y").cast("int") + F.col("dy")).alias("by"), (F.floor("x").cast("int") + F.col("dx")).alias("bx")))
    near = box.join(dt.filter("dist > 0").select(IMG, F.col("y").alias("by"), F.col("x").alias("bx"), "dist"), [IMG, "by", "bx"])
    hw = near.groupBy(IMG, "cand_id").agg(F.max("dist").alias("hw"))
    return c.join(hw, [IMG, "cand_id"], "left").select(IMG, "cand_id", "y", "x", F.coalesce("hw", F.lit(0.0)).alias("hw"))


def merge_candidates(cands: DataFrame, factor: float = 1.6) -> DataFrame:
    """Join candidates closer than factor * (sum of half widths), transitively: adds `root`, the smallest id.

    Candidates at the same spot are one point with the widest half width, so repeated points add no pairs.
    """
    spot = cands.groupBy(IMG, "x", "y").agg(F.min("cand_id").alias("pid"), F.max("hw").alias("r"))
    root = spot.join(disc_components(spot, factor), [IMG, "pid"], "left").select(IMG, "x", "y", F.coalesce("label", "pid").alias("root"))
    return cands.join(root, [IMG, "x", "y"]).select(IMG, "cand_id", "x", "y", "hw", "root")


def junction_summary(merged: DataFrame) -> DataFrame:
    centre = merged.groupBy(IMG, "root").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.max("hw").alias("hw"),
                                             F.count(F.lit(1)).alias("n_cand"))
    spread = merged.select(IMG, "root", "x", "y").join(centre, [IMG, "root"]).groupBy(IMG, "root").agg(
        F.max(F.hypot(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))).alias("spread"))
    return centre.join(spread, [IMG, "root"]).withColumn("r", F.greatest(F.lit(6.0), F.col("hw") * 2 + F.col("spread")))


def in_discs(px: DataFrame, discs: DataFrame, extra: float = 0.0, cell: int = 32) -> DataFrame:
    """Pixels within r + extra of a disc (image_id, root, cy, cx, r): px columns, root and squared distance.

    Discs are listed in the grid cells they touch; a pixel looks only at its own cell.
    """
    r = F.col("r") + extra
    span = lambda c: F.sequence(F.floor((c - r) / cell).cast("int"), F.floor((c + r) / cell).cast("int"))
    d = discs.select(IMG, "root", "cy", "cx", r.alias("_r"), F.explode(span(F.col("cy"))).alias("_gy"), span(F.col("cx")).alias("_sx")).withColumn(
        "_gx", F.explode("_sx")).drop("_sx")
    p = px.withColumn("_gy", F.floor(F.col("y") / cell).cast("int")).withColumn("_gx", F.floor(F.col("x") / cell).cast("int"))
    d2 = F.pow(F.col("y") - F.col("cy"), F.lit(2)) + F.pow(F.col("x") - F.col("cx"), F.lit(2))
    return p.join(d, [IMG, "_gy", "_gx"]).withColumn("d2", d2).filter(F.col("d2") <= F.col("_r") * F.col("_r")).drop("_gy", "_gx", "_r")


def street_segments(sk: DataFrame, js: DataFrame) -> DataFrame:
    """Skeleton outside every junction disc, labelled eight-connected."""
    inside = in_discs(sk.select(IMG, "y", "x"), js).select(IMG, "y", "x").distinct()
    return label_regions(sk.select(IMG, "y", "x").join(inside, [IMG, "y", "x"], "left_anti"), eight=True)


def segments_off_image(seg: DataFrame, dims: DataFrame, margin: int = 3) -> DataFrame:
    b = seg.groupBy(IMG, "label").agg(F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"),
                                      F.count(F.lit(1)).alias("pixels"))
    off = (F.col("y0") < margin) | (F.col("x0") < margin) | (F.col("y1") >= F.col("h") - margin) | (F.col("x1") >= F.col("w") - margin)
    return b.join(dims, IMG).select(IMG, "label", "pixels", off.alias("off_image"))


def compass(dy: Column, dx: Column) -> Column:
    """Angle in degrees, counter-clockwise from the x axis with y pointing down, to one decimal."""
    return F.round(F.pmod(F.degrees(F.atan2(-dy, dx)), F.lit(360.0)), 1)


def junction_arms(js: DataFrame, seg: DataFrame, dt: DataFrame) -> DataFrame:
    """Arms per (junction, segment touching its ring): angle of the mean near point and width."""
    d = seg.join(dt.select(IMG, "y", "x", "dist"), [IMG, "y", "x"])
    ring = in_discs(seg, js, 2.5).select(IMG, "root", "label").distinct()
    js2 = js.withColumn("r0", F.col("r")).withColumn("far", F.greatest(F.lit(12.0), F.col("hw") * 4)).select(
        IMG, "root", "cy", "cx", "r0", "far", (F.col("r") + F.col("far")).alias("r"))
    near = in_discs(d, js2).join(ring, [IMG, "root", "label"], "left_semi").join(js2.select(IMG, "root", "r0"), [IMG, "root"])
    dist = F.sqrt("d2")
    main, alt = dist >= F.col("r0"), dist <= F.col("r0") + 12
    pick = lambda c: (F.avg(F.when(main, F.col(c))), F.avg(F.when(alt, F.col(c))))
    med = lambda cond: F.percentile(F.when(cond, F.col("dist")), F.lit(0.5))
    a = near.groupBy(IMG, "root", "label", "cy", "cx").agg(
        F.count_if(main).alias("n"), *[e.alias(f"{c}{i}") for c in ("y", "x") for i, e in enumerate(pick(c))],
        med(main).alias("w0"), med(alt).alias("w1"))
    use = F.col("n") >= 3
    my, mx = F.when(use, F.col("y0")).otherwise(F.col("y1")), F.when(use, F.col("x0")).otherwise(F.col("x1"))
    return a.select(IMG, "root", F.col("label").alias("segment"), compass(my - F.col("cy"), mx - F.col("cx")).alias("angle"),
                    F.round(F.when(use, F.col("w0")).otherwise(F.col("w1")) * 2, 1).alias("width_px"), F.lit(False).alias("off_image"))


def circular_gap(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def border_arms(js: DataFrame, road: DataFrame, dims: DataFrame, arms: DataFrame, reach: float = 8.0, apart: float = 25.0) -> DataFrame:
    """Arms that leave the image inside a junction disc: clusters of border road not within 25 degrees of an arm."""
    rim = road.filter("road").join(dims, IMG).filter("y = 0 or x = 0 or y = h - 1 or x = w - 1").select(IMG, "y", "x")
    hit = in_discs(rim, js, reach)
    # clusters are found per junction: the junction becomes part of the image key
    tagged = hit.select(F.struct(IMG, "root").alias("k"), "y", "x", "cy", "cx")
    ids = tagged.select("k").distinct().select("k", F.xxhash64("k.image_id", "k.root").alias("h"))
    t = materialize(tagged.join(ids, "k").select(F.col("h").alias(IMG), F.col("k.image_id").alias("img"), F.col("k.root").alias("root"), "y", "x", "cy", "cx"))
    lab = label_regions(t, eight=True)
    c = t.join(lab, [IMG, "y", "x"]).groupBy("img", "root", "label").agg(
        F.avg("y").alias("my"), F.avg("x").alias("mx"), F.first("cy").alias("cy"), F.first("cx").alias("cx"), F.count(F.lit(1)).alias("n"))
    c = c.select(F.col("img").alias(IMG), "root", "label", compass(F.col("my") - F.col("cy"), F.col("mx") - F.col("cx")).alias("angle"),
                 F.col("n").cast("double").alias("width_px"))
    other = arms.select(IMG, "root", F.col("angle").alias("_a"))
    taken = c.join(other, [IMG, "root"]).filter(circular_gap(F.col("angle"), F.col("_a")) <= apart).select(IMG, "root", "label").distinct()
    free = c.join(taken, [IMG, "root", "label"], "left_anti")
    # a later cluster gives way to an accepted earlier one; the rim inside one disc has a handful of clusters
    one = free.groupBy(IMG, "root").agg(F.sort_array(F.collect_list(F.struct("label", "angle", "width_px"))).alias("all"))
    accept = F.aggregate("all", F.slice("all", 1, 0), lambda kept, c: F.when(
        F.forall(kept, lambda k: circular_gap(c["angle"], k["angle"]) > apart), F.concat(kept, F.array(c))).otherwise(kept))
    return one.select(IMG, "root", F.inline(accept)).select(
        IMG, "root", F.lit(None).cast("bigint").alias("segment"), "angle", "width_px", F.lit(True).alias("off_image"))


def arm_gaps(arms: DataFrame) -> DataFrame:
    """Circular difference to the next arm; a junction has a handful of arms."""
    w = W.partitionBy(IMG, "root").orderBy("angle", F.coalesce("segment", F.lit(-1)))
    nxt = F.coalesce(F.lead("angle").over(w), F.first("angle").over(w))
    return arms.withColumn("gap", F.round(F.pmod(nxt - F.col("angle"), F.lit(360.0)), 1))


def junction_type(js: DataFrame, gaps: DataFrame) -> DataFrame:
    a = gaps.groupBy(IMG, "root").agg(F.count(F.lit(1)).alias("k"), F.collect_list("angle").alias("angles"), F.collect_list("gap").alias("gaps"))
    d = js.join(a, [IMG, "root"], "left").withColumn("k", F.coalesce("k", F.lit(0)))
    straight = F.exists("angles", lambda p: F.exists("angles", lambda q: (p != q) & (F.abs(F.pmod(p - q, F.lit(360.0)) - 180.0) <= 20.0)))
    square = F.forall("gaps", lambda g: F.abs(g - 90.0) <= 20.0)
    k = F.col("k")
    kind = (F.when((F.col("n_cand") >= 5) | (k >= 7), "interchange (flagged)").when(k <= 2, "not a junction")
            .when(k == 3, F.when(straight, "T-junction").otherwise("Y / skewed"))
            .when(k == 4, F.when(square, "crossroads").otherwise("skewed crossroads")).otherwise("complex"))
    return d.withColumn("type", kind).drop("angles", "gaps")


def mouth_lines(arms: DataFrame, js: DataFrame) -> DataFrame:
    d = arms.join(js.select(IMG, "root", "cy", "cx", "r"), [IMG, "root"])
    t = F.radians("angle")
    ex, ey = F.col("cx") + F.cos(t) * F.col("r"), F.col("cy") - F.sin(t) * F.col("r")
    half = F.greatest(F.lit(3.0), F.col("width_px") * 0.7)
    px, py = -F.sin(t), -F.cos(t)
    return d.select(IMG, "root", "angle", (ex - px * half).alias("x0"), (ey - py * half).alias("y0"), (ex + px * half).alias("x1"), (ey + py * half).alias("y1"))


def network_summary(road: DataFrame, sk: DataFrame, dt: DataFrame, js: DataFrame, seg: DataFrame) -> DataFrame:
    r = road.groupBy(IMG).agg(F.count_if("road").alias("road_px"))
    wd = sk.select(IMG, "y", "x").join(dt.select(IMG, "y", "x", "dist"), [IMG, "y", "x"]).groupBy(IMG).agg(
        (F.percentile("dist", F.lit(0.5)) * 2).alias("width_median"), (F.max("dist") * 2).alias("width_max"))
    kinds = js.filter("type <> 'not a junction'").groupBy(IMG, "type").agg(F.count(F.lit(1)).alias("n"))
    by = kinds.groupBy(IMG).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "n"))), lambda s: F.concat(
        s["type"], F.lit("="), s["n"].cast("string"))), ";").alias("by_type"), F.sum("n").alias("junctions"))
    s = seg.groupBy(IMG).agg(F.count_distinct("label").alias("segments"))
    return r.join(wd, IMG, "left").join(by, IMG, "left").join(s, IMG, "left").na.fill(0, ["junctions", "segments"]).na.fill(
        0.0, ["width_median", "width_max"]).na.fill("", ["by_type"])


def detect(mask: DataFrame, divider_limit: float = 6.0) -> dict[str, DataFrame]:
    """The whole chain from a mask table to junctions, arms and street segments."""
    road, counts = clean_mask(mask, divider_limit)
    road = materialize(road)
    dims = materialize(road.groupBy(IMG).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")))
    dt = materialize(distance_transform(road.select(IMG, "y", "x", F.col("road").alias("inside"))).filter("inside"))
    sk = skeleton(road.filter("road").select(IMG, "y", "x"))
    sk, pruned = prune_spurs(sk, dt, dims)
    sk = materialize(sk)
    deg = skeleton_degree(sk)
    js = materialize(junction_summary(merge_candidates(junction_candidates(deg, dt))))
    seg = materialize(street_segments(sk, js))
    arms = materialize(junction_arms(js, seg, dt))
    arms = materialize(arms.unionByName(border_arms(js, road, dims, arms)))
    typed = junction_type(js, arm_gaps(arms))
    return {"road": road, "dims": dims, "dt": dt, "skeleton": sk, "junctions": typed, "segments": seg, "arms": arms,
            "counts": counts.join(pruned, IMG)}
