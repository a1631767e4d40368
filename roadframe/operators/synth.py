"""Raster synthesis from patch libraries, for many images at once, and seamless tiles with their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from roadframe.functions.kernels import gaussian_weights
from roadframe.functions.scalars import clip, gray601, mix, pick
from roadframe.operators import network as N, raster as A
from roadframe.operators.common import exact_quantiles, let, lines, materialize, stencil, weigh

IMG = "image_id"
# fixed values: overlap and jitter per quality step
QUALITY = {1: (0.25, 1.0), 2: (0.45, 0.6), 3: (0.6, 0.35)}
BACKGROUND = {"r": 18.0, "g": 18.0, "b": 20.0}
PAINT_RGB = {"r": 235.0, "g": 232.0, "b": 222.0}


# ---------------------------------------------------------------- laying patches
def place_patches(canvas: DataFrame, size: int, n_patches: int, quality: int = 1, seed: int = 7) -> DataFrame:
    """canvas(image_id, h, w) -> placements (image_id, gy, gx, y, x, patch, k, flip) on a jittered grid."""
    overlap, jitter = QUALITY[max(1, min(3, quality))]
    step = max(2, int(size * (1 - overlap)))
    j = max(1, int(step * jitter / 3))
    g = lambda side: F.sequence(F.lit(0), F.floor((F.col(side) + 2 * size - 1) / step).cast("int"))
    d = canvas.select(IMG, "h", "w", F.explode(g("h")).alias("gy")).withColumn("gx", F.explode(g("w")))
    a, b = mix(F.col(IMG), F.lit(seed)), (F.col("gy") * 65536 + F.col("gx")).cast("bigint") * 8
    draw = lambda i, n: pick(a, b + i, n).cast("int")
    return d.select(IMG, "gy", "gx", (F.col("gy") * step - size + draw(0, 2 * j + 1) - j).alias("y"),
                    (F.col("gx") * step - size + draw(1, 2 * j + 1) - j).alias("x"), draw(2, n_patches).alias("patch"),
                    draw(3, 4).alias("k"), draw(4, 2).alias("flip"))


def ramp_weight(py: Column, px: Column, size: int, seam: float = 3.0) -> Column:
    """Feather window of a patch: product of distances to the nearer edges, peak one, raised to the seam power."""
    ramp = lambda c: F.least(c, F.lit(size - 1) - c) + 1
    peak = ((size - 1) // 2 + 1) ** 2
    return F.pow((ramp(py) * ramp(px)) / F.lit(float(peak)), F.lit(float(seam)))


def synth_layer(placed: DataFrame, patches: DataFrame, canvas: DataFrame, size: int, fields: list[str], seam: float = 3.0) -> DataFrame:
    """Weighted mean of all patch pixels that land on a canvas pixel. patches(patch, y, x, on_road, fields..)."""
    p = patches.select("patch", F.col("y").alias("py"), F.col("x").alias("px"), "on_road", *fields).filter("on_road")
    d = placed.join(p, "patch").join(canvas, IMG)
    oy, ox = A.orient(F.col("py"), F.col("px"), F.lit(size), F.col("k"), F.col("flip"))
    d = d.withColumn("oy", oy).withColumn("ox", ox)
    d = d.select(IMG, "h", "w", (F.col("y") + F.col("oy")).cast("int").alias("y"), (F.col("x") + F.col("ox")).cast("int").alias("x"),
                 ramp_weight(F.col("oy"), F.col("ox"), size, seam).alias("wt"), *fields)
    d = d.filter("y >= 0 and x >= 0 and y < h and x < w")
    return d.groupBy(IMG, "y", "x").agg(*[(F.sum(F.col(f) * F.col("wt")) / F.sum("wt")).alias(f) for f in fields])


def grid_of(canvas: DataFrame) -> DataFrame:
    return canvas.select(IMG, "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y")).select(
        IMG, "y", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("x"))


def fill_nearest(px: DataFrame, filled: str, fields: list[str], max_distance: float | None = None) -> DataFrame:
    """Pixels without a value take that of the nearest filled pixel of the image (ties: smallest y, then x)."""
    near = N.nearest_target(px.select(IMG, "y", "x", filled, *fields), filled, (filled, *fields))
    src = px.filter(filled).select(IMG, F.col("y").alias("ty"), F.col("x").alias("tx"), *[F.col(f).alias(f"_n_{f}") for f in fields])
    d = near.join(src, [IMG, "ty", "tx"], "left")
    ok = F.col(filled) if max_distance is None else F.col(filled)
    reach = F.lit(True) if max_distance is None else (F.col("d2") <= F.lit(float(max_distance) ** 2))
    return d.select(IMG, "y", "x", *[F.when(ok, F.col(f)).when(reach, F.col(f"_n_{f}")).otherwise(F.col(f)).alias(f) for f in fields])


# ---------------------------------------------------------------- resizing
def resize_weights(n: int, m: int) -> list[tuple[int, int, float]]:
    """(output, input, weight) rows: box mean when shrinking, linear between sample centres when growing."""
    out = []
    for o in range(m):
        if m < n:
            a, b = o * n / m, (o + 1) * n / m
            w = [(i, min(b, i + 1) - max(a, i)) for i in range(int(a), min(n, int(b - 1e-12) + 1))]
        else:
            c = (o + 0.5) * n / m - 0.5
            i = int(c // 1)
            w = [(min(max(i, 0), n - 1), 1 - (c - i)), (min(max(i + 1, 0), n - 1), c - i)]
        total = sum(v for _, v in w)
        merged: dict[int, float] = {}
        for i, v in w:
            merged[i] = merged.get(i, 0.0) + v / total
        out += [(o, i, v) for i, v in sorted(merged.items()) if v > 0]
    return out


def resize_patches(patches: DataFrame, key: list[str], n: int, factor: float, fields: list[str]) -> DataFrame:
    """Patches of side n brought to side max(3, round(n * factor)); the weights of one axis are a short constant list."""
    m = max(3, int(round(n * factor)))
    by_in: dict[int, list] = {}
    for o, i, v in resize_weights(n, m):
        by_in.setdefault(i, []).append((o, v))
    table = F.array(*[F.array(*[F.struct(F.lit(o).alias("o"), F.lit(v).alias("w")) for o, v in by_in.get(i, [])]) if by_in.get(i)
                      else F.array().cast("array<struct<o:int,w:double>>") for i in range(n)])
    d = patches.select(*key, "y", "x", *fields)
    for axis, other in (("y", "x"), ("x", "y")):
        e = d.withColumn("_t", F.explode(F.get(table, F.col(axis))))
        d = e.groupBy(*key, F.col("_t.o").alias(axis), other).agg(*[F.sum(F.col(f) * F.col("_t.w")).alias(f) for f in fields])
    return d


def resize_to(patches: DataFrame, key: list[str], side: str, target: str, fields: list[str]) -> DataFrame:
    """Patches of different sides brought to the side their row names: patches(*key, y, x, side, target, *fields).

    The weights of `resize_weights` in whole numbers, worked out per pixel, so sides may vary by row. Input that is
    spread by `key` or a part of it is not shuffled again. Rows without a side or target give no pixels.
    """
    n, m = F.col(side).cast("bigint"), F.col(target).cast("bigint")

    def reach(i):
        shrunk = F.sequence((i * m / n).cast("bigint"), (((i + 1) * m - 1) / n).cast("bigint"))
        low = F.when(i == 0, F.lit(0)).otherwise(F.floor((m * (2 * i - 1) - n) / (2 * n)))
        high = F.when(i == n - 1, m - 1).otherwise(F.ceil((m * (2 * i + 3) - n) / (2 * n)))
        grown = F.sequence(F.greatest(low, F.lit(0)).cast("bigint"), F.least(high, m - 1).cast("bigint"))
        return F.when(m < n, shrunk).otherwise(grown)

    def weight(o, i):
        box = (F.least((o + 1) * n, (i + 1) * m) - F.greatest(o * n, i * m)) / n
        centre = F.least(F.greatest((2 * o + 1) * n - m, F.lit(0)), 2 * m * (n - 1))
        return F.when(m < n, box).otherwise((2 * m - F.abs(centre - 2 * m * i)) / (2 * m))

    d = patches.select(*key, "y", "x", side, target, *fields)
    for axis in ("y", "x"):
        i = F.col(axis).cast("bigint")
        d = d.withColumn(f"_{axis}", F.explode(reach(i))).withColumn(f"_w{axis}", weight(F.col(f"_{axis}"), i)).filter(F.col(f"_w{axis}") > 0)
    return d.groupBy(*key, F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x")).agg(
        *[F.sum(F.col(f) * F.col("_wy") * F.col("_wx")).alias(f) for f in fields])


def zoom_lines(px: DataFrame, line: list[str], pos: str, field: str, scale: int) -> DataFrame:
    """Linear interpolation of one axis onto scale times as many samples, end samples kept."""
    p = lines(px, line, pos, [field]).select(*line, F.transform("a", lambda s: s[field]).alias("a"))

    def up(a):
        n = F.size(a)
        m = n * scale

        def at(i):
            c = i * (n - 1) / F.greatest(m - 1, F.lit(1))
            return let(c, lambda c: let(F.least(F.floor(c).cast("int"), n - 1), lambda k: F.get(a, k) + (
                F.get(a, F.least(k + 1, n - 1)) - F.get(a, k)) * (c - k)))
        return F.transform(F.sequence(F.lit(0), m - 1), at)

    return p.select(*line, F.posexplode(let(F.col("a"), up)).alias(pos, field))


def signed_distance(road: DataFrame, scale: int = 1, smooth: float = 1.0) -> DataFrame:
    """road(image_id, y, x, road) -> smooth signed distance, coverage 0..1 and mask at `scale` times the size."""
    ins = N.distance_transform(road.select(IMG, "y", "x", F.col("road").alias("inside"))).select(IMG, "y", "x", F.col("dist").alias("din"))
    out = N.distance_transform(road.select(IMG, "y", "x", (~F.col("road")).alias("inside"))).select(IMG, "y", "x", F.col("inside").alias("off"), F.col("dist").alias("dout"))
    d = ins.join(out, [IMG, "y", "x"]).select(IMG, "y", "x", F.when(F.col("off"), -(F.col("dout") - 0.5)).otherwise(F.col("din") - 0.5).alias("sdf"))
    if smooth > 0:
        w = gaussian_weights(smooth)
        d = stencil(d, ["sdf"], len(w) // 2, lambda a: {"sdf": weigh(a["sdf"], w)}, ["sdf"])
    if scale > 1:
        d = zoom_lines(zoom_lines(d, [IMG, "y"], "x", "sdf", scale), [IMG, "x"], "y", "sdf", scale).withColumn("sdf", F.col("sdf") * scale)
    return d.select(IMG, "y", "x", "sdf", clip(F.col("sdf") + 0.5, 0.0, 1.0).alias("coverage"), (F.col("sdf") >= 0).alias("road"))


# ---------------------------------------------------------------- blending and finishing
def blend_groups(px: DataFrame, parts: list[str], scale: int = 1) -> DataFrame:
    """px(image_id, y, x, layer_<part>, in_<part> 0/1): layers mixed with softly blurred part masks."""
    w = gaussian_weights(1.5 * scale)
    r = len(w) // 2

    def mixed(a):
        ws = {p: weigh(a[f"in_{p}"], w) for p in parts}
        core = lambda v: v[r:v.shape[0] - r, r:v.shape[1] - r]
        top = sum(core(a[f"layer_{p}"]) * ws[p] for p in parts)
        return {"v": top / (sum(ws.values())).clip(1e-6)}

    return stencil(px, [f"{k}_{p}" for k in ("layer", "in") for p in parts], r, mixed, ["v"])


def scale_grain(px: DataFrame, fields: list[str], grain: float, scale: int = 1) -> DataFrame:
    w = gaussian_weights(max(1.0, 1.2 * scale))
    r = len(w) // 2

    def scaled(a):
        out = {}
        for f in fields:
            broad = weigh(a[f], w)
            core = a[f][r:a[f].shape[0] - r, r:a[f].shape[1] - r]
            out[f] = broad + (core - broad) * grain
        return out

    return stencil(px, fields, r, scaled, fields)


def match_tone(px: DataFrame, fields: list[str], target: float) -> DataFrame:
    """px(.., on_road): shift every channel so that the road's mean luminance hits the target."""
    lum = sum((F.col(f) for f in fields[1:]), F.col(fields[0])) / float(len(fields))
    m = px.groupBy(IMG).agg(F.avg(F.when(F.col("on_road"), lum)).alias("_m"))
    shift = F.coalesce(F.lit(float(target)) - F.col("_m"), F.lit(0.0))
    return px.join(m, IMG).select(IMG, "y", "x", "on_road", *[(F.col(f) + shift).alias(f) for f in fields])


def wear_map(layer: DataFrame) -> DataFrame:
    """layer(image_id, y, x, v, on_road): 0..1 between the 5th and 95th percentile of the road."""
    q = exact_quantiles(layer.filter("on_road"), [IMG], "v", {"lo": 0.05, "hi": 0.95})
    d = layer.join(q, IMG, "left")
    lo, hi = F.coalesce("lo", F.lit(0.0)), F.coalesce("hi", F.lit(1.0))
    return d.select(IMG, "y", "x", "on_road", clip((F.col("v") - lo) / F.greatest(hi - lo, F.lit(1e-6)), 0.0, 1.0).alias("wear"))


def worn(v: Column, wear: Column, strength: float) -> Column:
    return v * (1.0 - wear * (0.45 * strength))


def composite_paint(px: DataFrame, strength: float, soft: bool = True) -> DataFrame:
    """px(.., r, g, b, wear, paint, coverage, on_road): markings over the worn road, then the edge faded to the background."""
    d = px
    for c in "rgb":
        mixd = F.col(c) * (1.0 - F.col("paint")) + F.col("paint") * PAINT_RGB[c] * (1.0 - F.col("wear") * (0.25 * strength))
        d = d.withColumn(c, mixd)
    if not soft:
        return d.select(IMG, "y", "x", *[F.when(F.col("on_road"), F.col(c)).otherwise(F.lit(BACKGROUND[c])).alias(c) for c in "rgb"])
    filled = fill_nearest(d.select(IMG, "y", "x", "on_road", "r", "g", "b"), "on_road", ["r", "g", "b"])
    e = filled.join(d.select(IMG, "y", "x", "coverage"), [IMG, "y", "x"])
    return e.select(IMG, "y", "x", *[clip(F.col(c) * F.col("coverage") + (1.0 - F.col("coverage")) * BACKGROUND[c], 0.0, 255.0).alias(c) for c in "rgb"])


def group_code_map(parts: DataFrame, road: DataFrame, js: DataFrame) -> DataFrame:
    """Code 1 junction, 2 edge, 3 open, 0 off the road; and the highest junction id covering a road pixel."""
    on = road.filter("road").select(IMG, "y", "x")
    ids = N.in_discs(on, js.select(IMG, F.col("jid").alias("root"), "cy", "cx", "r")).groupBy(IMG, "y", "x").agg(F.max("root").alias("junction_id"))
    code = F.when(F.col("part") == "junction", 1).when(F.col("part") == "edge", 2).when(F.col("part") == "open", 3).otherwise(0)
    return (road.select(IMG, "y", "x").join(parts.select(IMG, "y", "x", "part"), [IMG, "y", "x"], "left")
            .join(ids, [IMG, "y", "x"], "left").select(IMG, "y", "x", code.alias("code"), F.coalesce("junction_id", F.lit(0).cast("bigint")).alias("junction_id")))


def generation_summary(codes: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("code") == k)
    road = F.greatest(F.lit(1), F.count_if(F.col("code") > 0))
    return codes.groupBy(IMG).agg(F.count_if(F.col("code") > 0).alias("road_px"), *[(n(k) / road).alias(p) for k, p in ((3, "open"), (2, "edge"), (1, "junction"))],
                                  F.count_distinct(F.when(F.col("junction_id") > 0, F.col("junction_id"))).alias("junctions"))


# ---------------------------------------------------------------- tiles
def torus_places(src: DataFrame, size: int, patch: int, seed: int = 1, key: str = IMG) -> DataFrame:
    """Placements on a tile whose opposite sides join: src(key, h, w) -> (key, gy, gx, y, x, sy, sx, k, flip)."""
    step = max(2, int(patch * 0.75))
    jit = max(0, (patch - step) // 2 - 1)
    g = F.sequence(F.lit(0), F.lit((size - 1) // step))
    d = src.select(key, "h", "w", F.explode(g).alias("gy")).withColumn("gx", F.explode(g))
    a, b = mix(F.col(key), F.lit(seed)), (F.col("gy") * 65536 + F.col("gx")).cast("bigint") * 8
    draw = lambda i, n: pick(a, b + i, n).cast("int")
    room = lambda side: F.greatest(F.lit(1), F.col(side) - patch)
    return d.select(key, "gy", "gx", (F.col("gy") * step + draw(0, 2 * jit + 1) - jit).alias("y"), (F.col("gx") * step + draw(1, 2 * jit + 1) - jit).alias("x"),
                    draw(2, room("h")).alias("sy"), draw(3, room("w")).alias("sx"), draw(4, 4).alias("k"), draw(5, 2).alias("flip"))


def torus_synth(places: DataFrame, src: DataFrame, size: int, patch: int, fields: list[str], seam: float = 3.0) -> DataFrame:
    """Weighted mean on the torus; each placement reads its own square of the source image."""
    sq = F.sequence(F.lit(0), F.lit(patch - 1))
    d = places.withColumn("py", F.explode(sq)).withColumn("px", F.explode(sq))
    oy, ox = A.orient(F.col("py"), F.col("px"), F.lit(patch), F.col("k"), F.col("flip"))
    d = d.select(IMG, (F.col("sy") + F.col("py")).alias("_sy"), (F.col("sx") + F.col("px")).alias("_sx"), F.pmod(F.col("y") + oy, F.lit(size)).cast("int").alias("ty"),
                 F.pmod(F.col("x") + ox, F.lit(size)).cast("int").alias("tx"), ramp_weight(oy, ox, patch, seam).alias("wt"))
    s = src.select(IMG, F.col("y").alias("_sy"), F.col("x").alias("_sx"), *fields)
    g = d.join(s, [IMG, "_sy", "_sx"]).groupBy(IMG, F.col("ty").alias("y"), F.col("tx").alias("x")).agg(
        *[(F.sum(F.col(f) * F.col("wt")) / F.sum("wt")).alias(f) for f in fields])
    full = places.select(IMG).distinct().select(IMG, F.lit(size).alias("h"), F.lit(size).alias("w"))
    return fill_nearest(grid_of(full).join(g, [IMG, "y", "x"], "left").withColumn("filled", F.col(fields[0]).isNotNull()), "filled", fields)


def calm_tile(tile: DataFrame, size: int, fields=("r", "g", "b")) -> DataFrame:
    """Remove blotches (a wrapped blur) and soften extreme spots, keeping the grain."""
    fields = list(fields)
    w = gaussian_weights(size / 12)
    r = len(w) // 2

    def flat(a):
        core = lambda v: v[r:v.shape[0] - r, r:v.shape[1] - r]
        return {**{f: core(a[f]) - weigh(a[f], w) for f in fields}, **{f"raw_{f}": core(a[f]) for f in fields}}

    d = materialize(stencil(tile, fields, r, flat, fields + [f"raw_{f}" for f in fields], wrap=True))
    mean = d.groupBy(IMG).agg(*[F.avg(f"raw_{f}").alias(f"_m_{f}") for f in fields])
    d = d.join(mean, IMG).select(IMG, "y", "x", *[(F.col(f) + F.col(f"_m_{f}")).alias(f) for f in fields])
    lum = sum((F.col(f) for f in fields[1:]), F.col(fields[0])) / float(len(fields))
    d = d.withColumn("_l", lum)
    s = d.groupBy(IMG).agg(F.avg("_l").alias("_mu"), (F.stddev_pop("_l") + 1e-6).alias("_sd"))
    z = (F.col("_l") - F.col("_mu")) / F.col("_sd")
    add = (F.tanh(z / 2.5) * 2.5 - z) * F.col("_sd")
    return d.join(s, IMG).select(IMG, "y", "x", *[(F.col(f) + add).alias(f) for f in fields])


def retone_tile(tile: DataFrame, ratio: Column, tone: Column, fields=("r", "g", "b")) -> DataFrame:
    """tile(.. plus columns used by ratio and tone): detail scaled, mean moved to the tone, clipped to 8 bits."""
    fields = list(fields)
    m = tile.groupBy(IMG).agg(*[F.avg(f).alias(f"_m_{f}") for f in fields])
    centre = sum((F.col(f"_m_{f}") for f in fields[1:]), F.col(f"_m_{fields[0]}")) / float(len(fields))
    d = tile.join(m, IMG)
    out = lambda f: clip(F.col(f"_m_{f}") - F.coalesce(centre - tone, F.lit(0.0)) + (F.col(f) - F.col(f"_m_{f}")) * clip(ratio, 0.4, 2.0), 0.0, 255.0)
    return d.select(IMG, "y", "x", *[out(f).alias(f) for f in fields])


def seam_score(tile: DataFrame, key: str = IMG) -> DataFrame:
    """tile(key, y, x, v): step across the wrapped edge over the usual step between neighbours."""
    wx, wy = W.partitionBy(key, "y").orderBy("x"), W.partitionBy(key, "x").orderBy("y")
    d = tile.withColumn("dx", F.abs(F.col("v") - F.lag("v").over(wx))).withColumn("dy", F.abs(F.col("v") - F.lag("v").over(wy)))
    side = tile.groupBy(key).agg(F.max("y").alias("_y1"), F.max("x").alias("_x1"))
    inner = d.groupBy(key).agg(((F.avg("dx") + F.avg("dy")) / 2).alias("inside"))

    def across(axis, line, last):
        e = tile.join(side, key).filter((F.col(axis) == 0) | (F.col(axis) == F.col(last)))
        p = e.groupBy(key, line).agg((F.max(F.when(F.col(axis) == 0, F.col("v"))) - F.max(F.when(F.col(axis) == F.col(last), F.col("v")))).alias("s"))
        return p.groupBy(key).agg(F.avg(F.abs("s")).alias(f"a_{axis}"))

    s = inner.join(across("x", "y", "_x1"), key).join(across("y", "x", "_y1"), key)
    return s.select(key, ((F.col("a_x") + F.col("a_y")) / 2 / F.greatest(F.col("inside"), F.lit(1e-6))).alias("seam"))


def noticeability(tile: DataFrame, size: int) -> DataFrame:
    """Spread of medium-sized features over the spread of the fine grain."""
    wm, wf = gaussian_weights(size / 40), gaussian_weights(1.5)
    r = max(len(wm), len(wf)) // 2

    def both(a):
        v = a["v"]
        cut = lambda k: v[r - k:v.shape[0] - (r - k), r - k:v.shape[1] - (r - k)]
        return {"medium": weigh(cut(len(wm) // 2), wm), "fine": cut(0) - weigh(cut(len(wf) // 2), wf)}

    d = stencil(tile, ["v"], r, both, ["medium", "fine"], wrap=True)
    return d.groupBy(IMG).agg((F.stddev_pop("medium") / F.greatest(F.stddev_pop("fine"), F.lit(1e-6))).alias("noticeability"))


def period_crop(prof: DataFrame, per: DataFrame, dims: DataFrame, src_width_m: float, tile_m: float, seed: int = 1) -> DataFrame:
    """Crop of whole repeats nearest to the tile size, starting on a joint, for images that repeat both ways.

    prof(image_id, axis, pos, p); the joint is where the profile differs most from its moving mean over one period.
    """
    p = prof.join(per.select(IMG, "period_x", "period_y"), IMG).filter("period_x is not null and period_y is not null")
    p = p.withColumn("period", F.when(F.col("axis") == "x", F.col("period_x")).otherwise(F.col("period_y")))
    arr = p.groupBy(IMG, "axis", "period").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p"))), lambda s: s["p"]).alias("a"))

    def joint(s):
        a, n, k = s["a"], F.size(s["a"]), s["k"]
        # centred moving mean, one sample early for even periods, wrapping around
        mean = lambda i: F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda t, j: t + F.get(a, F.pmod(i + j - F.floor(k / 2).cast("int"), n))) / k
        dev = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(F.round(-F.abs(F.get(a, i) - mean(i)), 9).alias("d"), i.alias("i")))
        return F.array_min(dev)["i"]

    ph = arr.select(IMG, "axis", let(F.struct("a", F.col("period").alias("k")), joint).alias("phase"))
    w = ph.groupBy(IMG).agg(F.max(F.when(F.col("axis") == "x", F.col("phase"))).alias("phx"), F.max(F.when(F.col("axis") == "y", F.col("phase"))).alias("phy"))
    d = w.join(per, IMG).join(dims, IMG)
    mpp = F.lit(float(src_width_m)) / F.col("w")
    n = lambda c: F.greatest(F.lit(1), F.bround(F.lit(float(tile_m)) / (F.col(c) * mpp), 0).cast("int"))
    d = d.withColumn("nx", n("period_x")).withColumn("ny", n("period_y"))
    d = d.withColumn("cw", F.col("nx") * F.col("period_x")).withColumn("ch", F.col("ny") * F.col("period_y")).filter("cw <= w and ch <= h")
    room = lambda side, ph, c, per_: F.greatest(F.lit(1), F.floor((F.col(side) - F.col(ph) - F.col(c)) / F.col(per_)).cast("int") + 1)
    kx = pick(mix(F.col(IMG), F.lit(seed)), F.lit(0), room("w", "phx", "cw", "period_x")).cast("int")
    ky = pick(mix(F.col(IMG), F.lit(seed)), F.lit(1), room("h", "phy", "ch", "period_y")).cast("int")
    d = d.withColumn("_x", F.col("phx") + kx * F.col("period_x")).withColumn("_y", F.col("phy") + ky * F.col("period_y"))
    out = (F.col("_x") + F.col("cw") > F.col("w")) | (F.col("_y") + F.col("ch") > F.col("h"))
    return d.select(IMG, F.when(out, F.col("phx")).otherwise(F.col("_x")).alias("x0"), F.when(out, F.col("phy")).otherwise(F.col("_y")).alias("y0"),
                    "cw", "ch", "nx", "ny")


# fixed values: default tile settings and the tone of placeholder concrete
TILE_DEFAULTS = {"photo_width_m": 2.0, "tile_m": 4.0, "px": 1024.0, "variants": 3.0, "sidewalk_width_m": 2.0}
CONCRETE = {"tone": 165.0, "ratio": 0.6}


TILE_PARTS = ("open", "edge", "junction", "sidewalk")


def tile_settings(saved: DataFrame, asked: DataFrame) -> DataFrame:
    """One value per (set_id, name): what was asked for, else what was saved last, else the default."""
    base = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("d")) for k, v in TILE_DEFAULTS.items()]))
    ids = asked.select("set_id").unionByName(saved.select("set_id")).distinct()
    d = ids.select("set_id", base.alias("b")).select("set_id", "b.name", "b.d")
    d = d.join(saved.select("set_id", "name", F.col("value").alias("s")), ["set_id", "name"], "left")
    d = d.join(asked.select("set_id", "name", F.col("value").alias("a")), ["set_id", "name"], "left")
    return d.select("set_id", "name", F.coalesce("a", "s", "d").alias("value"))


def tile_set(index: DataFrame, measured: DataFrame, variants: int = 3, prime_tone: float | None = None) -> DataFrame:
    """index(part, pair_id, rank); measured(part, pair_id, mean, local_contrast): tone and contrast ratio per tile.

    Every part takes its top-ranked pair; ratios are relative to open road; sidewalks get placeholder concrete.
    """
    top = index.groupBy("part").agg(F.min_by("pair_id", "rank").alias("pair_id"))
    s = top.join(measured, ["part", "pair_id"], "left").groupBy().pivot("part", ["junction", "edge", "open"]).agg(
        F.first("mean").alias("tone"), F.first("local_contrast").alias("contrast"))
    base = F.coalesce("open_contrast", "edge_contrast", "junction_contrast")
    tone = F.coalesce("open_tone", F.lit(prime_tone).cast("double"))
    rows = [F.struct(F.lit(p).alias("part"), tone.alias("tone"), F.coalesce(F.col(f"{p}_contrast") / base, F.lit(1.0)).alias("ratio"),
                     F.coalesce(F.col(f"{p}_tone"), F.lit(prime_tone).cast("double")).alias("part_tone")) for p in TILE_PARTS[:3]]
    rows.append(F.struct(F.lit("sidewalk").alias("part"), F.lit(CONCRETE["tone"]).alias("tone"), F.lit(CONCRETE["ratio"]).alias("ratio"), F.lit(CONCRETE["tone"]).alias("part_tone")))
    return s.select(F.explode(F.array(*rows)).alias("t")).select("t.*", F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("variant"))


def tile_scores(settings: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """Seam and noticeability of each tile brought to the tone and contrast of each part.

    settings(part, tone, ratio) has one row per part, as `tile_set` gives them; tiles(variant, y, x, r, g, b) are square and
    calmed. Parts without settings have no row.
    """
    each = tiles.withColumn("part", F.explode(F.array(*[F.lit(p) for p in TILE_PARTS]))).join(
        F.broadcast(settings.select("part", "tone", "ratio").distinct()), "part")
    each = each.withColumn(IMG, F.concat_ws("/", "part", F.col("variant").cast("string")))
    names = each.select(IMG, "part", "variant", "tone", "ratio").distinct()
    toned = retone_tile(each, F.col("ratio"), F.col("tone"))
    luma = materialize(toned.select(IMG, "y", "x", ((F.col("r") + F.col("g") + F.col("b")) / 3.0).alias("v")))
    return names.join(seam_score(luma), IMG).join(noticeability(luma, size), IMG).drop(IMG)


def lag_repeat_check(prof: DataFrame, key: str, tile_lag: int, shares=(0.8, 0.85, 1.15, 1.2)) -> DataFrame:
    """prof(key, seq, v): similarity one tile apart minus the mean similarity at nearby distances.

    Lagged products are an equi-join on the shifted position, so a long street is spread over its samples.
    """
    mean = prof.groupBy(key).agg(F.avg("v").alias("_m"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 4 * tile_lag)
    c = prof.join(mean, key).select(key, "seq", (F.col("v") - F.col("_m")).alias("c"))
    lags = [tile_lag] + [int(tile_lag * s) for s in shares]
    ask = c.withColumn("lag", F.explode(F.array(*[F.lit(l) for l in sorted(set(lags))]))).select(key, (F.col("seq") + F.col("lag")).alias("seq"), "lag", F.col("c").alias("a"))
    s = ask.join(c, [key, "seq"]).groupBy(key, "lag").agg(F.sum(F.col("a") * F.col("c")).alias("xy"), F.sum(F.col("a") * F.col("a")).alias("xx"), F.sum(F.col("c") * F.col("c")).alias("yy"))
    r = s.withColumn("r", F.col("xy") / F.greatest(F.sqrt(F.col("xx") * F.col("yy")), F.lit(1e-9)))
    near = sum((F.max(F.when(F.col("lag") == l, F.col("r"))) for l in lags[2:]), F.max(F.when(F.col("lag") == lags[1], F.col("r")))) / float(len(shares))
    return r.groupBy(key).agg((F.max(F.when(F.col("lag") == tile_lag, F.col("r"))) - near).alias("repeat"))


def variation_factor(px: DataFrame, mpp: float, strength: float = 1.0, sigma_m: float = 3.0) -> DataFrame:
    """px(.., v, good): broad brightness of the road around one, with markings filled from the road beside them."""
    filled = fill_nearest(px.select(IMG, "y", "x", F.col("v").cast("double").alias("v"), "good"), "good", ["v"])
    w = gaussian_weights(max(1.0, sigma_m / mpp))
    broad = materialize(stencil(filled, ["v"], len(w) // 2, lambda a: {"v": weigh(a["v"], w)}, ["v"]))
    good = px.filter("good").select(IMG, "y", "x")
    med = exact_quantiles(broad.join(good, [IMG, "y", "x"], "left_semi"), [IMG], "v", {"med": 0.5})
    f = (F.col("v") / F.greatest(F.col("med"), F.lit(1e-6)) - 1.0) * float(strength) + 1.0
    return broad.join(med, IMG, "left").select(IMG, "y", "x", F.coalesce(clip(f, 0.7, 1.3), F.lit(1.0)).alias("factor"))
