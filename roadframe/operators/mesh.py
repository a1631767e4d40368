"""Mesh checks, grids, raster cover of faces, and placement of object copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from roadframe.functions.scalars import half_even_int
from roadframe.operators.common import connected_components, label_regions, materialize
from roadframe.operators.geometry import in_rotated_rect
from roadframe.operators.memory import range_rank
from roadframe.operators.network import IMG

UP_EPS = 2e-4                     # twice the smallest area a half quad may have
MIN_AREA = 1e-3                   # square metres


def world_coords(px: DataFrame, mpp: float) -> DataFrame:
    """px(.., x, y, w, h in pixels) -> metres around the image centre, and texture coordinates."""
    return px.withColumn("wx", F.col("x") * mpp - F.col("w") * mpp / 2).withColumn("wz", F.col("y") * mpp - F.col("h") * mpp / 2).withColumn(
        "u", F.col("x") / F.col("w")).withColumn("v", F.col("y") / F.col("h"))


def with_corners(faces: DataFrame, vertices: DataFrame, corners: str) -> DataFrame:
    """Corner positions next to each face in one look-up per corner: adds <c>x, <c>h, <c>z."""
    d = faces
    for c in corners:
        v = vertices.select("mesh_id", F.col("vid").alias(c), *[F.col(k).alias(f"{c}{k}") for k in ("x", "h", "z")])
        d = d.join(v, ["mesh_id", c])
    return d


def _up(p: str, q: str, r: str) -> Column:
    """Twice the area of a triangle seen from above, positive if it faces up."""
    col = lambda n: F.col(n)
    return (col(f"{q}z") - col(f"{p}z")) * (col(f"{r}x") - col(f"{p}x")) - (col(f"{q}x") - col(f"{p}x")) * (col(f"{r}z") - col(f"{p}z"))


def fix_winding(tris: DataFrame, vertices: DataFrame) -> DataFrame:
    """tris(mesh_id, fid, a, b, c): slivers dropped, downward faces turned over."""
    d = with_corners(tris, vertices, "abc").withColumn("ny", _up("a", "b", "c")).filter(F.abs("ny") * 0.5 > MIN_AREA)
    flip = F.col("ny") < 0
    return d.select("mesh_id", "fid", "a", F.when(flip, F.col("c")).otherwise(F.col("b")).alias("b"), F.when(flip, F.col("b")).otherwise(F.col("c")).alias("c"), flip.alias("flipped"))


def split_quads(quads: DataFrame, vertices: DataFrame, eps: float = UP_EPS) -> DataFrame:
    """quads(mesh_id, fid, a, b, c, d, ..) -> triangles (.., half, a, b, c, other_diagonal), degenerate quads dropped.

    Reversed quads are turned over first; a quad is split along a-c, else b-d, else its one half with area is kept.
    """
    d = with_corners(quads, vertices, "abcd")
    rev = _up("a", "b", "c") + _up("a", "c", "d") < 0
    swap = {f"b{k}": F.when(rev, F.col(f"d{k}")).otherwise(F.col(f"b{k}")) for k in ("", "x", "h", "z")}
    swap |= {f"d{k}": F.when(rev, F.col(f"b{k}")).otherwise(F.col(f"d{k}")) for k in ("", "x", "h", "z")}
    d = d.withColumns(swap)
    big = lambda p, q, r: _up(p, q, r) > eps
    tri = lambda p, q, r, half, other: F.struct(F.lit(half).alias("half"), F.col(p).alias("a"), F.col(q).alias("b"), F.col(r).alias("c"), F.lit(other).alias("other_diagonal"))
    abc, acd, abd, bcd = big("a", "b", "c"), big("a", "c", "d"), big("a", "b", "d"), big("b", "c", "d")
    none = F.array().cast("array<struct<half:int,a:int,b:int,c:int,other_diagonal:boolean>>")
    t = (F.when(abc & acd, F.array(tri("a", "b", "c", 0, False), tri("a", "c", "d", 1, False)))
         .when(abd & bcd, F.array(tri("a", "b", "d", 0, True), tri("b", "c", "d", 1, True)))
         .when(abc, F.array(tri("a", "b", "c", 0, False))).when(acd, F.array(tri("a", "c", "d", 1, False)))
         .when(abd, F.array(tri("a", "b", "d", 0, True))).when(bcd, F.array(tri("b", "c", "d", 1, True))).otherwise(none))
    keep = [c for c in quads.columns if c not in ("a", "b", "c", "d")]
    return d.select(*keep, F.explode(t).alias("t")).select(*keep, "t.*")


def mesh_volume_stats(quads: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices, quads, triangles, dropped quads, other-diagonal splits and size per mesh."""
    t = split_quads(quads, vertices)
    per = t.groupBy("mesh_id", "fid").agg(F.count(F.lit(1)).alias("n"), F.bool_and("other_diagonal").alias("o"))
    k = per.groupBy("mesh_id").agg(F.sum("n").alias("triangles"), F.count(F.lit(1)).alias("kept"), F.count_if(F.col("o") & (F.col("n") == 2)).alias("other_diagonal"))
    q = quads.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("quads"))
    v = vertices.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("vertices"), (F.max("x") - F.min("x")).alias("size_x"), (F.max("z") - F.min("z")).alias("size_z"))
    d = v.join(q, "mesh_id").join(k, "mesh_id", "left").na.fill(0, ["triangles", "kept", "other_diagonal"])
    return d.select("mesh_id", "vertices", "quads", "triangles", (F.col("quads") - F.col("kept")).alias("dropped"), "other_diagonal", "size_x", "size_z")


def rasterise_faces(tris: DataFrame, vertices: DataFrame, scale: float, key: str = "mesh_id") -> DataFrame:
    """Pixels covered by triangles, with interpolated height; the highest face wins.

    Each triangle lists the pixels of its own box and keeps those with barycentric weights over -1e-6.
    """
    d = with_corners(tris, vertices, "abc")
    s = lambda n: F.col(n) * float(scale)
    x, z = [s(f"{c}x") for c in "abc"], [s(f"{c}z") for c in "abc"]
    d = d.select("mesh_id", "fid", *[e.alias(f"{n}{i}") for n, l in (("x", x), ("z", z)) for i, e in enumerate(l)], *[F.col(f"{c}h").alias(f"h{i}") for i, c in enumerate("abc")])
    span = lambda n: F.sequence(F.ceil(F.least(*[F.col(f"{n}{i}") for i in range(3)])).cast("int"), F.floor(F.greatest(*[F.col(f"{n}{i}") for i in range(3)])).cast("int"))
    ok = (F.floor(F.greatest("x0", "x1", "x2")) >= F.ceil(F.least("x0", "x1", "x2"))) & (F.floor(F.greatest("z0", "z1", "z2")) >= F.ceil(F.least("z0", "z1", "z2")))
    d = d.filter(ok).withColumn("py", F.explode(span("z"))).withColumn("px", F.explode(span("x")))
    c = F.col
    den = (c("z1") - c("z2")) * (c("x0") - c("x2")) + (c("x2") - c("x1")) * (c("z0") - c("z2"))
    d = d.withColumn("den", den).filter(F.abs("den") > 1e-12)
    w0 = ((c("z1") - c("z2")) * (c("px") - c("x2")) + (c("x2") - c("x1")) * (c("py") - c("z2"))) / c("den")
    w1 = ((c("z2") - c("z0")) * (c("px") - c("x2")) + (c("x0") - c("x2")) * (c("py") - c("z2"))) / c("den")
    d = d.withColumn("w0", w0).withColumn("w1", w1).withColumn("w2", 1.0 - F.col("w0") - F.col("w1")).filter("w0 >= -1e-6 and w1 >= -1e-6 and w2 >= -1e-6")
    h = F.round(c("w0") * c("h0") + c("w1") * c("h1") + c("w2") * c("h2"), 9)
    # a plain maximum is summed up in a hash table; one of a struct would sort all pixels of a task first
    return d.select("mesh_id", "py", "px", h.alias("h")).groupBy("mesh_id", F.col("py").alias("y"), F.col("px").alias("x")).agg(F.max("h").alias("h"))


def coverage_audit(road: DataFrame, covered: DataFrame, min_px: int = 12) -> DataFrame:
    """Road pixels no face covers, as regions of at least min_px: (image_id, label, pixels, cy, cx)."""
    bare = road.filter("road").select(IMG, "y", "x").join(covered.select(IMG, "y", "x"), [IMG, "y", "x"], "left_anti")
    return label_regions(bare).groupBy(IMG, "label").agg(F.count(F.lit(1)).alias("pixels"), F.avg("y").alias("cy"), F.avg("x").alias("cx")).filter(F.col("pixels") >= min_px)


def dash_width_classes(streets: DataFrame, groups: int = 3) -> tuple[DataFrame, DataFrame]:
    """streets(street_id, width_m): at most three width classes in centimetres, and the class nearest to each street.

    Widths are counted by millimetre first, so the ordered pass runs over a short list of distinct values.
    """
    v = streets.groupBy(F.round(F.col("width_m") * 100, 1).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(W.orderBy("w").rowsBetween(W.unboundedPreceding, 0))
    total = v.agg(F.sum("n")).scalar()
    # names differ by more than case: "N" would replace the count "n"
    v = v.withColumn("end", run).withColumn("total", total).withColumn("k", F.least(F.lit(groups).cast("bigint"), F.col("total")))
    # array-split rule: the first total mod k groups have one more
    g = v.select("w", "n", "end", "total", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("g"))
    small = F.floor(F.col("total") / F.col("k"))
    extra = F.col("total") % F.col("k")
    lo = F.col("g") * small + F.least("g", extra)
    size = small + F.when(F.col("g") < extra, 1).otherwise(0)
    g = g.withColumn("r0", lo + F.floor((size - 1) / 2)).withColumn("r1", lo + F.ceil((size - 1) / 2))
    has = lambda r: (F.col(r) < F.col("end")) & (F.col(r) >= F.col("end") - F.col("n"))
    med = g.groupBy("g").agg(((F.max(F.when(has("r0"), F.col("w"))) + F.max(F.when(has("r1"), F.col("w")))) / 2).alias("m"))
    centres = med.select(F.greatest(F.lit(5), half_even_int(F.col("m") / 5).cast("int") * 5).alias("cm")).distinct()
    near = F.sort_array(F.collect_list("cm"))
    d = streets.withColumn("c", centres.agg(near).scalar())
    best = F.array_min(F.transform("c", lambda c: F.struct(F.round(F.abs(c - F.col("width_m") * 100), 6).alias("d"), c.alias("c"))))["c"]
    return centres, d.select("street_id", best.alias("cm"))


def group_faces(tris: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Triangles per material group, and a dense vertex numbering inside each group.

    tris(mesh_id, fid, half, a, b, c, owner, keys..): a vertex is repeated per owner, as textures differ by street.
    """
    v = tris.select("mesh_id", *keys, "owner", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    remap = range_rank(v, ["mesh_id", *keys], [F.col("vid").asc(), F.col("owner").asc()], "_n0").withColumn(
        "index", (F.col("_n0") - 1).cast("int")).drop("_n0")
    d = tris
    for c in "abc":
        d = d.join(remap.select("mesh_id", *keys, "owner", F.col("vid").alias(c), F.col("index").alias(f"i{c}")), ["mesh_id", *keys, "owner", c])
    return remap, d.select("mesh_id", *keys, "fid", "half", "ia", "ib", "ic")


def grid_cells(areas: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """areas(image_id, label, y, x): aligned square cells per area, full or cut, and the welded corners of full ones."""
    c = areas.groupBy(IMG, "label", F.floor(F.col("y") / cell).cast("int").alias("gy"), F.floor(F.col("x") / cell).cast("int").alias("gx")).agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("full", F.col("n") == cell * cell)
    corner = F.explode(F.array(*[F.struct((F.col("gy") + a).alias("vy"), (F.col("gx") + b).alias("vx")) for a in (0, 1) for b in (0, 1)]))
    v = c.filter("full").select(IMG, corner.alias("v")).select(IMG, F.round(F.col("v.vy") * float(cell), 3).alias("vy"), F.round(F.col("v.vx") * float(cell), 3).alias("vx")).distinct()
    return c, v


# ---------------------------------------------------------------- object copies
def object_size(d: DataFrame) -> DataFrame:
    k = F.coalesce("scale", F.lit(1.0))
    w, h = F.col("width_m") * k, F.col("depth_m") * k
    odd = F.pmod(F.col("turn"), F.lit(2)) == 1
    return d.withColumn("ow", F.when(odd, h).otherwise(w)).withColumn("od", F.when(odd, w).otherwise(h))


def expand_placements(placements: DataFrame, objects: DataFrame, mpp: float) -> DataFrame:
    """One row per copy: centre in metres, footprint, and its rotation about the up axis as a quaternion (0, qy, 0, qw)."""
    d = object_size(placements.join(objects, "object_id"))
    d = d.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    a = F.radians("angle")
    lx = F.col("nx") * F.col("ow") + (F.col("nx") - 1) * F.col("gap_x")
    ly = F.col("ny") * F.col("od") + (F.col("ny") - 1) * F.col("gap_y")
    du = -lx / 2 + F.col("ow") / 2 + F.col("i") * (F.col("ow") + F.col("gap_x"))
    dv = -ly / 2 + F.col("od") / 2 + F.col("j") * (F.col("od") + F.col("gap_y"))
    phi = -(a + F.pmod(F.col("turn"), F.lit(4)) * F.pi() / 2)
    return d.select("placement_id", "object_id", IMG, "i", "j", "angle", (F.col("cx") * mpp + F.cos(a) * du - F.sin(a) * dv).alias("mx"),
                    (F.col("cy") * mpp + F.sin(a) * du + F.cos(a) * dv).alias("my"), F.col("ow").alias("width"), F.col("od").alias("depth"),
                    F.sin(phi / 2).alias("qy"), F.cos(phi / 2).alias("qw"))


def filter_on_road(copies: DataFrame, road: DataFrame, mpp: float, mode: str = "overlap", limit: float = 0.02) -> DataFrame:
    """Adds `on_road`. 'overlap': more than 2 % of the footprint's cells are road. 'probe': a corner or the centre is.

    Footprints list their own cells, which meet the road pixels by an equi-join.
    """
    key = ["placement_id", "i", "j"]
    c = copies.select(*key, IMG, (F.col("mx") / mpp).alias("cx"), (F.col("my") / mpp).alias("cy"), (F.col("width") / mpp).alias("length"), (F.col("depth") / mpp).alias("width"), "angle")
    on = road.filter("road").select(IMG, "y", "x", F.lit(1).alias("_on"))
    a = F.radians("angle")
    if mode == "probe":
        at = [(sx, sy) for sx in (-1, 1) for sy in (-1, 1)] + [(0, 0)]
        probes = F.array(*[F.struct(F.floor(F.col("cx") + F.cos(a) * F.col("length") * (sx / 2) - F.sin(a) * F.col("width") * (sy / 2) + 0.5).cast("int").alias("x"),
                                    F.floor(F.col("cy") + F.sin(a) * F.col("length") * (sx / 2) + F.cos(a) * F.col("width") * (sy / 2) + 0.5).cast("int").alias("y")) for sx, sy in at])
        hit = c.select(*key, IMG, F.explode(probes).alias("p")).select(*key, IMG, "p.y", "p.x").join(on, [IMG, "y", "x"]).select(*key).distinct()
        return copies.join(hit.withColumn("on_road", F.lit(True)), key, "left").na.fill(False, ["on_road"])
    rad = F.hypot(F.col("length"), F.col("width")) / 2
    span = lambda m: F.sequence(F.floor(F.col(m) - rad).cast("int"), F.ceil(F.col(m) + rad).cast("int"))
    cells = c.withColumn("y", F.explode(span("cy"))).withColumn("x", F.explode(span("cx"))).filter(in_rotated_rect(F.col("x"), F.col("y")))
    s = cells.join(on, [IMG, "y", "x"], "left").groupBy(*key).agg((F.count("_on") / F.count(F.lit(1))).alias("share"))
    return copies.join(s, key, "left").withColumn("on_road", F.coalesce(F.col("share") > limit, F.lit(False))).drop("share")


def snap_copies(want: Column, size: Column, gap: Column) -> Column:
    """Whole copies that fit a dragged extent, rounding half up."""
    return F.greatest(F.lit(1), F.floor((want + gap) / (size + gap) + 0.5).cast("int"))


def vertex_normals(tris: DataFrame, vertices: DataFrame) -> DataFrame:
    """Area-weighted smooth normals; vertices without area point up."""
    d = with_corners(tris, vertices, "abc")
    e = lambda p, q, k: F.col(f"{q}{k}") - F.col(f"{p}{k}")
    ab, ac = {k: e("a", "b", k) for k in "xhz"}, {k: e("a", "c", k) for k in "xhz"}
    n = {"x": ab["h"] * ac["z"] - ab["z"] * ac["h"], "h": ab["z"] * ac["x"] - ab["x"] * ac["z"], "z": ab["x"] * ac["h"] - ab["h"] * ac["x"]}
    c = d.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid"), *[v.alias(f"n{k}") for k, v in n.items()])
    s = c.groupBy("mesh_id", "vid").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in "xhz"])
    d = vertices.select("mesh_id", "vid").join(s, ["mesh_id", "vid"], "left")
    ln = F.sqrt(F.col("nx") * F.col("nx") + F.col("nh") * F.col("nh") + F.col("nz") * F.col("nz"))
    ok = F.coalesce(ln > 1e-12, F.lit(False))
    return d.select("mesh_id", "vid", *[F.when(ok, F.col(f"n{k}") / ln).otherwise(1.0 if k == "h" else 0.0).alias(f"n{k}") for k in "xhz"])


def normalise_object(parts: DataFrame, faces: DataFrame, too_big: float = 60.0) -> tuple[DataFrame, DataFrame]:
    """parts(object_id, part, vid, x, h, z): footprint centred, base at zero; and one row of sizes per object."""
    b = parts.groupBy("object_id").agg(*[f(k).alias(f"{n}_{k}") for k in "xhz" for n, f in (("lo", F.min), ("hi", F.max))], F.count_distinct("part").alias("parts"))
    d = parts.join(b, "object_id")
    moved = d.select("object_id", "part", "vid", (F.col("x") - (F.col("lo_x") + F.col("hi_x")) / 2).alias("x"), (F.col("h") - F.col("lo_h")).alias("h"),
                     (F.col("z") - (F.col("lo_z") + F.col("hi_z")) / 2).alias("z"))
    t = faces.groupBy("object_id").agg(F.count(F.lit(1)).alias("triangles"))
    size = lambda k: F.round(F.col(f"hi_{k}") - F.col(f"lo_{k}"), 3)
    info = b.join(t, "object_id", "left").select("object_id", size("x").alias("width_m"), size("z").alias("depth_m"), size("h").alias("height_m"), F.coalesce("triangles", F.lit(0)).alias("triangles"), "parts")
    return moved, info.withColumn("too_big", F.greatest("width_m", "depth_m", "height_m") > too_big)


# ---------------------------------------------------------------- outlines
def contour_segments(cov: DataFrame, level: float = 0.5) -> DataFrame:
    """cov(image_id, y, x, coverage): level line pieces per 2x2 cell, background outside; saddles keep high corners apart.

    Ends are numbered by the grid edge they lie on, so equal ends join without comparing coordinates.
    """
    tag = F.array(*[F.struct((F.col("y") - a).alias("cy"), (F.col("x") - b).alias("cx"), F.lit(n).alias("n")) for n, (a, b) in {"v00": (0, 0), "v01": (0, 1), "v10": (1, 0), "v11": (1, 1)}.items()])
    c = cov.filter("coverage > 0").select(IMG, "coverage", F.explode(tag).alias("t"), "y", "x")
    g = c.groupBy(IMG, F.col("t.cy").alias("cy"), F.col("t.cx").alias("cx")).agg(*[F.coalesce(F.max(F.when(F.col("t.n") == n, F.col("coverage"))), F.lit(0.0)).alias(n) for n in ("v00", "v01", "v10", "v11")])
    bit = lambda n, b: F.when(F.col(n) >= level, b).otherwise(0)
    g = g.withColumn("case", bit("v00", 1) + bit("v01", 2) + bit("v11", 4) + bit("v10", 8)).filter((F.col("case") > 0) & (F.col("case") < 15))
    f = lambda p, q: (F.lit(level) - F.col(p)) / (F.col(q) - F.col(p))
    big = F.lit(1 << 31).cast("bigint")
    code = lambda y, x, v: ((y.cast("bigint") + 1) * big + (x.cast("bigint") + 1)) * 2 + v
    end = {"T": F.struct(code(F.col("cy"), F.col("cx"), 0).alias("id"), (F.col("cx") + f("v00", "v01")).alias("x"), F.col("cy").cast("double").alias("y")),
           "B": F.struct(code(F.col("cy") + 1, F.col("cx"), 0).alias("id"), (F.col("cx") + f("v10", "v11")).alias("x"), (F.col("cy") + 1).cast("double").alias("y")),
           "L": F.struct(code(F.col("cy"), F.col("cx"), 1).alias("id"), F.col("cx").cast("double").alias("x"), (F.col("cy") + f("v00", "v10")).alias("y")),
           "R": F.struct(code(F.col("cy"), F.col("cx") + 1, 1).alias("id"), (F.col("cx") + 1).cast("double").alias("x"), (F.col("cy") + f("v01", "v11")).alias("y"))}
    # fixed values: cell cases and the edges their pieces join
    table = {1: ["LT"], 2: ["TR"], 3: ["LR"], 4: ["RB"], 5: ["LT", "RB"], 6: ["TB"], 7: ["LB"], 8: ["LB"], 9: ["TB"], 10: ["TR", "LB"], 11: ["RB"], 12: ["LR"], 13: ["TR"], 14: ["LT"]}
    piece = lambda s: F.struct(end[s[0]].alias("p"), end[s[1]].alias("q"))
    pieces = None
    for case, segs in table.items():
        arr = F.array(*[piece(s) for s in segs])
        pieces = F.when(F.col("case") == case, arr) if pieces is None else pieces.when(F.col("case") == case, arr)
    return g.select(IMG, "cy", "cx", F.explode(pieces).alias("s")).select(
        IMG, "cy", "cx", F.col("s.p.id").alias("u"), F.col("s.q.id").alias("v"), F.col("s.p.x").alias("x0"), F.col("s.p.y").alias("y0"), F.col("s.q.x").alias("x1"), F.col("s.q.y").alias("y1"))


def contour_rings(seg: DataFrame) -> DataFrame:
    """Closed outlines: pieces sharing grid edges; with length, area and whether the ring is a hole.

    A ring is a hole when an odd number of other rings of the image encloses its first point: crossing parity over the
    outline pieces of the same pixel row, which an equi-join on the row finds.
    """
    cc = connected_components(seg.select(IMG, "u", "v"), [IMG])
    s = materialize(seg.join(cc.select(IMG, F.col("id").alias("u"), F.col("label").alias("ring")), [IMG, "u"]))
    r = s.groupBy(IMG, "ring").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("length"),
                                   F.min(F.struct("y0", "x0", "cy")).alias("p"))
    p = r.select(IMG, F.col("ring").alias("mine"), F.col("p.y0").alias("py"), F.col("p.x0").alias("px"), F.floor(F.col("p.y0")).cast("int").alias("cy"))
    e = s.select(IMG, "cy", "ring", "x0", "y0", "x1", "y1")
    cross = ((F.col("y0") > F.col("py")) != (F.col("y1") > F.col("py"))) & (F.col("px") < (F.col("x1") - F.col("x0")) * (F.col("py") - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0"))
    n = p.join(e, [IMG, "cy"]).filter((F.col("ring") != F.col("mine")) & cross).groupBy(IMG, F.col("mine").alias("ring")).agg(F.count(F.lit(1)).alias("k"))
    return r.join(n, [IMG, "ring"], "left").select(IMG, "ring", "pieces", "length", (F.coalesce("k", F.lit(0)) % 2 == 1).alias("hole"))


def write_mesh_tables(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    vertices.write.mode("overwrite").parquet(f"{path}/vertex")
    faces.write.mode("overwrite").partitionBy("part").parquet(f"{path}/face")


def read_mesh_tables(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertex"), spark.read.parquet(f"{path}/face")
