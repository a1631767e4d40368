"""Components of discs that come close to each other, found without listing their pairs.

Discs of reach 2^k to 2^(k+1) live on a grid of cells 2^k wide, so those of one cell all meet: a cell is one node.
Nodes then meet by their points: pairs of nodes are settled by their boxes or by their widest discs, small ones by
comparing their points, and the rest are cut into sixteenths, which meet in the next round. A crowd of any size in one
spot is one node, and a disc meets a bounded number of nodes of each size of disc in use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from roadframe.operators.common import connected_components, materialize

IMG = "image_id"
POINT = 2.0 ** -20               # discs of a smaller reach are points; two points are never linked
AS_POINT = -1000                 # the level of points
FULL_DEPTH = 8                   # pieces of 1/65536 of a cell are compared whatever their size
SMALL = 16                       # pieces are compared if that takes at most so many pairs for each of their discs


def _pow2(e: Column) -> Column:
    return F.pow(F.lit(2.0), e)


def _at(depth: int) -> list[Column]:
    """The piece of its cell, cut `depth` times into 4 x 4, that a disc lies in."""
    side = _pow2(F.col("k") - 2 * depth)
    cut = lambda c: F.when(F.col("k") == AS_POINT, F.lit(0)).otherwise(F.floor(F.col(c) / side)).cast("bigint")
    return [cut("x").alias("sx"), cut("y").alias("sy")]


def _stats() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.max_by(F.struct("x", "y", "r"), F.struct(F.col("r"), -F.col("pid"))).alias("wide")]


def _second(df: DataFrame, shared: list[str]) -> DataFrame:
    return df.select(*shared, *[F.col(c).alias(f"{c}_b") for c in df.columns if c not in shared])


def _settle(pairs: DataFrame, scale: float, gap: float, last: bool) -> DataFrame:
    """Pairs of pieces that may touch, each 'linked', to be compared ('small') or to be cut ('split')."""
    apart = lambda lo, hi: F.greatest(F.lit(0.0), F.col(f"{lo}_b") - F.col(hi), F.col(lo) - F.col(f"{hi}_b"))
    limit = (F.col("wide.r") + F.col("wide_b.r")) * scale + gap
    near = F.hypot(F.col("wide.x") - F.col("wide_b.x"), F.col("wide.y") - F.col("wide_b.y")) < limit
    spots = F.expr("x0 = x1 and y0 = y1 and x0_b = x1_b and y0_b = y1_b")
    small = F.lit(last) | (F.col("n") * F.col("n_b") <= SMALL * (F.col("n") + F.col("n_b")))
    return (pairs.filter(F.hypot(apart("x0", "x1"), apart("y0", "y1")) < limit * (1 + 1e-9))
            .withColumn("kind", F.when(near, "linked").when(spots, None).when(small, "small").otherwise("split"))
            .filter("kind is not null").select(IMG, "head", "sx", "sy", "head_b", "sx_b", "sy_b", "kind"))


def _compare(pairs: DataFrame, pts: DataFrame, depth: int, scale: float, gap: float) -> DataFrame:
    p = pts.select(IMG, "head", *_at(depth), "x", "y", "r")
    met = pairs.join(p, [IMG, "head", "sx", "sy"]).join(_second(p, [IMG]), [IMG, "head_b", "sx_b", "sy_b"])
    close = F.hypot(F.col("x") - F.col("x_b"), F.col("y") - F.col("y_b")) < (F.col("r") + F.col("r_b")) * scale + gap
    return met.filter(close).select(IMG, "head", "head_b").distinct()


def disc_nodes(pts: DataFrame, scale: float = 1.0, gap: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Members (image_id, pid, head, lone) and links (image_id, u, v) between heads, for discs pts(image_id, pid, x, y, r).

    Two discs are linked if they are closer than scale * (r + r_b) + gap. A head is the smallest pid of its node; `lone`
    marks points, which share a node with others at their place and are linked only if the node is. Links join the
    nodes as all links between discs would. Discs without a place or a radius are left out.
    """
    reach = F.col("r") * scale + gap / 2
    lone = F.col("k") == AS_POINT
    grid = lambda c: F.when(lone, F.col(c)).otherwise(F.floor(F.col(c) / _pow2(F.col("k")))).cast("double")
    p = (pts.select(IMG, "pid", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "r")])
         .filter("not isnan(x) and not isnan(y) and not isnan(r)")
         .withColumn("k", F.when(reach < POINT, F.lit(AS_POINT)).otherwise(F.floor(F.log2(reach * (1 + 1e-12)))).cast("int"))
         .withColumn("cx", grid("x")).withColumn("cy", grid("y")).withColumn("cr", F.when(lone, F.col("r")).otherwise(F.lit(0.0))))
    cell = [IMG, "k", "cx", "cy", "cr"]
    nodes = materialize(p.groupBy(*cell).agg(F.min("pid").alias("head"), *_stats()))
    p = materialize(p.join(nodes.select(*cell, "head"), cell).select(IMG, "pid", "head", "k", "x", "y", "r"))

    # nodes of one size look for those of their own and smaller sizes in the 3 x 3 squares around them, 4 cells wide each
    square = lambda c: F.floor(F.col(c) / (_pow2(F.col("level")) * 4)).cast("bigint")
    at0 = nodes.select(IMG, "k", "head", F.when(lone, 0).otherwise(F.col("cx")).cast("bigint").alias("sx"),
                       F.when(lone, 0).otherwise(F.col("cy")).cast("bigint").alias("sy"), "n", "x0", "x1", "y0", "y1", "wide")
    used = at0.filter(~lone).select(IMG, F.col("k").alias("level")).distinct()
    guests = at0.join(used, IMG).filter("k <= level").withColumn("qx", square("x0")).withColumn("qy", square("y0"))
    three = F.array(F.lit(-1), F.lit(0), F.lit(1))
    hosts = (at0.filter(~lone).withColumn("level", F.col("k")).withColumn("_dx", F.explode(three)).withColumn("_dy", F.explode(three))
             .withColumn("qx", square("x0") + F.col("_dx")).withColumn("qy", square("y0") + F.col("_dy")).drop("_dx", "_dy"))
    first = guests.join(_second(hosts, [IMG, "level", "qx", "qy"]), [IMG, "level", "qx", "qy"]).filter("k < k_b or head < head_b")
    state, links, depth, heads = materialize(_settle(first, scale, gap, False)), [], 0, [IMG, "head", "head_b"]
    while True:
        kinds = {r["kind"] for r in state.select("kind").distinct().collect()}
        sure = state.filter("kind = 'linked'").select(*heads).distinct()
        rest = state.filter("kind <> 'linked'").join(sure, heads, "left_anti")
        found = sure.unionByName(_compare(rest.filter("kind = 'small'"), p, depth, scale, gap)) if "small" in kinds else sure
        links.append(materialize(found) if "split" in kinds else found)
        if "split" not in kinds:
            break
        cut = rest.filter("kind = 'split'").join(links[-1], heads, "left_anti").drop("kind")
        depth += 1
        kids = (p.select(IMG, "head", *_at(depth), "pid", "x", "y", "r").groupBy(IMG, "head", "sx", "sy").agg(*_stats())
                .withColumnsRenamed({"sx": "nx", "sy": "ny"}).withColumn("sx", F.shiftright("nx", 2)).withColumn("sy", F.shiftright("ny", 2)))
        met = (cut.join(kids, [IMG, "head", "sx", "sy"]).join(_second(kids, [IMG]), [IMG, "head_b", "sx_b", "sy_b"])
               .drop("sx", "sy", "sx_b", "sy_b").withColumnsRenamed({"nx": "sx", "ny": "sy", "nx_b": "sx_b", "ny_b": "sy_b"}))
        state = materialize(_settle(met, scale, gap, depth == FULL_DEPTH))
    found = reduce(DataFrame.unionByName, links).select(IMG, F.col("head").alias("u"), F.col("head_b").alias("v"))
    return p.select(IMG, "pid", "head", lone.alias("lone")), found


def disc_forest(pts: DataFrame, scale: float = 1.0, gap: float = 0.0) -> DataFrame:
    """Edges (image_id, u, v) between pids with the same components as all links of `disc_nodes`; at most one per disc and links."""
    members, links = disc_nodes(pts, scale, gap)
    ends = links.select(IMG, F.col("u").alias("head")).union(links.select(IMG, F.col("v").alias("head"))).distinct()
    stars = members.filter("not lone").unionByName(members.filter("lone").join(ends, [IMG, "head"], "left_semi").select(members.columns))
    return links.unionByName(stars.filter("pid <> head").select(IMG, F.col("head").alias("u"), F.col("pid").alias("v")))


def disc_components(pts: DataFrame, scale: float = 1.0, gap: float = 0.0) -> DataFrame:
    """(image_id, pid, label): the smallest pid of the component. Only nodes go through the labelling, not their discs."""
    members, links = disc_nodes(pts, scale, gap)
    cc = connected_components(links, [IMG]).select(IMG, F.col("id").alias("head"), "label")
    return members.join(cc, [IMG, "head"], "left").select(
        IMG, "pid", F.coalesce("label", F.when(F.col("lone"), F.col("pid")).otherwise(F.col("head"))).alias("label"))
