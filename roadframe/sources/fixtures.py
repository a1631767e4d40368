"""Input tables derived from the shared parquet tables (see FIXTURES.md), built with the DataFrame API."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadframe.operators.common import prefix_sum
from roadframe.operators.raster import PRIME_LEAVES


PIXELS_A_TASK = 1 << 21
ROWS_A_TASK = 1 << 18


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _grid(df: DataFrame, key: str, ny: int, nx: int, yname: str = "y", xname: str = "x") -> DataFrame:
    """Rows x columns for every key, spread over the cluster before the rows are expanded."""
    n = max(1, df.sparkSession.sparkContext.defaultParallelism, df.count() * ny * nx // PIXELS_A_TASK)
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias(yname)).repartition(n, key, yname)
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias(xname))


def _spread(df: DataFrame, key: str, each: int) -> DataFrame:
    """Dealt to enough tasks before each row becomes `each` rows; a small file is one task otherwise."""
    n = df.count() * each // ROWS_A_TASK
    return df.repartition(n, key) if n > 1 else df


def mask_px(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id"))
    y, x, i = F.col("y"), F.col("x"), F.col("image_id")
    hit = ((F.abs(y - 32) <= 3 + i % 4)
           | ((i % 3 == 1) & (F.abs(x - 32) <= 4) & (y <= 32))
           | ((i % 3 == 2) & (F.abs(x - 32) <= 4))
           | ((x * 31 + y * 17 + i * 7) % 997 == 0))
    return _grid(s, "image_id", 64, 64).select(
        F.col("image_id").cast("bigint"), "y", "x", F.when(hit, 255).otherwise(0).alias("v"))


def photo_px(spark, sf, mask: DataFrame | None = None) -> DataFrame:
    m = mask if mask is not None else mask_px(spark, sf)
    x, y, i = F.col("x"), F.col("y"), F.col("image_id")

    def band(off, paint, lift, ax, ay, xy, ai):
        base = lift + ((x * ax + y * ay + (x * y) % xy + i * ai) % 40).cast("int")
        return F.when(F.col("v") == 0, off).when((y == 32) & (x % 12 < 7), paint).otherwise(base)

    return m.select("image_id", "y", "x",
                    band(18, 235, 90, 7, 13, 31, 17).alias("r"),
                    band(18, 232, 88, 11, 5, 29, 13).alias("g"),
                    band(20, 222, 86, 3, 19, 37, 11).alias("b"))


def raster_pair(spark, sf) -> DataFrame:
    p = photo_px(spark, sf)
    mark = (F.col("x") * 5 + F.col("y") * 3 + F.col("image_id")) % 23 == 0
    return p.select("image_id", "y", "x", F.col("r").alias("ra"), F.col("g").alias("ga"), F.col("b").alias("ba"),
                    F.when(mark, F.greatest(F.col("r") - 60, F.lit(0))).otherwise(F.col("r")).alias("rb"),
                    F.col("g").alias("gb"), F.col("b").alias("bb"))


def library_rows(spark, sf) -> DataFrame:
    l = table(spark, sf, "lineitem")
    part = F.when(F.col("l_returnflag") == "A", "junction").when(F.col("l_returnflag") == "N", "open").otherwise("edge")
    return (l.groupBy(part.alias("part"), F.col("l_suppkey").cast("bigint").alias("pair_id"))
             .agg(F.sum("l_quantity").cast("bigint").alias("pixels"), F.count(F.lit(1)).alias("patches"))
             .select("part", "pair_id", "pixels", "patches",
                     (4 + F.col("pair_id") % 29).cast("int").alias("size_px"), F.lit(0.6).alias("confidence0")))


def review_log(spark, sf) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("step_id"), "ts",
        F.when(u % 3 == 0, "junction").when(u % 3 == 1, "edge").otherwise("open").alias("part"),
        (1 + u % 20).alias("pair_id"),
        F.when(e == "purchase", "accepted").when(e == "error", "rejected").when(e == "signup", "flagged")
         .when(e == "click", "adjusted").otherwise("generate").alias("outcome"),
        F.col("props").alias("payload"), "value")


def candidates(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("cand_id"), F.col("c_nationkey").cast("bigint").alias("image_id"),
        ((k * 7919) % 1000).cast("double").alias("x"), ((k * 104729) % 1000).cast("double").alias("y"),
        (F.lit(2.0) + k % 7).alias("hw"))


def polyline(spark, sf) -> DataFrame:
    # points are numbered with a chunked running count, so that one busy street does not fall to a single task
    d = prefix_sum(table(spark, sf, "events"), ["user_id"], "event_id", F.lit(1), "n")
    n = F.col("n").cast("int")
    return d.select(
        F.col("user_id").alias("street_id"), (n - 1).alias("seq"), (F.lit(4.0) * (n - 1)).alias("x"),
        (F.col("value").cast("double") / 10).alias("y"), (F.lit(3.0) + F.col("event_id") % 5).alias("hw"))


def ring(spark, sf) -> DataFrame:
    s = _spread(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ring_id")), "ring_id", 16).select(
        "ring_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("seq"))
    k, i = F.col("seq"), F.col("ring_id")
    return s.select("ring_id", "seq",
                    (32 + 5 * (F.abs((k + 4) % 16 - 8) - 4) + (k * 7 + i) % 3).cast("double").alias("x"),
                    (32 + 5 * (F.abs(k - 8) - 4) + (k * 5 + i) % 3).cast("double").alias("y"))


def lattice_street(spark, sf) -> DataFrame:
    six = F.sequence(F.lit(0), F.lit(5))
    s = (_spread(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("image_id")), "image_id", 60).select("image_id", F.explode(six).alias("i"))
         .withColumn("j", F.explode(six)).withColumn("d", F.explode(F.array(F.lit(0), F.lit(1))))
         .filter("i + 1 - d < 6 and j + d < 6"))
    i, j, d, m = (F.col(c) for c in ("i", "j", "d", "image_id"))
    i1, j1 = i + 1 - d, j + d
    return s.select("image_id", (i * 6 + j + 36 * d).cast("int").alias("street_id"),
                    (i * 100 + (i * 7 + j * 3 + m) % 9).cast("double").alias("x0"),
                    (j * 100 + (i * 3 + j * 5 + m) % 9).cast("double").alias("y0"),
                    (i1 * 100 + (i1 * 7 + j1 * 3 + m) % 9).cast("double").alias("x1"),
                    (j1 * 100 + (i1 * 3 + j1 * 5 + m) % 9).cast("double").alias("y1"),
                    (i * 6 + j).cast("int").alias("node0"), (i1 * 6 + j1).cast("int").alias("node1"))


def placements(spark, sf) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf, "orders").select(
        o.alias("placement_id"), (c % 25).cast("int").alias("object_id"),
        (1 + o % table(spark, sf, "supplier").count()).cast("bigint").alias("image_id"), (c % 64).cast("double").alias("cx"),
        (o % 61).cast("double").alias("cy"), (F.lit(15.0) * (o % 24)).alias("angle"),
        (1 + o % 3).cast("int").alias("nx"), (1 + o % 2).cast("int").alias("ny"),
        (F.lit(0.5) * (o % 3)).alias("gap_x"), (F.lit(0.25) * (o % 5)).alias("gap_y"))


def objects(spark, sf) -> DataFrame:
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(
        n.alias("object_id"), F.col("n_name").alias("name"), (F.lit(1.0) + n % 5).alias("width_m"),
        (F.lit(0.5) + n % 4).alias("depth_m"), F.lit(1.0).alias("scale"), (n % 4).alias("turn"))


def bridges(spark, sf) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        s.alias("image_id"), F.lit(0).alias("idx"), F.lit(32.0).alias("cx"), F.lit(32.0).alias("cy"),
        (F.lit(16.0) + s % 9).alias("length"), F.lit(10.0).alias("width"), (F.lit(15.0) * (s % 12)).alias("angle"))


def mesh_vertex(spark, sf) -> DataFrame:
    six = F.sequence(F.lit(0), F.lit(5))
    s = (_spread(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("mesh_id")), "mesh_id", 36).select("mesh_id", F.explode(six).alias("i"))
         .withColumn("j", F.explode(six)))
    i, j, m = (F.col(c) for c in ("i", "j", "mesh_id"))
    return s.select("mesh_id", (i * 6 + j).cast("int").alias("vid"), (i.cast("double") * 2).alias("x"),
                    (F.lit(0.1) * ((i * j + m) % 5)).alias("h"), (j.cast("double") * 2).alias("z"))


def mesh_quad(spark, sf) -> DataFrame:
    five = F.sequence(F.lit(0), F.lit(4))
    s = (_spread(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("mesh_id")), "mesh_id", 25).select("mesh_id", F.explode(five).alias("i"))
         .withColumn("j", F.explode(five)))
    i, j = F.col("i"), F.col("j")
    rev = (i + j) % 7 == 0
    return s.select("mesh_id", (i * 5 + j).cast("int").alias("fid"), (i * 6 + j).cast("int").alias("a"),
                    F.when(rev, (i + 1) * 6 + j).otherwise(i * 6 + j + 1).cast("int").alias("b"),
                    ((i + 1) * 6 + j + 1).cast("int").alias("c"),
                    F.when(rev, i * 6 + j + 1).when((i * j) % 11 == 10, (i + 1) * 6 + j + 1)
                     .otherwise((i + 1) * 6 + j).cast("int").alias("d"),
                    F.when(j.isin(0, 4), "edge").otherwise("open").alias("part"), (i + 1).cast("int").alias("owner"))


def tree_leaf(spark, sf=None) -> DataFrame:
    rows = [(*leaf, 0.5, "stage A") for leaf in PRIME_LEAVES]
    return spark.createDataFrame(rows, "tree string, path string, route_id string, fallbacks string, "
                                       "confidence double, source string")


def correction_rules(spark, sf=None) -> DataFrame:
    rows = [("material_too_noisy", "grain", -15, False), ("material_too_flat", "grain", 15, False),
            ("lines_not_aligned", "align_lines", 1, False), ("bad_quality", "quality", 1, False),
            ("wrong_library", "", 0, True)]
    return spark.createDataFrame(rows, "correction string, setting string, delta int, rejects_library boolean")


def asset_log(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("asset_id"), F.col("source").alias("role"), F.col("lang").alias("kind"),
        F.col("text").alias("content"), "n_chars")


def step_log(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("step_id"), F.col("role").alias("kind"),
        F.col("text").alias("summary"))


def patch_px(spark, sf) -> DataFrame:
    """Embeddings read as a one-band 8x8 patch library."""
    return (table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "e"))
            .select("vec_id", "label", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"),
                    F.col("e").cast("double").alias("v")))
