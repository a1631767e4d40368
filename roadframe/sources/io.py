"""Sources, sinks and catalog upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from roadframe.operators.memory import last_wins

# fixed values: accepted roles and file types
ROLES = ["material", "line", "noisy", "pair_mask", "pair_photo", "gen_mask", "sidewalk"]
EXTENSIONS = ["png", "jpg", "jpeg", "webp"]
OFF_ROAD_TONE = 30
TILE_KINDS = ["tile", "tileset"]


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images, one row per file (Spark's image source)."""
    return spark.read.format("image").load(path).select("image.*")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def ingest_assets(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """assets(asset_id, role, name, content, ..) -> (accepted with type and hash, rejected with a reason)."""
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    ext = F.when(ext == "", "png").otherwise(ext)
    # fixed values: the texts of the reasons
    d = assets.withColumn("ext", ext).withColumn(
        "reason", F.when(~F.coalesce(F.col("role").isin(ROLES), F.lit(False)), F.concat(F.lit("unknown role: "), "role"))
        .when(~F.col("ext").isin(EXTENSIONS), "use PNG, JPEG or WebP"))
    good = d.filter("reason is null").drop("reason").withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    return good, d.filter("reason is not null").drop("content")


def content_hash(assets: DataFrame) -> DataFrame:
    """SHA-256 of the bytes and how many assets share it. Only the 32-byte hash is shuffled, never the content."""
    h = assets.select("asset_id", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    return h.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min("asset_id").alias("first_id"))


def image_to_pixels(img: DataFrame, id_col: str = "origin") -> DataFrame:
    """Decoded image rows (bytes in B,G,R order) to one row per pixel."""
    def byte(i):
        return F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("int")
    rows = img.select(id_col, "width", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    rows = rows.withColumn("data", F.substring("data", F.col("y") * F.col("width") * F.col("nChannels") + 1,
                                               F.col("width") * F.col("nChannels")))
    px = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    at = F.col("x") * F.col("nChannels")
    g = F.least(F.lit(2), F.col("nChannels"))
    return px.select(id_col, "y", "x", byte(at + F.least(F.lit(3), F.col("nChannels"))).alias("r"),
                     byte(at + g).alias("g"), byte(at + 1).alias("b"))


def array_to_pixels(df: DataFrame, array: str, width: int, keys: list[str]) -> DataFrame:
    """Row-major sample array to pixels."""
    return df.select(*keys, F.posexplode(array).alias("_p", "v")).select(
        *keys, F.floor(F.col("_p") / width).cast("int").alias("y"), (F.col("_p") % width).alias("x"), "v")


def save_artifact(artifacts: DataFrame) -> DataFrame:
    return last_wins(artifacts, ["artifact_id"], ["ts", "path"])


def latest_artifact(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("kind").agg(F.max_by("artifact_id", F.struct("ts", "artifact_id")).alias("artifact_id"),
                                         F.max("ts").alias("ts"))


def artifact(artifacts: DataFrame, artifact_id) -> DataFrame:
    return artifacts.filter(F.col("artifact_id") == artifact_id)


def write_library(patches: DataFrame, path: str) -> None:
    """patches(library_id, patch_id, y, x, r, g, b, on_road): parquet partitioned by library."""
    patches.write.mode("overwrite").partitionBy("library_id").parquet(path)


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """Libraries written before masks existed have a null mask: a pixel is on the road if it is not near black."""
    lum = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    return spark.read.parquet(path).withColumn("on_road", F.coalesce("on_road", lum > OFF_ROAD_TONE))


def manifest_json(rows: DataFrame, keys: list[str], item: list[str], order: list[str], limit_note: str = "items"
                  ) -> DataFrame:
    """One JSON document per key. For keys with few rows (parts and variants of a tile set)."""
    s = F.array_sort(F.collect_list(F.struct(*order, F.struct(*item).alias("_i"))))
    return rows.groupBy(*keys).agg(F.to_json(F.struct(*[F.col(k) for k in keys], F.transform(
        s, lambda e: e["_i"]).alias(limit_note))).alias("manifest"))


def normalise_rects(raw: DataFrame) -> DataFrame:
    """Bridge rectangles from text fields; rows that are not numbers are dropped."""
    num = lambda c: F.expr(f"try_cast({c} AS double)")
    d = raw.select("image_id", "idx", num("cx").alias("cx"), num("cy").alias("cy"),
                   F.greatest(F.lit(4.0), num("length")).alias("length"), num("length").alias("_l"),
                   F.greatest(F.lit(4.0), num("width")).alias("width"), num("width").alias("_w"),
                   F.when(F.col("angle").isNull(), F.lit(0.0)).otherwise(num("angle")).alias("angle"))
    return d.filter("cx is not null and cy is not null and _l is not null and _w is not null and angle is not null"
                    ).drop("_l", "_w")


def normalise_placements(raw: DataFrame) -> DataFrame:
    def num(c, kind, default):
        return F.when(F.col(c).isNull(), F.lit(default).cast(kind)).otherwise(F.expr(f"try_cast({c} AS {kind})"))
    d = raw.select("placement_id", "object_id", "image_id",
                   F.expr("try_cast(cx AS double)").alias("cx"), F.expr("try_cast(cy AS double)").alias("cy"),
                   num("angle", "double", 0.0).alias("angle"), num("nx", "int", 1).alias("nx"),
                   num("ny", "int", 1).alias("ny"), num("gap_x", "double", 0.0).alias("gap_x"),
                   num("gap_y", "double", 0.0).alias("gap_y"))
    d = d.na.drop(subset=["object_id", "cx", "cy", "angle", "nx", "ny", "gap_x", "gap_y"])
    return (d.withColumn("nx", F.greatest(F.lit(1), "nx")).withColumn("ny", F.greatest(F.lit(1), "ny"))
             .withColumn("gap_x", F.greatest(F.lit(0.0), "gap_x")).withColumn("gap_y", F.greatest(F.lit(0.0), "gap_y")))


def prune_superseded(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """artifacts(artifact_id, kind, set_id, ts): (kept, dropped); tile artifacts survive only in the newest set."""
    newest = artifacts.filter("kind = 'tileset'").agg(F.max_by("set_id", F.struct("ts", "artifact_id"))).scalar()
    d = artifacts.withColumn("_old", F.col("kind").isin(TILE_KINDS) & ~F.equal_null(F.col("set_id"), newest))
    return d.filter("not _old").drop("_old"), d.filter("_old").drop("_old")


def add_missing_columns(old: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """Additive schema migration: old rows get the default of every column they lack."""
    d = old.unionByName(new, allowMissingColumns=True)
    return d.select(*[F.coalesce(c, F.lit(defaults[c]).cast(d.schema[c].dataType)).alias(c) if c in defaults
                      else F.col(c) for c in d.columns])
