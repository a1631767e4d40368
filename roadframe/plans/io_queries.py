"""Sources, sinks and catalog upkeep over the shared tables."""

import os
import uuid

from pyspark.sql import functions as F

from roadframe.operators.common import checkpoint_root
from roadframe.plans.registry import query, r6, sql
from roadframe.sources import fixtures as X, io


def assets(spark, sf):
    n = F.regexp_extract("role", r"(\d+)", 1).cast("int")
    ext = F.when(F.col("kind") == "en", "png").when(F.col("kind") == "de", "JPG").when(F.col("kind") == "fr", "webp").otherwise("gif")
    return X.asset_log(spark, sf).select(
        "asset_id", F.coalesce(F.get(F.array(*[F.lit(r) for r in io.ROLES]), n), F.col("role")).alias("role"),
        F.concat(F.lit("asset_"), F.col("asset_id").cast("string"), F.lit("."), ext).alias("name"), "content", "n_chars")


ASSETS = """assets AS (SELECT asset_id, CASE role WHEN 'src0' THEN 'material' WHEN 'src1' THEN 'line' WHEN 'src2' THEN 'noisy' WHEN 'src3' THEN 'pair_mask'
 WHEN 'src4' THEN 'pair_photo' WHEN 'src5' THEN 'gen_mask' WHEN 'src6' THEN 'sidewalk' ELSE role END AS role,
 'asset_' || CAST(asset_id AS VARCHAR) || '.' || CASE kind WHEN 'en' THEN 'png' WHEN 'de' THEN 'JPG' WHEN 'fr' THEN 'webp' ELSE 'gif' END AS name, kind, content, n_chars FROM asset_log)"""


@query("ingest_assets", sql("asset_log", ASSETS + """
SELECT asset_id, role, name, n_chars, sha256(content) AS sha256 FROM assets
WHERE role IN ('material','line','noisy','pair_mask','pair_photo','gen_mask','sidewalk') AND kind <> 'es'"""))
def ingest_assets(spark, sf):
    good, _ = io.ingest_assets(assets(spark, sf))
    return good.select("asset_id", "role", "name", "n_chars", "sha256")


@query("ingest_rejects", sql("asset_log", ASSETS + """
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN role NOT IN ('material','line','noisy','pair_mask','pair_photo','gen_mask','sidewalk')
 THEN 'unknown role: ' || role WHEN kind = 'es' THEN 'use PNG, JPEG or WebP' END AS reason FROM assets) WHERE reason IS NOT NULL GROUP BY reason"""))
def ingest_rejects(spark, sf):
    return io.ingest_assets(assets(spark, sf))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("content_hash", sql("asset_log", "SELECT sha256(content) AS sha256, count(*) AS copies, min(asset_id) AS first_id FROM asset_log GROUP BY 1"))
def content_hash(spark, sf):
    return io.content_hash(X.asset_log(spark, sf))


@query("raster_to_pixels", sql("", """SELECT vec_id, CAST((p.p - p.p % 8)/8 AS INTEGER) AS y, CAST(p.p % 8 AS INTEGER) AS x, round(CAST(embedding[p.p+1] AS DOUBLE), 6) AS v
FROM embeddings CROSS JOIN range(64) AS p(p)"""))
def raster_to_pixels(spark, sf):
    d = io.array_to_pixels(X.table(spark, sf, "embeddings"), "embedding", 8, ["vec_id"])
    return d.withColumn("v", F.round(F.col("v").cast("double"), 6))


def artifacts(spark, sf):
    return X.asset_log(spark, sf).select(
        (F.col("asset_id") % 211).alias("artifact_id"),
        F.when(F.col("kind") == "en", "tile").when(F.col("kind") == "de", "tileset").otherwise("noise").alias("kind"),
        F.col("role").alias("set_id"), F.col("asset_id").alias("ts"), F.col("role").alias("path"))


ART = """art AS (SELECT asset_id % 211 AS artifact_id, CASE kind WHEN 'en' THEN 'tile' WHEN 'de' THEN 'tileset' ELSE 'noise' END AS kind, role AS set_id, asset_id AS ts FROM asset_log),
kept AS (SELECT artifact_id, arg_max(kind, ts) AS kind, arg_max(set_id, ts) AS set_id, max(ts) AS ts FROM art GROUP BY 1)"""


@query("save_artifact", sql("asset_log", ART + " SELECT * FROM kept"))
def save_artifact(spark, sf):
    return io.save_artifact(artifacts(spark, sf)).select("artifact_id", "kind", "set_id", "ts")


@query("latest_artifact", sql("asset_log", ART + " SELECT kind, arg_max(artifact_id, ts) AS artifact_id, max(ts) AS ts FROM kept GROUP BY kind"))
def latest_artifact(spark, sf):
    return io.latest_artifact(io.save_artifact(artifacts(spark, sf)))


@query("artifact", sql("asset_log", ART + " SELECT * FROM kept WHERE artifact_id = 17"))
def artifact(spark, sf):
    return io.artifact(io.save_artifact(artifacts(spark, sf)), 17).select("artifact_id", "kind", "set_id", "ts")


@query("write_library", sql("patch_px", """
p AS (SELECT label AS library_id, vec_id AS patch_id, y, x, CAST(least(255, greatest(0, round_even(1e2 + 6e2*v, 0))) AS INTEGER) AS r FROM patch_px)
SELECT library_id, patch_id, count(*) AS pixels, count(*) FILTER (CASE WHEN patch_id % 2 = 0 THEN x < 4 ELSE r > 30 END) AS on_road, CAST(sum(r) AS BIGINT) AS tone FROM p GROUP BY 1, 2"""))
def write_library(spark, sf):
    r = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.bround(F.col("v") * 600 + 100, 0))).cast("int")
    p = X.patch_px(spark, sf).select(F.col("label").alias("library_id"), F.col("vec_id").alias("patch_id"), "y", "x",
                                     r.alias("r"), r.alias("g"), r.alias("b"),
                                     F.when(F.col("vec_id") % 2 == 0, F.col("x") < 4).alias("on_road"))
    path = os.path.join(checkpoint_root(spark), "library-" + uuid.uuid4().hex)
    io.write_library(p, path)
    return io.read_library(spark, path).groupBy(F.col("library_id").cast(p.schema["library_id"].dataType).alias("library_id"),
                                                "patch_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if("on_road").alias("on_road"), F.sum("r").alias("tone"))


@query("manifest_json", sql("library_rows", """
SELECT pair_id, '{"pair_id":' || CAST(pair_id AS VARCHAR) || ',"libraries":[' ||
 string_agg('{"part":"' || part || '","patches":' || CAST(patches AS VARCHAR) || ',"size_px":' || CAST(size_px AS VARCHAR) || '}', ',' ORDER BY part) || ']}' AS manifest
FROM library_rows GROUP BY pair_id"""))
def manifest_json(spark, sf):
    return io.manifest_json(X.library_rows(spark, sf), ["pair_id"], ["part", "patches", "size_px"], ["part"], "libraries")


@query("normalise_rects", sql("", """
r AS (SELECT o_orderkey AS image_id, 0 AS idx, CASE o_orderstatus WHEN 'F' THEN 'left' ELSE CAST(o_custkey AS VARCHAR) END AS cx, CAST(o_orderkey AS VARCHAR) AS cy,
 CAST(o_custkey % 9 AS VARCHAR) AS length, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE '3.5' END AS width, CASE WHEN o_custkey % 2 = 0 THEN '15' END AS angle FROM orders)
SELECT image_id, idx, try_cast(cx AS DOUBLE) AS cx, try_cast(cy AS DOUBLE) AS cy, greatest(4e0, try_cast(length AS DOUBLE)) AS length,
 greatest(4e0, try_cast(width AS DOUBLE)) AS width, coalesce(try_cast(angle AS DOUBLE), 0e0) AS angle FROM r
WHERE try_cast(cx AS DOUBLE) IS NOT NULL AND width IS NOT NULL"""))
def normalise_rects(spark, sf):
    c = F.col("o_custkey")
    raw = X.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.lit(0).alias("idx"),
        F.when(F.col("o_orderstatus") == "F", "left").otherwise(c.cast("string")).alias("cx"),
        F.col("o_orderkey").cast("string").alias("cy"), (c % 9).cast("string").alias("length"),
        F.when(c % 7 == 0, None).otherwise("3.5").alias("width"), F.when(c % 2 == 0, "15").alias("angle"))
    return io.normalise_rects(raw)


@query("normalise_placements", sql("placements", """
r AS (SELECT placement_id, object_id, image_id, CASE WHEN placement_id % 11 = 0 THEN 'x' ELSE CAST(CAST(cx AS INT) AS VARCHAR) END AS cx, CAST(CAST(cy AS INT) AS VARCHAR) AS cy,
 CAST(nx - 2 AS VARCHAR) AS nx, CASE WHEN ny = 2 THEN NULL ELSE '4' END AS ny, CAST(CAST(gap_x*2 - 1 AS INT) AS VARCHAR) AS gap_x FROM placements)
SELECT placement_id, object_id, image_id, try_cast(cx AS DOUBLE) AS cx, try_cast(cy AS DOUBLE) AS cy, 0e0 AS angle, greatest(1, try_cast(nx AS INTEGER)) AS nx,
 greatest(1, coalesce(try_cast(ny AS INTEGER), 1)) AS ny, greatest(0e0, try_cast(gap_x AS DOUBLE)) AS gap_x, 0e0 AS gap_y FROM r WHERE cx <> 'x'"""))
def normalise_placements(spark, sf):
    s = lambda c: F.col(c).cast("int").cast("string")
    raw = X.placements(spark, sf).select(
        "placement_id", "object_id", "image_id", F.when(F.col("placement_id") % 11 == 0, "x").otherwise(s("cx")).alias("cx"),
        s("cy").alias("cy"), F.lit(None).cast("string").alias("angle"), (F.col("nx") - 2).cast("string").alias("nx"),
        F.when(F.col("ny") == 2, None).otherwise("4").alias("ny"),
        (F.col("gap_x") * 2 - 1).cast("int").cast("string").alias("gap_x"), F.lit(None).cast("string").alias("gap_y"))
    return io.normalise_placements(raw)


@query("prune_superseded", sql("asset_log", """
art AS (SELECT asset_id AS artifact_id, CASE kind WHEN 'en' THEN 'tile' WHEN 'de' THEN 'tileset' ELSE 'noise' END AS kind, role AS set_id FROM asset_log),
newest AS (SELECT arg_max(set_id, artifact_id) AS s FROM art WHERE kind = 'tileset')
SELECT a.artifact_id, a.kind, a.set_id, NOT (a.kind IN ('tile','tileset') AND a.set_id IS DISTINCT FROM n.s) AS kept FROM art a CROSS JOIN newest n"""))
def prune_superseded(spark, sf):
    art = X.asset_log(spark, sf).select(
        F.col("asset_id").alias("artifact_id"),
        F.when(F.col("kind") == "en", "tile").when(F.col("kind") == "de", "tileset").otherwise("noise").alias("kind"),
        F.col("role").alias("set_id"), F.col("asset_id").alias("ts"))
    kept, dropped = io.prune_superseded(art)
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False))).drop("ts")


@query("add_missing_columns", sql("library_rows review_log", """
c AS (SELECT part, pair_id, count(*) FILTER (outcome='rejected') AS rejections, count(*) FILTER (outcome='accepted') AS acceptances FROM review_log GROUP BY 1, 2)
SELECT part, pair_id, pixels, 0 AS rejections, 0 AS acceptances, 0 AS cooldown FROM library_rows
UNION ALL SELECT part, pair_id, NULL, rejections, acceptances, 0 FROM c"""))
def add_missing_columns(spark, sf):
    old = X.library_rows(spark, sf).select("part", "pair_id", "pixels")
    o = F.col("outcome")
    new = X.review_log(spark, sf).groupBy("part", "pair_id").agg(
        F.count_if(o == "rejected").alias("rejections"), F.count_if(o == "accepted").alias("acceptances")).withColumn(
        "cooldown", F.lit(None).cast("int"))
    return io.add_missing_columns(old, new, {"rejections": 0, "acceptances": 0, "cooldown": 0})
