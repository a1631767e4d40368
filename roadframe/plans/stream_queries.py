"""Streaming versions of the log tables, run to the end of the available data and compared with their batch twins."""

from pyspark.sql import functions as F

from roadframe.operators import memory as M
from roadframe.plans.memory_queries import ATTEMPTS, BOTH, attempts
from roadframe.plans.registry import query, sql
from roadframe.plans.stages import _DONE
from roadframe.sources import fixtures as X
from roadframe.streaming import log_streams as S


def log_folder(spark, sf):
    """The review log as a folder of files in step order, as an appending writer leaves it."""
    key = (spark.sparkContext.applicationId, sf, "log_folder")
    if key not in _DONE:
        path = S.new_folder(spark, "log")
        d = X.review_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
        d.repartitionByRange(6, "step_id").sortWithinPartitions("step_id").write.parquet(path)
        _DONE[key] = (path, d.schema)
    return _DONE[key]


def log_stream(spark, sf):
    path, schema = log_folder(spark, sf)
    return S.read_log(spark, path, schema, 3)


@query("stream_replay_index", sql("library_rows review_log", BOTH + " SELECT part, pair_id, confidence, rejections, acceptances FROM idx WHERE rejections + acceptances > 0"))
def stream_replay_index(spark, sf):
    out = S.new_folder(spark, "index")
    library = X.library_rows(spark, sf)
    S.run_available(S.stream_replay_index(log_stream(spark, sf), library), "update", out)
    return S.latest(spark, out, ["part", "pair_id"]).drop("too_late")


@query("stream_situations", sql("review_log", ATTEMPTS + " SELECT key, arg_min(part, step_id) AS features, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, count(*) AS seen FROM attempts GROUP BY key"))
def stream_situations(spark, sf):
    key = M.situation_key(F.lit("material"), {"part": ("text", F.col("part")), "junction": ("bool", F.col("part") == "junction")})
    t = log_stream(spark, sf).filter(F.col("outcome").isin("accepted", "rejected", "flagged")).select(key.alias("key"), F.col("part").alias("features"), "ts", "step_id")
    out = S.new_folder(spark, "situations")
    S.run_available(S.stream_situations(t), "update", out)
    d = S.latest(spark, out, ["key"])
    return d.select("key", "features", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "seen")


@query("stream_summary", sql("review_log", "SELECT part, outcome, count(*) AS n FROM review_log GROUP BY 1, 2"))
def stream_summary(spark, sf):
    out = S.new_folder(spark, "summary")
    S.run_available(S.stream_summary(log_stream(spark, sf)), "update", out)
    return S.latest(spark, out, ["part", "outcome"])


@query("stream_new_pairs", sql("", """r AS (SELECT DISTINCT l_partkey AS mask_id, l_suppkey AS photo_id, l_tax AS scale FROM lineitem), t AS (SELECT DISTINCT l_partkey AS mask_id, l_suppkey AS photo_id, l_discount AS scale FROM lineitem)
SELECT r.mask_id, r.photo_id, r.scale FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.mask_id=r.mask_id AND t.photo_id=r.photo_id AND abs(t.scale-r.scale) < 1e-6)"""))
def stream_new_pairs(spark, sf):
    l = X.table(spark, sf, "lineitem")
    pick = lambda d, c: d.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("request_id"), F.col("l_partkey").alias("mask_id"), F.col("l_suppkey").alias("photo_id"), F.col(c).alias("scale"))
    # the whole table as a stream of one file
    src = spark.readStream.schema(l.schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    out = S.new_folder(spark, "pairs")
    S.append_new_pairs(pick(src, "l_tax"), pick(l, "l_discount"), out)
    return spark.read.parquet(out).drop("batch")


@query("stream_append_log", sql("review_log", "SELECT step_id, part, pair_id, outcome, payload, value FROM review_log"))
def stream_append_log(spark, sf):
    out = S.new_folder(spark, "appended")
    S.append_once(log_stream(spark, sf), out, "step_id")
    return spark.read.parquet(out).select("step_id", "part", "pair_id", "outcome", "payload", "value")
