"""Building blocks reused by many operators.

All of them keep the work per task bounded when one key holds a large part of the rows:

* ordered data is cut into fixed-size sequence chunks, with neighbouring rows copied into the chunk
  (`halo_chunks`) or chunk totals carried forward (`prefix_sum`);
* images are cut into square tiles before anything is grouped per region (`label_regions`);
* graph labelling contracts the edge list, so hot components shrink every round (`connected_components`).
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

CHUNK = 65536
TILE = 256


# ---------------------------------------------------------------- materialised intermediates
def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a fresh local folder only for a local session without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession) -> str:
    """A new folder below the shared one, removed when the application ends."""
    path = os.path.join(checkpoint_root(spark), uuid.uuid4().hex)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared checkpoint folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A shuffle starts with this many partitions, and adaptive execution puts small neighbours together up to this size.
PARTS, PART_BYTES = "2000", "8m"
#: Written pixels compress to less than a byte each: a scan of the usual 128 MB holds tens of millions of them in one task.
SCAN_BYTES = "16m"


def plan_by_measured_sizes(spark: SparkSession) -> None:
    """Leave joins and partition sizes to adaptive execution, which knows the bytes that a shuffle has written.

    Estimates take a written table at its compressed size and an exploded one at the size before: pixel tables of any
    size were broadcast. Settings made by the session's owner stay, but the broadcast limit then holds for measured sizes.
    """
    conf = spark.conf
    limit = conf.get("spark.sql.autoBroadcastJoinThreshold")
    if conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
        conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", limit)
    conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name, value in (("coalescePartitions.initialPartitionNum", PARTS), ("advisoryPartitionSizeInBytes", PART_BYTES)):
        if conf.get(f"spark.sql.adaptive.{name}", None) is None:
            conf.set(f"spark.sql.adaptive.{name}", value)
    if "spark.sql.files.maxPartitionBytes" not in conf.getAll:
        conf.set("spark.sql.files.maxPartitionBytes", SCAN_BYTES)


# ---------------------------------------------------------------- ordered data
def halo_chunks(df: DataFrame, seq: str, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """Assign rows to sequence chunks and copy border rows into the neighbouring chunk.

    A window over (keys, _chunk) that reaches at most `before` rows back and `after` rows on then sees
    everything it needs; filter on `_core` afterwards.
    """
    if before > chunk or after > chunk:
        raise ValueError("chunk must be at least as long as the halo")
    own = F.floor(F.col(seq) / F.lit(chunk)).cast("bigint")
    pos = F.col(seq) - own * chunk
    homes = F.array_compact(F.array(
        own,
        F.when(pos < after, own - 1),
        F.when(pos >= chunk - before, own + 1)))
    return (df.withColumn("_own", own)
              .withColumn("_chunk", F.explode(homes))
              .withColumn("_core", F.col("_chunk") == F.col("_own"))
              .drop("_own"))


def core(df: DataFrame) -> DataFrame:
    return df.filter("_core").drop("_core", "_chunk")


def group_starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Which rows of a frame sorted by `keys` are the first of their group."""
    new = np.arange(len(pdf)) == 0
    for k in keys:
        code = pd.factorize(pdf[k])[0]
        new[1:] |= code[1:] != code[:-1]
    return new


def by_groups(df: DataFrame, keys: list[str], order: str, fn, schema: T.StructType, rows: int = CHUNK) -> DataFrame:
    """Apply `fn` to frames of whole groups, sorted by `keys` and `order`; short groups come many in one frame.

    A call of Python for every short group costs far more than its work. A frame holds some `rows` rows, or one group.
    """
    def run(frames):
        held, n, full = [], 0, rows
        for f in frames:
            held.append(f)
            n += len(f)
            if n < full:
                continue
            t = pd.concat(held, ignore_index=True)
            cut = int(np.flatnonzero(group_starts(t, keys))[-1])
            if cut:
                yield fn(t.iloc[:cut])
            held, n = [t.iloc[cut:]], len(t) - cut
            full = max(rows, 2 * n)
        if n:
            yield fn(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(run, schema)


def position_chunks(df: DataFrame, order: list[str], chunk: int = CHUNK) -> tuple[DataFrame, int]:
    """Cut rows into chunks of at most `chunk` neighbours in `order`: adds `_chunk` (0, 1, ..), returns the number of chunks.

    Chunks go by position, so sparse ids cut as evenly as dense ones. Rows are range-partitioned and sorted, a row's
    place in its range is its position there, and one number per range (collected) makes the chunk numbers run on.
    """
    spark = df.sparkSession
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_at", F.monotonically_increasing_id()))
    range_of, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(range_of.alias("_range")).agg(F.max(place).alias("top")).orderBy("_range").collect()
    first, total = [], 0
    for r in sizes:
        first.append((r["_range"], total))
        total += r["top"] // chunk + 1
    starts = spark.createDataFrame(first, "_range long, _first long")
    out = placed.withColumn("_range", range_of).join(F.broadcast(starts), "_range")
    return out.withColumn("_chunk", F.col("_first") + F.floor(place / F.lit(chunk)).cast("bigint")).drop("_range", "_first", "_at"), total


def merge_rounds(pieces: DataFrame, keys: list[str], chunks: int, fan: int, merge) -> DataFrame:
    """One value per key from pieces(keys.., _chunk, piece) in chunk order; `merge` maps an array of pieces to one piece.

    Each round joins up to `fan` neighbours, so no row ever holds more than that many pieces, however many a key has.
    """
    while True:
        chunks = -(-chunks // fan)
        grouped = pieces.withColumn("_to", F.floor(F.col("_chunk") / F.lit(fan)).cast("bigint")).groupBy(*keys, "_to").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "piece"))), lambda p: p["piece"]).alias("_ps"))
        pieces = grouped.select(*keys, F.col("_to").alias("_chunk"), merge(F.col("_ps")).alias("piece"))
        if chunks <= 1:
            return pieces.drop("_chunk")


def _chunked(df: DataFrame, keys: list[str], seq: str, chunk: int, by_position: bool) -> DataFrame:
    if by_position:
        return position_chunks(df, [*keys, seq], chunk)[0]
    return df.withColumn("_chunk", F.floor(F.col(seq) / F.lit(chunk)).cast("bigint"))


def prefix_sum(df: DataFrame, keys: list[str], seq: str, value: Column, out: str,
               chunk: int = CHUNK, by_position: bool = False) -> DataFrame:
    """Running sum by `seq`, in two levels so that no single task orders a whole hot key.

    Chunks go by the value of `seq`, which suits dense positions; `by_position` is for sparse ids.
    """
    d = _chunked(df.withColumn("_v", value), keys, seq, chunk, by_position)
    totals = d.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_t"))
    carry = totals.select(
        *keys, "_chunk",
        F.coalesce(F.sum("_t").over(W.partitionBy(*keys).orderBy("_chunk")
                                    .rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_carry"))
    inner = d.withColumn("_s", F.sum("_v").over(W.partitionBy(*keys, "_chunk").orderBy(seq)
                                                .rowsBetween(W.unboundedPreceding, 0)))
    return (inner.join(carry, [*keys, "_chunk"])
                 .withColumn(out, F.col("_s") + F.col("_carry"))
                 .drop("_v", "_s", "_carry", "_chunk"))


def running_max(df: DataFrame, keys: list[str], seq: str, value: Column, out: str,
                chunk: int = CHUNK, by_position: bool = False) -> DataFrame:
    d = _chunked(df.withColumn("_v", value), keys, seq, chunk, by_position)
    tops = d.groupBy(*keys, "_chunk").agg(F.max("_v").alias("_t"))
    carry = tops.select(
        *keys, "_chunk",
        F.max("_t").over(W.partitionBy(*keys).orderBy("_chunk")
                         .rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    inner = d.withColumn("_s", F.max("_v").over(W.partitionBy(*keys, "_chunk").orderBy(seq)
                                                .rowsBetween(W.unboundedPreceding, 0)))
    return (inner.join(carry, [*keys, "_chunk"])
                 .withColumn(out, F.greatest("_s", "_carry"))
                 .drop("_v", "_s", "_carry", "_chunk"))


def _splitters_below(splitters: Column, v: Column, n: int) -> Column:
    """How many of at most `n` ascending splitters are smaller than v, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.size(splitters).alias("hi"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.get(splitters, mid) < v
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(
            F.when(right, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), start, halve, lambda s: s["lo"].cast("bigint"))


def split_ranges(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Cut the distinct values `_v` of every range (keys, _r) at approximate quantiles: adds `_k`, the bucket.

    The quantile sketch is off by at most a quarter of a bucket, so no bucket holds more than one and a half times the
    mean of its range, wherever the values lie.
    """
    at = [k / buckets for k in range(1, buckets)]
    cuts = rows.groupBy(*keys, "_r").agg(F.array_distinct(F.percentile_approx("_v", at, 4 * buckets)).alias("_s"))
    return rows.join(cuts, [*keys, "_r"]).withColumn("_k", _splitters_below(F.col("_s"), F.col("_v"), buckets)).drop("_s")


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    buckets: int = 256, most: int = 1 << 18) -> DataFrame:
    """Linear-interpolated quantiles of a continuous column, per key.

    Equal values are counted first. While a range that holds a wanted rank has more than `most` distinct values, it is
    cut at splitters and only the buckets with a wanted rank go on; what is left is ordered. No task ever orders more
    than `most` values, however many rows a key has and however far its values spread.
    """
    rows = materialize(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")).withColumn("_r", F.lit(0).cast("bigint")))
    want = F.array(*[F.struct(F.lit(name).alias("q"), F.lit(p).alias("p")) for name, p in probs.items()])
    wants = (rows.groupBy(*keys, "_r").agg(F.sum("_n").alias("_total")).withColumn("_w", F.explode(want))
                 .withColumn("_pos", F.col("_w.p") * (F.col("_total") - 1)).withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
                 .select(*keys, "_r", F.col("_w.q").alias("_q"), "_pos", "_side",
                         F.when(F.col("_side") == 0, F.floor("_pos")).otherwise(F.ceil("_pos")).cast("bigint").alias("_rank")))
    held = lambda end, n: (F.col("_rank") < F.col(end)) & (F.col("_rank") >= F.col(end) - F.col(n))
    while (rows.groupBy(*keys, "_r").count().agg(F.max("count")).first()[0] or 0) > most:
        cut = split_ranges(rows, keys, buckets)
        tops = cut.groupBy(*keys, "_r", "_k").agg(F.sum("_n").alias("_bn")).withColumn(
            "_end", F.sum("_bn").over(W.partitionBy(*keys, "_r").orderBy("_k")))
        wants = materialize(wants.join(tops, [*keys, "_r"]).filter(held("_end", "_bn")).select(
            *keys, (F.col("_r") * buckets + F.col("_k")).alias("_r"), "_q", "_pos", "_side", (F.col("_rank") - (F.col("_end") - F.col("_bn"))).alias("_rank")))
        rows = materialize(cut.select(*keys, "_v", "_n", (F.col("_r") * buckets + F.col("_k")).alias("_r")).join(
            wants.select(*keys, "_r").distinct(), [*keys, "_r"], "left_semi"))
    cum = rows.withColumn("_c", F.sum("_n").over(W.partitionBy(*keys, "_r").orderBy("_v")))
    hit = wants.join(cum, [*keys, "_r"]).filter(held("_c", "_n"))
    low, high = [F.max(F.when(F.col("_side") == s, F.col("_v"))) for s in (0, 1)]
    per_q = hit.groupBy(*keys, "_q").agg(low.alias("_l"), high.alias("_h"), F.max(F.col("_pos") - F.floor("_pos")).alias("_f")).withColumn(
        "_val", F.col("_l") + (F.col("_h") - F.col("_l")) * F.col("_f"))
    return per_q.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_q") == name, F.col("_val"))).alias(name) for name in probs])


# ---------------------------------------------------------------- pixel neighbourhoods
N4 = [(-1, 0), (1, 0), (0, -1), (0, 1)]
N8 = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def scatter_offsets(df: DataFrame, offsets, y: str = "y", x: str = "x", tag: str | None = None) -> DataFrame:
    """Each pixel is sent to the cells it is a neighbour of (cell = pixel - offset); `tag` keeps the offset index."""
    cells = F.array(*[F.struct((F.col(y) - dy).alias("y"), (F.col(x) - dx).alias("x"), F.lit(i).alias("i"))
                      for i, (dy, dx) in enumerate(offsets)])
    rest = [c for c in df.columns if c not in (y, x)]
    d = df.withColumn("_c", F.explode(cells)).select(
        *rest, F.col("_c.y").alias(y), F.col("_c.x").alias(x), *([F.col("_c.i").alias(tag)] if tag else []))
    return d


# ---------------------------------------------------------------- graph labels
def connected_components(edges: DataFrame, key: list[str]) -> DataFrame:
    """Label every id that occurs in `edges(key.., u, v)` with the smallest id of its component.

    Each round every node adopts its smallest neighbour in a hashed order, pointers are halved twice, and the edge
    list is rewritten to the adopted nodes without duplicates or loops. Hashing keeps adoption chains short even on
    long paths with ordered ids, so the list shrinks geometrically. The smallest id per component is taken at the end.
    """
    e = materialize(edges.select(*key, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                    .filter("u <> v").distinct())
    labels = None
    order = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    while not e.isEmpty():
        both = e.unionByName(e.select(*key, F.col("v").alias("u"), F.col("u").alias("v")))
        p = both.groupBy(*key, "u").agg(F.min(order("v")).alias("m")).select(*key, "u", F.least(order("u"), F.col("m"))["v"].alias("p"))
        for _ in range(2):
            up = p.select(*key, F.col("u").alias("p"), F.col("p").alias("pp"))
            p = p.join(up, [*key, "p"]).select(*key, "u", F.col("pp").alias("p"))
        p = materialize(p)
        if labels is None:
            labels = p.select(*key, F.col("u").alias("id"), F.col("p").alias("label"))
        else:
            step = p.select(*key, F.col("u").alias("label"), F.col("p").alias("np"))
            labels = materialize(labels.join(step, [*key, "label"], "left").select(
                *key, "id", F.coalesce("np", "label").alias("label")))
        pu = p.select(*key, "u", F.col("p").alias("nu"))
        pv = p.select(*key, F.col("u").alias("v"), F.col("p").alias("nv"))
        e = materialize(
            e.join(pu, [*key, "u"]).join(pv, [*key, "v"])
             .select(*key, F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"))
             .filter("u <> v").distinct())
    if labels is None:
        return e.select(*key, F.col("u").alias("id"), F.col("v").alias("label"))
    low = labels.groupBy(*key, "label").agg(F.min("id").alias("_low"))
    return labels.join(low, [*key, "label"]).select(*key, "id", F.col("_low").alias("label"))


# ---------------------------------------------------------------- region labels of pixel sets
def pixel_code(y, x) -> Column:
    """Raster-order code of a pixel, good up to 2^31 columns."""
    return F.col(y).cast("bigint") * F.lit(1 << 31) + F.col(x).cast("bigint")


def _tile_labels(eight: bool):
    reach = 1 if eight else 0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"], kind="stable")
        y = pdf["y"].to_numpy(np.int64)
        x = pdf["x"].to_numpy(np.int64)
        start = np.ones(len(y), bool)
        start[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
        run_of = np.cumsum(start) - 1
        first = np.flatnonzero(start)
        last = np.append(first[1:], len(y)) - 1
        ry, x0, x1 = y[first], x[first], x[last]
        parent = np.arange(len(first))

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        below = 0
        for i in range(len(first)):
            # runs of the previous row that overlap this one; the cursor only moves forward
            while below < i and (ry[below] < ry[i] - 1 or (ry[below] == ry[i] - 1 and x1[below] < x0[i] - reach)):
                below += 1
            j = below
            while j < i and ry[j] == ry[i] - 1 and x0[j] <= x1[i] + reach:
                a, b = find(i), find(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                j += 1
        root = np.array([find(i) for i in range(len(first))], dtype=np.int64)
        code = ry[root] * (1 << 31) + x0[root]
        return pdf.assign(label=code[run_of])[[c for c in pdf.columns if c not in ("_ty", "_tx")] + ["label"]]

    return run


def label_regions(px: DataFrame, eight: bool = False, tile: int = TILE, image: str = "image_id") -> DataFrame:
    """Connected regions of a sparse pixel set `(image_id, y, x)`: adds `label`, the raster code of the first pixel.

    Regions are found inside tiles of bounded size, then tiles are stitched through their border pixels.
    """
    src = px.select(image, "y", "x")
    tiled = src.withColumn("_ty", F.floor(F.col("y") / tile).cast("int")).withColumn(
        "_tx", F.floor(F.col("x") / tile).cast("int"))
    schema = T.StructType([src.schema[image], T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()),
                           T.StructField("label", T.LongType())])
    local = materialize(tiled.groupBy(image, "_ty", "_tx").applyInPandas(_tile_labels(eight), schema))
    # pairs of touching pixels on two sides of a tile border
    m, last = F.lit(tile), tile - 1
    half = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    rim = local.filter((F.pmod("y", m).isin(0, last)) | (F.pmod("x", m).isin(0, last)))
    to = F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in half])
    ask = rim.withColumn("_c", F.explode(to)).filter(
        (F.floor(F.col("y") / tile) != F.floor(F.col("_c.y") / tile))
        | (F.floor(F.col("x") / tile) != F.floor(F.col("_c.x") / tile))).select(
        image, F.col("_c.y").alias("y"), F.col("_c.x").alias("x"), F.col("label").alias("u"))
    edges = ask.join(rim.select(image, "y", "x", F.col("label").alias("v")), [image, "y", "x"]).select(
        image, "u", "v")
    cc = connected_components(edges, [image])
    return local.join(cc.select(image, F.col("id").alias("label"), F.col("label").alias("_root")),
                      [image, "label"], "left").select(
        image, "y", "x", F.coalesce("_root", "label").alias("label"))


# ---------------------------------------------------------------- lines of pixels as arrays
def let(value: Column, body) -> Column:
    """Bind an expression once for use inside lambdas; the optimizer would otherwise copy it into every call."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(px: DataFrame, line: list[str], pos: str, fields: list[str]) -> DataFrame:
    """One row per raster line with its samples in order. A line is at most one image side long."""
    return px.groupBy(*line).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), *[F.col(f) for f in fields]))).alias("a"))


# ---------------------------------------------------------------- tiles with a halo
def tile_halo(px: DataFrame, halo: int, tile: int, image: str = "image_id") -> DataFrame:
    """Copy each pixel to every tile whose halo it lies in: adds `_ty`, `_tx`. Tiles bound the size of a group."""
    span = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int"))
    return px.withColumn("_ty", F.explode(span("y"))).withColumn("_tx", F.explode(span("x")))


def _wrapped(px: DataFrame, halo: int, tile: int, image: str) -> DataFrame:
    """Pixels with copies shifted by one image side, as far as they are seen from inside, then tiled."""
    near = lambda c, n: F.filter(F.array(F.col(c) - F.col(n), F.col(c), F.col(c) + F.col(n)),
                                 lambda p: (p >= -halo) & (p < F.col(n) + halo))
    d = px.withColumn("_py", F.explode(near("y", "_h"))).withColumn("_px", F.explode(near("x", "_w")))
    return tile_halo(d.drop("y", "x").withColumnsRenamed({"_py": "y", "_px": "x"}), halo, tile, image)


def stencil(px: DataFrame, fields: list[str], halo: int, fn, outs: list[str], tile: int = TILE,
            image: str = "image_id", wrap: bool = False) -> DataFrame:
    """Apply an array function to dense images, tile by tile, in one shuffle.

    `fn` maps {field: core tile extended by `halo` on all sides} to {out: core tile}. Beyond the image border the
    extension is mirrored, or taken from the opposite side with `wrap` (halo at most one image side).
    """
    key = px.schema[image]
    dims = px.groupBy(image).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    d = tile_halo(px.select(image, "y", "x", *[F.col(f).cast("double").alias(f) for f in fields]).join(dims, image), halo, tile, image) if not wrap else (
        _wrapped(px.select(image, "y", "x", *[F.col(f).cast("double").alias(f) for f in fields]).join(dims, image), halo, tile, image))
    d = d.filter("_ty >= 0 and _tx >= 0").filter((F.col("_ty") * tile < F.col("_h")) & (F.col("_tx") * tile < F.col("_w")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, tx, h, w = (int(pdf[c].iat[0]) for c in ("_ty", "_tx", "_h", "_w"))
        cy, cx = ty * tile, tx * tile
        ch, cw = min(h, cy + tile) - cy, min(w, cx + tile) - cx
        y0, x0 = max(0, cy - halo), max(0, cx - halo)
        y1, x1 = min(h, cy + ch + halo), min(w, cx + cw + halo)
        if wrap:
            y0, x0, y1, x1 = cy - halo, cx - halo, cy + ch + halo, cx + cw + halo
        pad = ((halo - (cy - y0), halo - (y1 - cy - ch)), (halo - (cx - x0), halo - (x1 - cx - cw)))
        yy, xx = pdf["y"].to_numpy() - y0, pdf["x"].to_numpy() - x0
        arrays = {}
        for f in fields:
            a = np.zeros((y1 - y0, x1 - x0))
            a[yy, xx] = pdf[f].to_numpy()
            arrays[f] = np.pad(a, pad, mode="symmetric") if halo else a
        res = fn(arrays)
        gy, gx = np.mgrid[cy:cy + ch, cx:cx + cw].astype(np.int32)
        return pd.DataFrame({image: pdf[image].iat[0], "y": gy.ravel(), "x": gx.ravel(), **{o: res[o].ravel() for o in outs}})

    schema = T.StructType([key, T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()),
                           *[T.StructField(o, T.DoubleType()) for o in outs]])
    return d.groupBy(image, "_ty", "_tx").applyInPandas(run, schema)


def weigh(a: np.ndarray, w) -> np.ndarray:
    """Separable weighting of an extended tile; the result is smaller by the kernel radius on every side."""
    n = a.shape[0] - len(w) + 1
    a = sum(wk * a[k:k + n] for k, wk in enumerate(w))
    m = a.shape[1] - len(w) + 1
    return sum(wk * a[:, k:k + m] for k, wk in enumerate(w))


def blur(px: DataFrame, fields: list[str], sigma: float, mode: str = "reflect", key: str | None = None
         ) -> DataFrame:
    """Separable Gaussian over dense images; returns key, y, x and the blurred fields."""
    from roadframe.functions.kernels import gaussian_weights
    w = gaussian_weights(sigma)
    return stencil(px, fields, len(w) // 2, lambda a: {f: weigh(a[f], w) for f in fields}, fields,
                   image=key or "image_id", wrap=mode == "wrap")
