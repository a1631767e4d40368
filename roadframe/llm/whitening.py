"""Whitening of embeddings by a bit-sliced scatter matrix.

Entries become integers, shifted by the smallest entry of their dimension so that few bits are left. Per block of rows
every bit plane of every dimension is packed into 64-bit words; the cross-product of two dimensions is the sum over
plane pairs of 2^(p+q) times the population count of the AND of their words. All sums are integers, so partial results
of any order add up to the same matrix, which is centred as n*G - S*S' before the one division ahead of `eigh`.

The driver holds statistics of the dimensions only (their number squared), never rows.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from roadframe.llm.common import written

SCALE, OFFSET = 64, 1_000_000
#: |SCALE * entry| below this bound; larger entries have no exact long with room for sums and are an error.
BOUND = 1 << 52
#: Rows whose bit planes are packed together.
BLOCK = 16384
LOW = (1 << 32) - 1


def to_whole(values: np.ndarray) -> np.ndarray:
    """floor(64 * c) + 1000000 of finite entries."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= BOUND:
        raise ValueError("an entry is too large to become a whole number exactly")
    return scaled.astype(np.int64) + OFFSET


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector of the rows whose vector is there, not empty, and holds finite entries only."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    v = F.col(vector_col)
    return rows.filter(v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(F.exists(v, bad), F.lit(True))).select(
        F.col(id_col).alias("vec_id"), v.cast("array<double>").alias("vector"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != width * len(column) or (len(column) and (np.diff(column.offsets.to_numpy()) != width).any()):
        raise ValueError("vectors of different lengths cannot be whitened together")
    return to_whole(flat).reshape(-1, width)


def dimension_stats(vectors: DataFrame) -> list:
    """Rows (dimension, n, total, low, high) over all vectors; totals are whole numbers."""
    big = F.abs(F.col("c") * SCALE) >= BOUND
    x = F.when(big, 0).otherwise(F.floor(F.col("c") * SCALE) + OFFSET).cast("bigint")
    flat = vectors.select(F.posexplode("vector").alias("k", "c")).select("k", x.alias("x"), big.alias("big"))
    got = flat.groupBy("k").agg(F.count("x").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("total"), F.min("x").alias("low"),
                                F.max("x").alias("high"), F.max("big").alias("big")).orderBy("k").collect()
    if any(r["big"] for r in got):
        raise ValueError("an entry is too large to become a whole number exactly")
    if len({r["n"] for r in got}) > 1:
        raise ValueError("vectors of different lengths cannot be whitened together")
    return got


def bit_planes(x: np.ndarray, bits: int) -> np.ndarray:
    """(dimension, plane, words) of non-negative whole numbers; rows are padded with zeros to whole words."""
    rows = -(-len(x) // 64) * 64
    padded = np.zeros((x.shape[1], rows), np.uint64)
    padded[:, :len(x)] = x.T
    planes = [np.packbits((padded >> np.uint64(p)).astype(np.uint8) & 1, axis=1) for p in range(bits)]
    return np.ascontiguousarray(np.stack(planes, axis=1)).view(np.uint64)


def scatter(x: np.ndarray, bits: int) -> list[list[int]]:
    """Exact cross-products of the dimensions (upper triangle, by dimension) from AND-popcounts of bit planes."""
    planes = bit_planes(x, bits)
    out = []
    for d in range(planes.shape[0]):
        total = [0] * (planes.shape[0] - d)
        for p in range(bits):
            counts = np.bitwise_count(planes[d, p] & planes[d:]).sum(axis=2, dtype=np.int64)
            for q in range(bits):
                total = [t + (int(c) << (p + q)) for t, c in zip(total, counts[:, q])] if bits > 20 else total
            if bits <= 20:  # a block's sum fits 63 bits: 2^14 rows times 2^40
                part = (counts << np.arange(bits)).sum(axis=1) << p
                total = part if p == 0 else total + part
        out.append([int(t) for t in total])
    return out


def cross_products(vectors: DataFrame, low: list[int], bits: int, block: int = BLOCK) -> dict[tuple[int, int], int]:
    """Sum over all vectors of (x_i - low_i)(x_j - low_j) for i <= j; blocks are added up by Spark."""
    width = len(low)
    limbs = max(1, -(-(2 * bits + 34) // 32))
    schema = "i int, j int, " + ", ".join(f"l{k} bigint" for k in range(limbs))
    shift = np.array(low, np.int64)

    def run(batches):
        total = [[0] * (width - d) for d in range(width)]
        seen = False
        for b in batches:
            x = _matrix(b.column(0), width) - shift
            for at in range(0, len(x), block):
                seen = True
                for mine, new in zip(total, scatter(x[at:at + block], bits)):
                    mine[:] = [s + t for s, t in zip(mine, new)]
        if not seen:
            return
        flat = [v for mine in total for v in mine]
        i, j = np.triu_indices(width)
        cols = [pa.array(i, pa.int32()), pa.array(j, pa.int32())]
        cols += [pa.array([(v >> (32 * k)) & LOW if k + 1 < limbs else v >> (32 * k) for v in flat], pa.int64()) for k in range(limbs)]
        yield pa.RecordBatch.from_arrays(cols, names=["i", "j", *(f"l{k}" for k in range(limbs))])

    sums = vectors.select("vector").mapInArrow(run, schema).groupBy("i", "j").agg(
        *[F.sum(F.col(f"l{k}").cast("decimal(20,0)")).alias(f"l{k}") for k in range(limbs)])
    return {(r["i"], r["j"]): sum(int(r[f"l{k}"]) << (32 * k) for k in range(limbs)) for r in sums.collect()}


def components(n: int, totals: list[int], products: dict, low: list[int], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors as columns, eigenvalues, explained shares), by falling eigenvalue. Directions without variance are left out."""
    width = len(totals)
    shifted = [t - n * s for t, s in zip(totals, low)]
    v = np.zeros((width, width))
    for (i, j), g in products.items():
        v[i, j] = v[j, i] = (n * g - shifted[i] * shifted[j]) / (n * n)  # whole numbers up to the one division
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = math.fsum(v[k, k] for k in range(width))
    keep = int((values > trace * 1e-13 * width).sum()) if trace > 0 else 0
    keep = min(keep, most)
    return vectors[:, :keep], values[:keep], values[:keep] / trace if keep else values[:0]


def _projected(vectors: DataFrame, n: int, totals: list[int], base: np.ndarray, values: np.ndarray, reach: int, wide: bool) -> DataFrame:
    """vec_id, deviation, whitened (array by component)."""
    width = len(totals)
    kind, held = (T.DecimalType(38, 0), pa.decimal128(38, 0)) if wide else (T.LongType(), pa.int64())
    schema = T.StructType([vectors.schema["vec_id"], T.StructField("deviation", kind), T.StructField("w", T.ArrayType(T.DoubleType()))])
    weights = base / np.sqrt(values)
    small = not wide and width * (n * reach) ** 2 < 1 << 63

    def run(batches):
        mean = [t // n for t in totals]  # n*x - S as n*(x - m) - (S - n*m): both parts are small
        rest = np.array([t - n * m for t, m in zip(totals, mean)], np.int64)
        mean = np.array(mean, np.int64)
        for b in batches:
            x = _matrix(b.column(1), width) - mean
            if small:
                c = n * x - rest
                deviation = (c * c).sum(axis=1)
            else:  # the same in unbounded whole numbers
                deviation = [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest)) for row in x]
                if not wide and any(d >= 1 << 63 for d in deviation):
                    raise OverflowError("a deviation does not fit a long; ask for wide ones")
                deviation = [Decimal(d) for d in deviation] if wide else deviation
            w = (x - rest / n) @ weights
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(deviation, held), pa.array(list(w), pa.list_(pa.float64()))], names=schema.names)

    return vectors.select("vec_id", "vector").mapInArrow(run, schema)


def _identity_error(table: DataFrame, n: int, count: int) -> float:
    """Largest entry of |covariance of the whitened columns - identity|; columns are centred, then multiplied."""
    entry = lambda k: F.element_at("w", k + 1)
    mean = table.agg(*[(F.sum(entry(k)) / n).alias(f"m{k}") for k in range(count)]).first()
    centre = np.array([mean[k] for k in range(count)])

    def run(batches):
        total = np.zeros((count, count))
        for b in batches:
            w = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, count) - centre
            total += w.T @ w
        i, j = np.triu_indices(count)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    sums = table.select("w").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg((F.sum("v") / n).alias("v"))
    return sums.agg(F.max(F.abs(F.col("v") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 32, wide: bool = False) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Dropped: vectors that are null, empty or hold null or non-finite entries. The fit list is all others, repeated ones
    too; every row gives its rows, and null ids stay null. At most `most` components; directions without variance
    (fewer vectors than dimensions, constant dimensions) are no components, so one vector alone, equal vectors and an
    empty table give no rows. A deviation beyond a long is an error unless `wide` asks for decimal(38, 0). Vectors of different lengths, and entries of 2^46 or more, are errors. Eigenvectors of
    equal eigenvalues are any orthonormal basis of their space. Other columns are ignored, so their names cannot clash.
    """
    vectors = usable(rows, id_col, vector_col)
    schema = T.StructType([T.StructField("vec_id", rows.schema[id_col].dataType), T.StructField("component", T.IntegerType()),
                           T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0) if wide else T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]])
    nothing = rows.sparkSession.createDataFrame([], schema)
    stats = dimension_stats(vectors)
    if not stats:
        return nothing
    n, totals, low = stats[0]["n"], [int(r["total"]) for r in stats], [r["low"] for r in stats]
    reach = max(r["high"] - r["low"] for r in stats)
    if not reach:
        return nothing
    products = cross_products(vectors, low, reach.bit_length())
    base, values, explained = components(n, totals, products, low, most)
    if not len(values):
        return nothing
    table = written(_projected(vectors, n, totals, base, values, reach, wide))
    error = _identity_error(table, n, len(values))
    shares = F.array(*[F.lit(float(e)) for e in explained])
    return table.select("vec_id", "deviation", F.posexplode("w").alias("_k", "whitened")).select(
        "vec_id", (F.col("_k") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("_k") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))
