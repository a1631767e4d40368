"""Helpers shared by the text operators: written intermediates, ordered positions, word patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from roadframe.operators.common import scratch_path

#: ASCII white space: everything that the word pattern [^\x20\x09-\x0D]+ leaves out.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, free: bool = False) -> DataFrame:
    """Write once below spark.checkpoint.dir and read back: later uses see one fixed result and survive lost executors.

    free: the shuffle files of the plan go as soon as the table is written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    try:
        if free:
            spark.conf.set(name, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free and was is None:
            spark.conf.unset(name)
        elif free:
            spark.conf.set(name, was)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the matches of [^\\x20\\x09-\\x0D]+; null and blank texts give an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on columns that may be null; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_r_{k}" for k in keys])


def ordered(df: DataFrame, keys: list[str], order: list[str], index: str, sums: dict[str, str] | None = None) -> DataFrame:
    """Add the 0-based position within `keys` by `order`, and running sums of the rows before.

    sums: new column -> column summed. A key may hold any share of the rows: rows are cut into sorted ranges first,
    positions run inside a range, and only one row per range and key is carried over the ranges. Rows equal in `order`
    stand in an arbitrary but fixed order.
    """
    sums = sums or {}
    cut = written(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy("_part", *keys).orderBy(*order)
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    rows = cut.select("*", (F.row_number().over(inside) - 1).cast("bigint").alias(index),
                      *[F.coalesce(F.sum(c).over(before), zero).alias(n) for n, c in sums.items()])
    totals = cut.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    carry = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_part", *keys, F.coalesce(F.sum("_n").over(carry), zero).alias("_c"),
                           *[F.coalesce(F.sum(f"_t_{n}").over(carry), zero).alias(f"_c_{n}") for n in sums])
    out = null_safe(rows, totals, ["_part", *keys])
    return out.select(*df.columns, (F.col(index) + F.col("_c")).alias(index),
                      *[(F.col(n) + F.col(f"_c_{n}")).alias(n) for n in sums])
