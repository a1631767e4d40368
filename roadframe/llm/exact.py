"""Exact dedup by skew-safe combining.

Copies are combined in three stages that each compare the full content next to its digest: inside a partition before
anything moves (the map side of the first aggregation), then per salted digest group, where the salt is the partition
a row came from, and last over the few salt winners of a digest. A text held by a third of all rows thus reaches the
last stage as at most `salts` rows. Documents then look their group up by digest, with ids and counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from roadframe.llm.common import ascii_lower, null_safe, written


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The largest id of a group
    stays. A null id is smaller than any other: such a document stays only in a group without other ids. Rows that
    repeat an id with the same text all count in group_size, and exactly one of them is kept. Other columns of
    `docs` are ignored, so their names cannot clash. `digest` only groups the work: texts with equal digests are
    still told apart by content.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("_norm"), F.spark_partition_id().alias("_from")).select(
        "doc_id", "_norm", digest(F.col("_norm")).alias("_digest"), (F.col("_from") % salts).alias("_salt"))
    salted = rows.groupBy("_digest", "_salt", "_norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    merged = salted.groupBy("_digest", "_norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = written(merged.select("_digest", "keep_id", "group_size", sha256(F.col("_norm")).alias("text_sha256")))
    shared = groups.groupBy("_digest").count().filter("count > 1").select("_digest")
    ids = rows.select("doc_id", "_digest", sha256(F.col("_norm")).alias("text_sha256"))
    if shared.isEmpty():
        found = ids.drop("text_sha256").join(groups, "_digest")
    else:  # different texts under one digest: look those up by content
        alone = groups.join(shared, "_digest", "left_anti")
        texts = rows.join(shared, "_digest", "left_semi").select("doc_id", "_digest", "_norm")
        again = texts.groupBy("_digest", "_norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = ids.drop("text_sha256").join(alone, "_digest").unionByName(
            texts.join(again, ["_digest", "_norm"]).withColumn("text_sha256", sha256(F.col("_norm"))).drop("_norm"))
    repeat = F.row_number().over(W.partitionBy("doc_id", "text_sha256").orderBy("keep_id"))
    return found.select("doc_id", "keep_id", "group_size",
                        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (repeat == 1)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one per distinct text.

    Of rows that repeat the kept id with an equal text, one arbitrary row stays.
    """
    digest = sha256(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))))
    keep = exact_groups(docs, id_col, text_col, salts).filter("kept").select(
        F.col("doc_id").alias("_k_id"), F.col("text_sha256").alias("_k_sha"), (F.col("group_size") > 1).alias("_k_many"))
    d = docs.withColumn("_k_own", digest)
    hit = d.join(keep, d[id_col].eqNullSafe(keep["_k_id"]) & (d["_k_own"] == keep["_k_sha"]))
    first = F.row_number().over(W.partitionBy(id_col, "_k_own").orderBy(F.lit(0)))
    return hit.withColumn("_k_n", F.when(F.col("_k_many"), first).otherwise(1)).filter("_k_n = 1").select(*docs.columns)
