"""Sharding by minimax contiguous partition.

Equal texts form atomic groups, ordered by their first document. The smallest capacity under which the groups fit into
the shards in order is searched over running sums of the group sizes: each round checks many capacities together, each
by the greedy rule (the next cut is the last group end that still fits), so a check costs one small aggregate per shard
over a sorted column. The cuts are then set under that capacity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from roadframe.llm.common import ordered, written

#: Capacities checked together in one round of the search.
CANDIDATES = 2000


class _Ends:
    """Lookups in the sorted column of group ends, which stand in files of disjoint ranges.

    First and last end of every file (one row each) are kept; a limit between two files is answered by them, any other
    by the one file that holds it.
    """

    def __init__(self, groups: DataFrame):
        self.ends = groups.select("_end")
        spans = groups.groupBy(F.input_file_name()).agg(F.min("_end").alias("low"), F.max("_end").alias("high")).orderBy("low").collect()
        self.low, self.high = (np.array([r[c] for r in spans], np.int64) for c in ("low", "high"))

    def around(self, limits: list[int]) -> tuple[list[int], list[int]]:
        """For every limit the largest end <= limit (or 0), and the smallest end above it (or the largest of all)."""
        at = np.array(sorted(set(limits)), np.int64)
        k = np.searchsorted(self.low, at, side="right") - 1
        below = np.where(k >= 0, self.high[k], 0)
        above = np.append(self.low, self.high[-1])[k + 1]
        inside = np.flatnonzero((k >= 0) & (at < self.high[k]))
        if len(inside):
            below[inside], above[inside] = self._inside(at[inside], self.low[k[inside]], self.high[k[inside]])
        place = np.searchsorted(at, np.array(limits, np.int64))
        return below[place].tolist(), above[place].tolist()

    def _inside(self, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[list[int], list[int]]:
        """The same for limits within [low, high) of a file: only the tasks that read that file answer, once each."""
        most = np.iinfo(np.int64).max

        def nearest(batches):
            below, above = np.zeros(len(at), np.int64), np.full(len(at), most)
            for b in batches:
                ends = np.sort(b.column(0).to_numpy())
                k = np.searchsorted(ends, at, side="right")
                below = np.maximum(below, np.where(k > 0, np.append(ends, 0)[k - 1], 0))
                above = np.minimum(above, np.append(ends, most)[k])
            mine = (below >= low) | (above <= high)
            yield pa.RecordBatch.from_arrays([pa.array(c[mine]) for c in (at, below, above)], names=["x", "below", "above"])

        near = self.ends.filter(F.col("_end").between(int(low.min()), int(high.max())))
        found = near.mapInArrow(nearest, "x bigint, below bigint, above bigint").groupBy("x").agg(F.max("below").alias("below"), F.min("above").alias("above"))
        by = {r["x"]: (r["below"], r["above"]) for r in found.collect()}
        return [by[x][0] for x in at.tolist()], [by[x][1] for x in at.tolist()]


def smallest_capacity(ends: _Ends, total: int, largest: int, shards: int) -> int:
    """Smallest shard capacity for which the greedy cuts reach the end."""
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest  # the upper bound always fits
    while low < high:
        step = max(1, -(-(high - low) // CANDIDATES))
        tried = list(range(low, high, step))
        cuts = [0] * len(tried)
        for _ in range(shards):
            cuts = ends.around([min(total, c + t) for c, t in zip(cuts, tried)])[0]
        fits = [t for t, c in zip(tried, cuts) if c == total]
        if fits:
            high = fits[0]
            low = max(low, high - step + 1)
        else:
            low = tried[-1] + 1
        if fits and step == 1:
            low = high
    return high


def cuts_under(ends: _Ends, total: int, capacity: int, shards: int) -> list[int]:
    """Ends of the shards: as even as the capacity and the order allow."""
    floor = [total]
    for _ in range(shards - 1):  # from the back: what must at least be placed before each cut
        floor.append(ends.around([floor[-1] - capacity - 1])[1][0] if floor[-1] > capacity else 0)
    floor = floor[::-1]
    cuts, start = [], 0
    for k in range(shards - 1):
        ideal = start + (total - start) // (shards - k)
        wanted = [ideal, min(total, start + capacity)]
        below, above = ends.around(wanted)
        fit = [e for e in (below[0], above[0]) if max(floor[k], start) <= e <= start + capacity]
        cut = min(fit, key=lambda e: (abs(e - ideal), e)) if fit else below[1]
        cuts.append(cut)
        start = cut
    return [*cuts, total]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes plus 1; a null text counts as empty. Equal texts share a shard, so a group larger
    than an even share makes its shard larger. Every row gets its own slot, repeated rows too; null ids come first.
    Other columns of `docs` are ignored, so their names cannot clash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    ids = written(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                              F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_digest")))
    groups = ids.groupBy("_digest").agg(F.min("doc_id").alias("_first"), F.sum("size").alias("_bytes"))
    placed = ordered(groups, [], ["_first", "_digest"], "_i", {"_before": "_bytes"})
    placed = placed.select("_digest", "_first", "_bytes", (F.col("_before") + F.col("_bytes")).alias("_end"))
    placed = written(placed.repartitionByRange("_end").sortWithinPartitions("_end"))
    stats = placed.agg(F.max("_end").alias("total"), F.max("_bytes").alias("largest")).first()
    total, largest = stats["total"] or 0, stats["largest"] or 0
    ends = _Ends(placed)
    cuts = cuts_under(ends, total, smallest_capacity(ends, total, largest, shards), shards) if total else []
    number = F.lit(0)
    for c in cuts[:-1]:
        number = number + (F.col("_end") > c).cast("int")
    homes = placed.select("_digest", "_first", number.cast("int").alias("shard"))
    rows = ids.join(homes, "_digest")
    out = ordered(rows, ["shard"], ["_first", "_digest", "doc_id"], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
