"""The feedback log read as a stream: the same derived tables as in batch, kept up to date.

Sources are file streams over the append-only log. Every stream keeps its offsets and state under the shared
checkpoint folder, so a restarted query goes on where it stopped and sinks see each batch once.
"""

from __future__ import annotations

import math
import os
import uuid
from bisect import bisect_right, insort

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadframe.operators.common import checkpoint_root
from roadframe.operators.memory import CAP, FLOOR, SCALE, STEP_UP, replay_index


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def run_available(stream: DataFrame, mode: str, out: str) -> None:
    """Process what is there and stop. Each batch writes its own folder, replaced if the batch is repeated.

    Keyed state lives in RocksDB stores whose changes are saved with the offsets, so a restarted query finds it again.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    conf, store = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(store, None)
    conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = (stream.writeStream.outputMode(mode).foreachBatch(sink)
             .option("checkpointLocation", out + "-offsets").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        conf.set(store, before) if before else conf.unset(store)


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest emitted row per key."""
    d = spark.read.parquet(out)
    cols = [c for c in d.columns if c not in (*keys, "batch")]
    g = d.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch").alias("r"))
    return g.select(*keys, *[F.col("r").getField(c).alias(c) for c in cols])


# ---------------------------------------------------------------- library index
def _half_even(u: int) -> int:
    h, odd = divmod(u, 2)
    return h + (odd and h % 2)


def _review(u: int, rejected: bool) -> int:
    return max(FLOOR, _half_even(u)) if rejected else min(CAP, u + STEP_UP)


#: Reviews of a pair that one entry of its state holds.
BLOCK = 512


def _cut(u: int, tail: dict[int, bool]) -> tuple[list, int]:
    """Blocks (first step, confidence before it, steps, rejections) of reviews in step order, and the confidence after them."""
    order, blocks = sorted(tail), []
    for k in range(0, len(order), BLOCK):
        steps = order[k:k + BLOCK]
        rejects = [tail[s] for s in steps]
        blocks.append((steps[0], u, steps, rejects))
        for r in rejects:
            u = _review(u, r)
    return blocks, u


class ReplayIndex(StatefulProcessor):
    """All reviews of a pair in blocks by step, each with the confidence before it.

    A batch opens the newest block only. A review older than that block, however late, goes into its own block, and
    the blocks from there on are folded again.
    """

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "first long, rejections long, acceptances long, settled long, newest long, late long")
        self.blocks = handle.getMapState("blocks", "first long", "u int, steps array<long>, rejects array<boolean>")

    def handleInputRows(self, key, rows, timer_values):
        new, u = {}, None
        for r in rows:
            new.setdefault(int(r["step_id"]), r["outcome"] == "rejected")
            u = r["u0"] if u is None else u
        held = self.now.get() if self.now.exists() else None
        first, rejections, acceptances, settled, newest, late = held or (None, 0, 0, None, None, 0)
        if held is None:
            opened = {}
        elif min(new) >= first:
            opened = {first: self.blocks.getValue((first,))}
        else:
            opened = {k[0]: v for k, v in self.blocks.iterator()}
        starts = sorted(opened)
        at = [max(0, bisect_right(starts, s) - 1) for s in new]
        touched = starts[min(at):] if starts else []
        tail: dict[int, bool] = {}
        for start in touched:
            tail.update(zip(opened[start][1], opened[start][2]))
        added = {s: r for s, r in new.items() if s not in tail}
        late += sum(settled is not None and s <= settled for s in added)
        blocks, u = _cut(opened[touched[0]][0] if touched else u, tail | added)
        if added:
            kept = {b[0] for b in blocks}
            for start in touched:
                if start not in kept:
                    self.blocks.removeKey((start,))
            for start, before, steps, rejects in blocks:
                if opened.get(start) != (before, steps, rejects):
                    self.blocks.updateValue((start,), (before, steps, rejects))
            rejections += sum(added.values())
            acceptances += len(added) - sum(added.values())
            newest = max(added if newest is None else [newest, *added])
            steps = blocks[-1][2]
            behind = bisect_right(steps, newest - self.horizon)
            settled = steps[behind - 1] if behind else settled
            self.now.update((blocks[-1][0], rejections, acceptances, settled, newest, late))
        yield Row(part=key[0], pair_id=key[1], confidence=round(u / SCALE, 4), rejections=rejections, acceptances=acceptances, too_late=late)


def stream_replay_index(log: DataFrame, library: DataFrame, horizon: int = 65536) -> DataFrame:
    """Confidence and counts per (part, pair) as reviews arrive, in step order whatever order they arrive in.

    Exact at any lateness; a repeated step is ignored. `too_late` counts reviews that came after a review more than
    `horizon` steps newer had been applied beyond them. The work of a batch goes by its own rows, not by the log: only late
    rows open older blocks.
    """
    start = library.select("part", "pair_id", F.bround(F.col("confidence0") * SCALE, 0).cast("int").alias("u0"))
    ev = log.filter(F.col("outcome").isin("accepted", "rejected")).select("part", "pair_id", "step_id", "outcome").join(start, ["part", "pair_id"])
    return ev.groupBy("part", "pair_id").transformWithState(
        ReplayIndex(horizon), "part string, pair_id long, confidence double, rejections long, acceptances long, too_late long", "update", "none")


# ---------------------------------------------------------------- running tables
def stream_situations(touches: DataFrame) -> DataFrame:
    first = F.struct("ts", "step_id")
    return touches.groupBy("key").agg(F.min_by("features", first).alias("features"), F.min("ts").alias("first_seen"),
                                      F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("seen"))


def stream_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("part", "outcome").agg(F.count(F.lit(1)).alias("n"))


class NewScales(StatefulProcessor):
    """Accepted scales of a (mask, photo) in zones of ZONE tolerances: a zone never holds more than ZONE + 1 of them."""

    ZONE = 4096

    def __init__(self, tol: float):
        self.tol = tol

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "zone long", "scales array<double>")

    def handleInputRows(self, key, rows, timer_values):
        zones, changed = {}, set()

        def zone(scale):
            z = math.floor(scale / (self.ZONE * self.tol))
            if z not in zones:
                held = self.known.getValue((z,)) if self.known.containsKey((z,)) else None
                zones[z] = list(held[0]) if held else []
            return z

        for s in sorted({r["scale"] for r in rows}):
            near = False
            for z in {zone(s - self.tol), zone(s + self.tol)}:
                at = bisect_right(zones[z], s)
                near |= any(abs(k - s) < self.tol for k in zones[z][max(0, at - 1):at + 1])
            if not near:
                insort(zones[z := zone(s)], s)
                changed.add(z)
                yield Row(mask_id=key[0], photo_id=key[1], scale=s)
        for z in changed:
            self.known.updateValue((z,), (zones[z],))


def append_new_pairs(requests: DataFrame, trained: DataFrame, out: str, tol: float = 1e-6) -> None:
    """Append requests whose (mask, photo, scale) is neither trained nor accepted before, within `tol`.

    Trained scales stand in their own and both neighbouring cells, so that check is an equi-join and then exact. Of
    what is left of a batch, the smallest scale is taken, then the next at or beyond it plus `tol`, and so on. Accepted
    scales are kept as state per (mask, photo); the sink is never read. Requests without a scale are left out.
    """
    cell = F.floor(F.col("scale") / (2 * tol)).cast("bigint")
    pair = ["mask_id", "photo_id"]
    asked = requests.filter(F.col("scale").isNotNull()).select(*[F.col(c).cast("bigint").alias(c) for c in pair], F.col("scale").cast("double").alias("scale"), cell.alias("_cell"))
    known = trained.select(*[F.col(c).alias(f"_{c}") for c in pair], F.col("scale").alias("_known"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_c"))
    near = [F.col(c) == F.col(f"_{c}") for c in pair] + [F.col("_cell") == F.col("_c"), F.abs(F.col("scale") - F.col("_known")) < tol]
    fresh = asked.join(known, near, "left_anti").groupBy(*pair).transformWithState(
        NewScales(tol), "mask_id long, photo_id long, scale double", "append", "none")
    run_available(fresh, "append", out)


def append_once(stream: DataFrame, out: str, key: str) -> None:
    """Append every row whose key has not come before, however late it comes.

    The keys seen are keyed state: a batch looks up its own keys and never reads what others have written; a repeated
    batch replaces its own folder.
    """
    run_available(stream.dropDuplicates([key]), "append", out)


def settle_late(index: DataFrame, log: DataFrame, library: DataFrame) -> DataFrame:
    """The streamed index with the pairs that had reviews beyond the horizon replayed in batch from the whole log.

    A check of the stream: its index is exact without it.
    """
    late = index.filter("too_late > 0").select("part", "pair_id")
    again = replay_index(library.join(late, ["part", "pair_id"], "left_semi"), log.join(late, ["part", "pair_id"], "left_semi"), ranked=False)
    settled = again.select("part", "pair_id", "confidence", "rejections", "acceptances", F.lit(0).cast("bigint").alias("too_late"))
    return index.filter("too_late = 0").unionByName(settled)
