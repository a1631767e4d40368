"""Near-duplicate documents by MinHash bands and odd sketches.

1. Every text gives MinHash samples of its word shingles. Samples hashed together in bands name buckets; the same
   samples folded into a parity bitmap (odd sketch) let two documents be compared by the population count of an XOR.
2. Documents with equal shingle sets form one class, and only its smallest id goes on.
3. Inside a bucket, classes whose sketches allow the wanted similarity are connected by a spanning forest; no pairs are
   written. Large buckets are cut into blocks, and every two blocks meet in one bounded task.
4. The forests of all buckets join into neighbourhoods, which hold every possible link. Their texts are shuffled once,
   again in pairs of blocks, and links are confirmed on the full sets; a task stops comparing what it has connected.
5. Confirmed links join into components.

The number of bands is chosen so that a pair at the threshold shares no bucket with probability MISS at most, and the
sketch filter lets through all that lies within MARGIN standard errors of the threshold.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from roadframe.llm.common import written
from roadframe.operators.common import connected_components

MISS, MARGIN, BITS = 1e-7, 5.0, 512
#: Members of one block of a bucket, and of a neighbourhood; a task holds two blocks.
BUCKET_BLOCK, TEXT_BLOCK = 1024, 256


class WordHash(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd_numbers(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def shingle_set(text: str | None, words: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, a blank one has none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    size = min(words, len(w))
    factor = _odd_numbers(size, 7 + size)
    total = np.zeros(len(ids) - size + 1, np.uint64)
    for j in range(size):
        total += ids[j:len(ids) - size + 1 + j] * factor[j]
    return np.unique(_mix(total))


class Plan:
    """Numbers that follow from the threshold (percent) and the rows of a band."""

    def __init__(self, percent: int, rows: int):
        s = percent / 100
        self.percent, self.rows = percent, rows
        self.bands = math.ceil(math.log(MISS) / math.log1p(-(s ** rows)))
        self.samples = rows * self.bands
        lowest = max(0.0, s - MARGIN * math.sqrt(s * (1 - s) / self.samples) - 0.02)
        # two sets of samples differ in 2k(1-J) items, each of which flips a bit
        self.most_bits = math.ceil(BITS / 2 * (1 - math.exp(-2 * 2 * self.samples * (1 - lowest) / BITS)))


def sketch(sets: list[np.ndarray], plan: Plan, limit: int = 32768) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (documents x bands) and odd sketches (documents x BITS/8 bytes) of non-empty sets."""
    k = plan.samples
    a, b = _odd_numbers(k, 11), _odd_numbers(k, 13)
    low = np.empty((len(sets), k), np.uint64)
    at = 0
    while at < len(sets):
        end, held = at, 0
        while end < len(sets) and (end == at or held + len(sets[end]) <= limit):
            held += len(sets[end])
            end += 1
        values = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *map(len, sets[at:end - 1])])
        buffer = np.empty_like(values)
        for i in range(k):
            np.multiply(values, a[i], out=buffer)
            buffer += b[i]
            low[at:end, i] = np.minimum.reduceat(buffer, starts)
        at = end
    index = np.arange(k, dtype=np.uint64)
    mixed = _mix(low + index * np.uint64(0x9E3779B97F4A7C15))
    grouped = mixed.reshape(len(sets), plan.bands, plan.rows)
    keys = np.zeros((len(sets), plan.bands), np.uint64)
    for r in range(plan.rows):
        keys = _mix(keys * np.uint64(31) + grouped[:, :, r])
    spots = (mixed >> np.uint64(40)) % np.uint64(BITS) + np.arange(len(sets), dtype=np.uint64)[:, None] * np.uint64(BITS)
    parity = np.bincount(spots.ravel().astype(np.int64), minlength=len(sets) * BITS).reshape(len(sets), BITS) & 1
    return keys.view(np.int64), np.packbits(parity.astype(np.uint8), axis=1)


def sketches(docs: DataFrame, words: int, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, set_key, bands, odd; without shingles the last three are null."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()),
                           T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("odd", T.BinaryType())])

    def run(batches):
        hashes = WordHash()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                sets = [shingle_set(t, words, hashes) for t in b.column(1).to_pylist()]
                full = [k for k, s in enumerate(sets) if len(s)]
                keys, odd, marks = ([None] * len(sets) for _ in range(3))
                if full:
                    band, bits = sketch([sets[k] for k in full], plan)
                    for row, k in enumerate(full):
                        keys[k], odd[k] = band[row], bits[row].tobytes()
                        marks[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.binary())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def blocks(df: DataFrame, key: str, members: str, size: int, node: str) -> DataFrame:
    """Copy every row to the pairs of blocks of its key that it belongs to: adds _lo and _hi."""
    n = F.ceil(F.col(members) / size).cast("int")
    own = F.pmod(F.xxhash64(F.col(node), F.lit(5)), n).cast("int")
    d = df.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    return d.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other")).drop("_own", "_other")


def runs(batches, keys: int):
    """Whole runs of rows with equal values in the first `keys` columns, from sorted batches."""
    rest = None
    for b in batches:
        if b.num_rows == 0:
            continue
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        change = np.zeros(t.num_rows - 1, bool)
        for k in range(keys):
            v = t.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, z in zip(cuts, cuts[1:]):
            yield t.slice(a, z - a)
        rest = t.slice(cuts[-1])
    if rest is not None:
        yield rest


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def forest(count: int, odd: np.ndarray, sizes: np.ndarray, plan: Plan, confirm=None):
    """Edges of a spanning forest over the rows that the sketches (and then `confirm`) allow to be linked."""
    left = np.arange(count)
    edges = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            differ = np.bitwise_count(odd[left] ^ odd[u]).sum(axis=1)
            small, large = np.minimum(sizes[left], sizes[u]), np.maximum(sizes[left], sizes[u])
            hit = (differ <= plan.most_bits) & (100 * small >= plan.percent * large)
            if confirm is not None:
                hit[hit] = [confirm(u, int(v)) for v in left[hit]]
            for v in left[hit].tolist():
                edges.append((u, v))
                queue.append(v)
            left = left[~hit]
    return edges


_EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _edge_batch(ids: np.ndarray, edges: list) -> pa.RecordBatch:
    e = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[e[:, 0]]), pa.array(ids[e[:, 1]])], names=["u", "v"])


def neighbourhoods(reps: DataFrame, plan: Plan) -> DataFrame:
    """id, label: classes that may be linked, directly or over others."""
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    held = rows.join(shared, "bucket").join(reps.select("rep", "n_shingles", "odd"), "rep")
    dealt = blocks(held, "bucket", "_n", BUCKET_BLOCK, "rep").select("bucket", "_lo", "_hi", "rep", "n_shingles", "odd")

    def connect(batches):
        for t in runs(batches, 3):
            if t.num_rows > 1:
                edges = forest(t.num_rows, _bits(t.column(5)), t.column(4).to_numpy(), plan)
                if edges:
                    yield _edge_batch(t.column(3).to_numpy(), edges)

    edges = dealt.repartition("bucket", "_lo", "_hi").sortWithinPartitions("bucket", "_lo", "_hi").mapInArrow(connect, _EDGES)
    return connected_components(edges, [])


def confirmed_links(docs: DataFrame, reps: DataFrame, near: DataFrame, words: int, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """u, v: links that hold on the full sets and connect all that is linked."""
    sizes = near.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    held = near.withColumnRenamed("id", "rep").join(sizes, "label").join(reps.select("rep", "n_shingles", "odd"), "rep")
    text = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("_text"))
    dealt = blocks(held.join(text, "rep"), "label", "_n", TEXT_BLOCK, "rep").select("label", "_lo", "_hi", "rep", "n_shingles", "odd", "_text")

    def connect(batches):
        hashes = WordHash()
        for t in runs(batches, 3):
            if t.num_rows < 2:
                continue
            sets = [shingle_set(x, words, hashes) for x in t.column(6).to_pylist()]

            def linked(u, v):
                a, b = sorted((sets[u], sets[v]), key=len)
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                return 100 * both >= plan.percent * (len(a) + len(b) - both)

            edges = forest(t.num_rows, _bits(t.column(5)), t.column(4).to_numpy(), plan, linked)
            if edges:
                yield _edge_batch(t.column(3).to_numpy(), edges)

    return dealt.repartition("label", "_lo", "_hi").sortWithinPartitions("label", "_lo", "_hi").mapInArrow(connect, _EDGES)


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; documents are linked when 100 * intersection >= percent * union
    of their distinct shingles, and component_id is the smallest id reachable. A null, empty or blank text has no
    shingles and is linked with nothing. A null id is linked with nothing and stays. Rows that share an id are one
    document: both follow its links, and both stay if it stays. Other columns of `docs` are ignored, so their names
    cannot clash.
    """
    plan = Plan(percent, rows)
    base = written(sketches(docs, words, plan, id_col, text_col))
    some = base.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    reps = written(some.join(classes.withColumnRenamed("set_key", "_k"), (F.col("doc_id") == F.col("rep")) & (F.col("set_key") == F.col("_k")))
                   .select("rep", "set_key", "n_shingles", "bands", "odd"))
    near = written(neighbourhoods(reps, plan))
    parts = connected_components(confirmed_links(docs, reps, near, words, plan, id_col, text_col), [])
    named = reps.select("set_key", "rep").dropDuplicates(["set_key"]).join(parts.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_key", F.coalesce("label", "rep").alias("component_id"))
    out = base.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
                      F.col("doc_id").eqNullSafe(F.when(F.col("doc_id").isNotNull(), component)).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, rows: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: the smallest id of each component."""
    gone = near_duplicates(docs, words, percent, rows, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
