"""Document fingerprints that tell what changed between two versions: invertible Bloom lookup sketches.

A text is cut into paragraphs, and long paragraphs further at places that depend on the nearest eight bytes only, so
an edit leaves all other parts as they are. Every part has a 64-bit digest (repeated parts are numbered) and is added
to three cells, each a count, an XOR of digests and an XOR of checks. The cells of two versions are subtracted; equal
parts cancel, and cells that hold one part only are peeled until nothing is left. If peeling gets stuck, both sketches
are built again four times as large, as often as it takes. The recovered digests give the exact difference, and with
it the likeness (shared parts by parts of either version).
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from roadframe.llm.common import written

CELLS, HASHES = 18, 3
#: Characters of the texts whose sketches are worked on together; it bounds memory, not the result.
RUN_CHARS = 1 << 20
#: One place in so many bytes ends a part inside a paragraph.
PART_BYTES = 32
_SEEDS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit generator: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def parts_of(text: str) -> list[bytes]:
    """Paragraphs with their line breaks, long ones in pieces. Joined they are the text."""
    data = text.encode("utf-8")
    a = np.frombuffer(data, np.uint8)
    ends = a == 10
    if len(a) > 8:
        w = a.astype(np.uint64)
        for step in (1, 2, 4):
            w = w[:-step] | w[step:] << np.uint64(8 * step)
        ends[7:] |= mix(w) < np.uint64((1 << 64) // PART_BYTES)
    cuts = (np.flatnonzero(ends) + 1).tolist()
    if data and (not cuts or cuts[-1] != len(data)):
        cuts.append(len(data))
    return [data[i:j] for i, j in zip([0, *cuts], cuts)]


def part_digests(text: str) -> np.ndarray:
    """Sorted distinct digests of the parts; the k-th copy of a part has a digest of its own."""
    found = np.sort(np.array([xxhash.xxh3_64_intdigest(p) for p in parts_of(text)], np.uint64))
    if len(found) > 1:
        new = np.concatenate([[True], found[1:] != found[:-1]])
        if not new.all():
            at = np.arange(len(found))
            copy = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
            found = np.where(copy > 0, mix(found + copy * _CHECK), found)
    return found


class Sketches:
    """Equally large invertible Bloom lookup tables, one behind the other; a digest's three cells lie in three thirds."""

    def __init__(self, number: int, cells: int):
        self.number, self.cells = number, cells
        self.count, self.key, self.check = np.zeros(number * cells, np.int32), np.zeros(number * cells, np.uint64), np.zeros(number * cells, np.uint64)

    @staticmethod
    def check_of(digests: np.ndarray) -> np.ndarray:
        return mix(digests ^ _CHECK) >> np.uint64(32)

    def add(self, owner: np.ndarray, digests: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Add digests to the tables of their owners, or take them out; returns the cells touched."""
        third, check = self.cells // HASHES, self.check_of(digests)
        touched = []
        for k, seed in enumerate(_SEEDS):
            at = (mix(digests + np.uint64(seed * self.cells % (1 << 64))) % np.uint64(third)).astype(np.int64) + (owner * self.cells + third * k)
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, digests)
            np.bitwise_xor.at(self.check, at, check)
            touched.append(at)
        return np.concatenate(touched)

    def minus(self, mine: np.ndarray, other: np.ndarray) -> Sketches:
        """Differences of the tables `mine` and `other` of this batch."""
        out = Sketches(len(mine), self.cells)
        count, key, check = (x.reshape(self.number, self.cells) for x in (self.count, self.key, self.check))
        out.count, out.key, out.check = (count[mine] - count[other]).ravel(), (key[mine] ^ key[other]).ravel(), (check[mine] ^ check[other]).ravel()
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, digest, sign of what was recovered; whether each table was emptied). Empties the cells."""
        got = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))]
        look, left = np.arange(len(self.count)), len(self.count)
        while len(look) and left >= 0:
            pure = look[(np.abs(self.count[look]) == 1) & (self.check_of(self.key[look]) == self.check[look])]
            owner, digests, sign = pure // self.cells, self.key[pure], self.count[pure]
            order = np.lexsort((owner, digests))
            owner, digests, sign = owner[order], digests[order], sign[order]
            new = np.ones(len(order), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (digests[1:] != digests[:-1])
            got.append((owner[new], digests[new], sign[new]))
            look = np.unique(self.add(owner[new], digests[new], -sign[new])) if len(pure) else pure
            left -= int(new.sum())
        rest = ((self.count != 0) | (self.key != 0) | (self.check != 0)).reshape(self.number, self.cells).any(axis=1)
        return *(np.concatenate(c) for c in zip(*got)), ~rest

    def packed(self) -> list[bytes]:
        parts = [x.reshape(self.number, self.cells).astype(t) for x, t in ((self.count, "<i4"), (self.key, "<u8"), (self.check, "<u4"))]
        return [b"".join(p[k].tobytes() for p in parts) for k in range(self.number)]


def sketch(digests: list[np.ndarray], cells: int) -> Sketches:
    out = Sketches(len(digests), cells)
    owner = np.repeat(np.arange(len(digests)), [len(d) for d in digests])
    flat = np.concatenate([np.zeros(0, np.uint64), *digests])
    out.add(owner, flat, np.ones(len(flat), np.int32))
    return out


def fingerprints(digests: list[np.ndarray], base: Sketches) -> list[str]:
    """Number of parts and the cells. Equal texts have equal fingerprints."""
    return [f"{len(d)}:{base64.b64encode(c).decode()}" for d, c in zip(digests, base.packed())]


def differences(digests: list[np.ndarray], base: Sketches, mine: list[int], other: list[int]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(digests of `mine` only, of `other` only, cells that it took) for pairs of versions; what cannot be peeled is
    tried again with sketches four times as large."""
    out: list = [None] * len(mine)
    mine, other, open_ = np.array(mine, np.int64), np.array(other, np.int64), np.arange(len(mine))
    tables = base.minus(mine, other)
    while len(open_):
        owner, found, sign, done = tables.peel()
        order = np.argsort(owner, kind="stable")
        owner, found, sign = owner[order], found[order], sign[order]
        borders = np.searchsorted(owner, np.arange(len(open_) + 1))
        for k in np.flatnonzero(done).tolist():
            d, s = found[borders[k]:borders[k + 1]], sign[borders[k]:borders[k + 1]]
            out[open_[k]] = d[s > 0], d[s < 0], tables.cells
        open_ = open_[~done]
        if len(open_):
            used, at = np.unique(np.concatenate([mine[open_], other[open_]]), return_inverse=True)
            larger = sketch([digests[k] for k in used.tolist()], 4 * tables.cells)
            tables = larger.minus(at[:len(open_)], at[len(open_):])
    return out


def likeness(own: np.ndarray, gone: np.ndarray, came: np.ndarray) -> float:
    """Shared parts by parts of either version; two empty texts are alike."""
    return (len(own) - len(gone)) / (len(own) + len(came)) if len(own) + len(came) else 1.0


def compare_versions(pairs: DataFrame, id_col: str, old_col: str, new_col: str, cells: int = CELLS) -> DataFrame:
    """One row per row of `pairs`: id, fingerprint, new_fingerprint, likeness, gone and came (digests as signed longs),
    cells (of the sketches whose difference could be peeled).

    A null text counts as empty. Repeated rows give repeated rows, null ids stay null, an empty table gives no rows.
    Other columns are ignored, so their names cannot clash.
    """
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("id", pairs.schema[id_col].dataType), *[T.StructField(c, T.StringType()) for c in ("fingerprint", "new_fingerprint")],
                           T.StructField("likeness", T.DoubleType()), T.StructField("gone", longs), T.StructField("came", longs), T.StructField("cells", T.LongType())])

    types = pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()

    def run(batches):
        for b in batches:
            rows = []
            for first, last in runs(b.column(1).to_pylist(), b.column(2).to_pylist()):
                digests = [part_digests(t or "") for c in (1, 2) for t in b.column(c)[first:last].to_pylist()]
                n, base = last - first, sketch(digests, cells)
                names = fingerprints(digests, base)
                for k, (gone, came, size) in enumerate(differences(digests, base, list(range(n)), list(range(n, 2 * n)))):
                    rows.append((names[k], names[n + k], likeness(digests[k], gone, came), gone.view(np.int64), came.view(np.int64), size))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]], names=schema.names)

    return pairs.select(F.col(id_col).alias("id"), old_col, new_col).mapInArrow(run, schema)


def runs(*texts: list):
    """(first, last) of runs of rows with about RUN_CHARS characters, which are worked on together."""
    first, chars, n = 0, 0, len(texts[0])
    for k in range(n):
        chars += sum(len(t[k] or "") for t in texts) + 64
        if chars >= RUN_CHARS or k + 1 == n:
            yield first, k + 1
            first, chars = k + 1, 0


def half_replaced(text: str, following: str) -> str:
    """The last half of the code points makes way for as many first ones of the following text."""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k]


_RESULT = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()),
           ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]


def _reports(texts: list[str]) -> list[tuple]:
    """The result of every text but the last, compared with its edited text and with the text after it."""
    n = len(texts) - 1
    edited = [half_replaced(t, f) for t, f in zip(texts, texts[1:])]
    digests = [part_digests(t) for t in texts] + [part_digests(t) for t in edited]
    base = sketch(digests, CELLS)
    names = fingerprints(digests, base)
    found = differences(digests, base, [*range(n), *range(n)], [*range(n + 1, 2 * n + 1), *range(1, n + 1)])
    near = [likeness(digests[k % n], gone, came) for k, (gone, came, _) in enumerate(found)]
    return [(len(texts[k]), hashlib.sha256(edited[k].encode("utf-8")).hexdigest(), names[k], names[n + 1 + k], near[k], near[n + k]) for k in range(n)]


def half_edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text takes its second half from the next document by ascending id; the last one takes it from the first,
    a lone document from itself. Texts are sorted into ranges once and compared with the row before while a range is
    read; only the first and last row of a range wait for the neighbouring range. A null text counts as empty. Every
    row gives a row; null ids come first, rows with equal ids stand in order of a hash of their text and then of their
    place in the table. An empty table gives no rows. Other columns are ignored, so their names cannot clash.
    """
    kind = docs.schema[id_col].dataType
    own = [T.StructField("doc_id", kind), *[T.StructField(c, t) for c, t in _RESULT]]
    schema = T.StructType([*own, T.StructField("range", T.LongType()), T.StructField("at", T.StringType()), T.StructField("text", T.StringType())])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = ["doc_id", "_h", "_m"]
    rows = rows.withColumn("_h", F.xxhash64("text")).withColumn("_m", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def batch(ids, found, place, marks, texts, id_type):
        cols = [pa.array(ids, id_type), *[pa.array([None if r is None else r[k] for r in found], t) for k, t in
                                          enumerate((pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))]]
        n = len(ids)
        return pa.RecordBatch.from_arrays([*cols, pa.array([place] * n, pa.int64()), pa.array(marks, pa.string()), pa.array(texts, pa.string())], names=schema.names)

    def walk(batches):
        place, before, id_type = TaskContext.get().partitionId(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            id_type = b.column(0).type
            ids, texts, found = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            if before is None:
                yield batch(ids[:1], [None], place, ["first"], texts[:1], id_type)
            else:
                ids, texts = [before[0], *ids], [before[1], *texts]
            for first, last in runs(texts[:-1]):
                found += _reports(texts[first:last + 1])
            before = ids[-1], texts[-1]
            yield batch(ids[:-1], found, place, [None] * len(found), [None] * len(found), id_type)
        if before is not None:
            yield batch([before[0]], [None], place, ["last"], [before[1]], id_type)

    table = written(ranged.mapInArrow(walk, schema))
    names = [f.name for f in own]
    first, last = (table.filter(F.col("at") == k) for k in ("first", "last"))
    ranges = sorted(r[0] for r in first.select("range").collect())  # one number per range
    following = docs.sparkSession.createDataFrame(list(zip(ranges, [*ranges[1:], *ranges[:1]])), "range long, following long")
    meet = last.select("doc_id", "text", "range").join(following, "range").join(
        first.select(F.col("range").alias("following"), F.col("text").alias("next_text")), "following").select("doc_id", "text", "next_text")

    def border(batches):
        for b in batches:
            found = [_reports([t, n])[0] for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield batch(b.column(0).to_pylist(), found, None, [None] * len(found), [None] * len(found), b.column(0).type).select(names)

    return table.filter(F.col("at").isNull()).select(*names).unionByName(meet.mapInArrow(border, T.StructType(own)))
