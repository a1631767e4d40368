"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

1. Word k-mers are thinned by winnowing: the smallest hash of every window is a seed, so that any `k + window - 1` words
   that two documents share hold a shared seed. Each seed carries a bitmap of the words on either side.
2. Seed occurrences go in blocks to ranges of seeds, where they are sorted; each is matched with the first document that
   holds the seed, with the previous one, with the occurrence before it in its own document, and with those before it that
   have the same words to the left or to the right. A seed that a third of all documents hold thus gives at most five
   matches per occurrence and never a pair of every two. A seed too frequent for one range is cut between documents, and its matches across ranges
   are closed over one row per range and words beside.
3. The matches of two documents are chained in order: a Fenwick tree over the home's positions gives the best chain to
   go on from, with a cost for every word skipped. A lone seed goes on if the words beside it agree on one side.
4. Chains are aligned on the words of both texts, between the seeds and beyond both ends. The home gets the stretch around
   a document's chains, and the whole text if an alignment comes to the end of that. An alignment that is not
   similar enough is cut into its longest stretches that are; those that are long enough are passages.
5. Of the passages of a document, those that the ones with smaller homes cover are left out.
"""

from __future__ import annotations

import bisect
import itertools
import operator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from roadframe.llm.common import written
from roadframe.llm.neardup import _mix, _odd_numbers, runs
from roadframe.llm.words import text_bytes, word_hashes, word_places

K, WINDOW = 5, 6
MIN_WORDS, MIN_IDENTITY = 45, 0.8
GAP_COST, MAX_GAP = 0.05, 60
#: Differences that an extension beyond a chain steps over (words of either text), and the equal words it then asks for.
STEPS = tuple(sorted(((x, y) for x in range(4) for y in range(4) if x or y), key=lambda s: (max(s), abs(s[0] - s[1]))))
AGAIN = 3
#: Longer differences of equal length, tried last.
STEPS += tuple((x, x) for x in range(4, 9))
#: Words on either side of a seed that its bitmaps hold.
BESIDE = 16
#: Words of a document beyond its chains that go to the home; and how far ahead of its place an extension reads.
MARGIN, LOOK = 64, 12
#: Seeds that a task holds before it packs them by range, and of a range, some 36 bytes each.
BLOCK_ROWS, SEEDS_A_RANGE = 200_000, 500_000
#: A frequent seed is cut into ranges of so many occurrences at least, in sixteenths.
LEAST_CUT = 4096
COUNTS = ("start", "end", "home_start", "home_end", "char_start", "char_end", "n_words")

def slices(batches, *texts: int, size: int = 1 << 21):
    """Slices of batches with some `size` bytes in the given columns, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = sum(pc.fill_null(pc.binary_length(b.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in texts)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes + 1) // size)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
            yield b.slice(lo, hi - lo)


def seeds_of(ids: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, ...]:
    """(text, word position, value, words to the left, to the right) of the seeds of texts whose words start at `first`.

    A seed is the smallest k-mer of a window, at every position it has; a shorter text is one window. The words beside it
    are 64-bit bitmaps of BESIDE words before and after.
    """
    n, texts = np.diff(first), len(first) - 1
    gap = max(BESIDE, k + window)  # words of nothing before, between and behind the texts
    base = first[:-1] + gap * np.arange(1, texts + 1)
    place = np.arange(len(ids)) + np.repeat(base - first[:-1], n)
    total = len(ids) + gap * (texts + 1)
    spread, whole = np.zeros(total, np.uint64), np.zeros(total, bool)
    spread[place], whole[place] = ids, True
    factor = _odd_numbers(k, 29)
    values = np.zeros(total, np.uint64)
    for j in range(k):
        values[:total - j] += spread[j:] * factor[j]
    values = _mix(values)
    whole[:total - k + 1] &= whole[k - 1:]
    values[~whole] = np.iinfo(np.uint64).max
    least, step = values.copy(), np.zeros(total, np.int64)
    for j in range(1, window):
        less = values[j:] < least[:total - j]
        np.copyto(least[:total - j], values[j:], where=less)
        step[:total - j][less] = j
    opens = whole.copy()  # of the windows: those that end in the text, and the first
    opens[1:] &= ~whole[:-1]
    opens[:total - window + 1] |= whole[:total - window + 1] & whole[window - 1:]
    at = np.flatnonzero(opens)
    chosen = np.zeros(total, bool)
    chosen[at + step[at]] = True
    at = np.flatnonzero(chosen)
    bits = np.zeros(total, np.uint64)
    bits[place] = np.uint64(1) << (ids >> np.uint64(58))
    m = 1
    while m < BESIDE:
        bits[:-m] |= bits[m:].copy()
        m *= 2
    text = np.searchsorted(base, at, side="right") - 1
    return text, at - base[text], values[at], bits[at - BESIDE], bits[at + k]


def agree(left, right, home_left, home_right):
    """Whether half of the words on one side are the same."""
    out = np.zeros(len(left), bool)
    for x, y in ((left, home_left), (right, home_right)):
        same = np.bitwise_count(x & y).astype(int)
        out |= (same > 0) & (2 * same >= np.maximum(np.bitwise_count(x), np.bitwise_count(y)))
    return out


def seed_fields(id_type) -> T.StructType:
    return T.StructType([T.StructField("seed", T.LongType()), T.StructField("doc_id", id_type), T.StructField("pos", T.IntegerType()),
                         T.StructField("left", T.LongType()), T.StructField("right", T.LongType())])


def seed_batches(batches, k: int, window: int, id_type):
    """Batches of seed, doc_id, pos, left, right for batches of documents (id, text)."""
    schema = arrow_seeds(id_type)
    for b in slices(batches, 1):
        raw, offsets = text_bytes(b.column(1))
        starts, ends, first = word_places(raw, offsets)
        row, at, values, left, right = seeds_of(word_hashes(raw, starts, ends), first, k, window)
        yield pa.RecordBatch.from_arrays(
            [pa.array(values.view(np.int64)), b.column(0).take(pa.array(row)).cast(schema.types[1]), pa.array(at.astype(np.int32)),
             pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], schema=schema)


def arrow_seeds(id_type) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in seed_fields(id_type)])


def seed_borders(docs: DataFrame, k: int, window: int) -> list[tuple[int, object]]:
    """(seed, doc_id or None): where the ranges of sorted seeds start. docs(id, text).

    Seeds are hashes, so even steps deal them out; those that would fill half a range by themselves are cut between
    documents. Every sixteenth document tells how many seeds there are and which are frequent: this sets how even the
    ranges are, and nothing else.
    """
    id_col, id_type = docs.columns[0], docs.schema[0].dataType
    schema = T.StructType(seed_fields(id_type).fields[:2])

    def run(batches):
        for b in seed_batches(batches, k, window, id_type):
            yield b.select([0, 1])

    some = written(docs.filter(F.pmod(F.xxhash64(id_col), F.lit(16)) == 0).mapInArrow(run, schema))
    n = some.count()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16 * n // SEEDS_A_RANGE)
    share = max(LEAST_CUT, n // parts // 2)
    often = some.groupBy("seed").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= share).select("seed")
    at = F.row_number().over(W.partitionBy("seed").orderBy("doc_id"))
    cuts: dict = {}
    for seed, doc in some.join(F.broadcast(often), "seed").withColumn("_at", at).filter(F.col("_at") % share == 0).select("seed", "doc_id").collect():
        cuts.setdefault(seed, set()).add(doc)
    step = (1 << 64) // parts
    steps = {step * i - (1 << 63) for i in range(1, parts)}
    return [c for seed in sorted(steps | set(cuts)) for c in [(seed, None), *[(seed, d) for d in sorted(cuts.get(seed, ()))]]]


def part_of(seed: np.ndarray, doc: pa.Array, borders: list, border_seeds: np.ndarray) -> np.ndarray:
    """The range of each occurrence: how many borders it has reached."""
    low = np.searchsorted(border_seeds, seed, side="left")
    out = np.searchsorted(border_seeds, seed, side="right")
    on = np.flatnonzero(out > low)  # of a seed that has borders
    on = on[np.argsort(low[on], kind="stable")]
    for rows in np.split(on, np.flatnonzero(np.diff(low[on])) + 1):
        ids = [d for _, d in borders[low[rows[0]] + 1:out[rows[0]]]] if len(rows) else []
        if not ids:
            continue
        own = doc.take(pa.array(rows))
        if pa.types.is_integer(doc.type):
            reached = np.searchsorted(np.array(ids), own.to_numpy(), side="right")
        else:
            reached = np.array([bisect.bisect_right(ids, d) for d in own.to_pylist()])
        out[rows] -= len(ids) - reached
    return out


def dealt_seeds(docs: DataFrame, borders: list, k: int, window: int) -> DataFrame:
    """part, rows: the seeds of many documents as one block per range, so that Spark moves blocks and not rows."""
    id_type = docs.schema[0].dataType

    def run(batches):
        border_seeds = np.array([s for s, _ in borders], np.int64)

        def blocks(held):
            t = pa.Table.from_batches(held).combine_chunks()
            part = part_of(t.column(0).to_numpy(), t.column(1).combine_chunks(), borders, border_seeds)
            order = np.argsort(part, kind="stable")
            t, part = t.take(pa.array(order)).combine_chunks().to_batches()[0], part[order]
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            packed = [t.slice(lo, hi - lo).serialize().to_pybytes() for lo, hi in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array(packed, pa.binary())], names=["part", "rows"])

        held, n = [], 0
        for b in seed_batches(batches, k, window, id_type):
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= BLOCK_ROWS:
                yield blocks(held)
                held, n = [], 0
        if held:
            yield blocks(held)

    return docs.mapInArrow(run, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("rows", T.BinaryType())]))


#: Kinds of rows that a sorted range gives: a match, an occurrence whose seed may stand in a range before, the first and
#: last occurrence of a seed at an end of the range, and, per words on one side of such a seed (left, right), the first
#: and the last occurrence with these words.
MATCH, OPEN, EDGE, HEADS, TAILS = 0, 1, 2, (3, 4), (5, 6)


def before_beside(seed: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The occurrence before, of those with the same seed and the same words on one side; -1 without one. Occurrences
    are sorted by seed."""
    out = np.full(len(seed), -1)
    new = np.r_[True, seed[1:] != seed[:-1]]
    several = np.flatnonzero(~(new & np.r_[new[1:], True]))
    order = several[np.lexsort((side[several], seed[several]))]
    same = (seed[order[1:]] == seed[order[:-1]]) & (side[order[1:]] == side[order[:-1]])
    out[order[1:][same]] = order[:-1][same]
    return out


def seed_runs(batches, schema: pa.Schema, borders: list, size: int = 1 << 17):
    """(table, first, last): whole runs of the seeds of a range, sorted by seed, doc_id and pos, from its blocks. first,
    last: the run of the first seed may go back into the range before, that of the last one on into the next."""
    held, parts = [], set()
    for b in batches:
        parts |= set(b.column(0).to_pylist())
        held += [pa.ipc.read_record_batch(pa.py_buffer(x), schema) for x in b.column(1).to_pylist()]
    if not held:
        return
    opens = min(parts) > 0 and borders[min(parts) - 1][1] is not None
    closes = max(parts) < len(borders) and borders[max(parts)][1] is not None
    t = pa.Table.from_batches(held).combine_chunks()
    del held
    if pa.types.is_integer(schema.types[1]):
        order = np.lexsort([t.column(c).to_numpy() for c in (2, 1, 0)])
    else:
        order = pc.sort_indices(t, sort_keys=[(c, "ascending") for c in schema.names[:3]]).to_numpy()
    seed, at = t.column(0).to_numpy()[order], 0
    while at < len(seed):
        end = len(seed) if at + size >= len(seed) else int(np.searchsorted(seed, seed[at + size]))
        if end <= at:  # one seed has them all
            end = int(np.searchsorted(seed, seed[at], side="right"))
        yield t.take(pa.array(order[at:end])).combine_chunks(), opens and at == 0, closes and end == len(seed)
        at = end


def matches(docs: DataFrame, k: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, home, pos, home_pos, near: occurrences of seeds with those in the first and the previous document, the
    one before in the same document, and the ones before with the same words to the left and to the right.
    near: the words beside the seeds agree.

    The last two join the holders of one passage across documents that hold a part of it only. A task holds the
    occurrences of one seed in its range; a frequent seed takes many ranges.
    """
    docs = docs.filter(F.col(id_col).isNotNull()).select(id_col, text_col)
    id_type = docs.schema[id_col].dataType
    borders = seed_borders(docs, k, window)
    here = [T.StructField("doc_id", id_type), T.StructField("pos", T.IntegerType()), T.StructField("left", T.LongType()), T.StructField("right", T.LongType())]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("seed", T.LongType()), *here,
                           *[T.StructField(f"home_{f.name}", f.dataType) for f in here], T.StructField("near", T.BooleanType()), T.StructField("head", T.BooleanType())])

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        part, types = TaskContext.get().partitionId(), [to_arrow_type(f.dataType) for f in schema]

        def rows(kind, t, a, b, near=None, head=None):
            no = np.zeros(len(a), bool)

            def side(c, at):  # a match needs its places only
                return pa.nulls(len(a), types[2]) if kind == MATCH and c not in (1, 2) else t.column(c).take(pa.array(at))

            cols = [np.full(len(a), kind), np.full(len(a), part), side(0, a), *[side(c, a) for c in range(1, 5)],
                    *[side(c, b) for c in range(1, 5)], no if near is None else near, no if head is None else head]
            return pa.RecordBatch.from_arrays([(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c if isinstance(c, pa.Array) else pa.array(c)).cast(x) for c, x in zip(cols, types)], names=schema.names)

        for t, opens, closes in seed_runs(batches, arrow_seeds(id_type), borders):
            seed, doc = t.column(0).to_numpy(), t.column(1).to_numpy()
            n = len(seed)
            index = np.arange(n)
            new = np.r_[True, seed[1:] != seed[:-1]]
            first = np.maximum.accumulate(np.where(new, index, 0))  # of the seed
            own = np.maximum.accumulate(np.where(new | np.r_[True, doc[1:] != doc[:-1]], index, 0))  # of the seed in the document
            bits = [t.column(c).to_numpy().view(np.uint64) for c in (3, 4)]
            beside = [before_beside(seed, side) for side in bits]
            opening = (seed == seed[0]) if opens else np.zeros(n, bool)
            partners = [np.where((own > first) & ~opening, first, -1), np.where(own > first, own - 1, -1), np.where(index > own, index - 1, -1), *beside]
            for k, partner in enumerate(partners):
                taken = partner >= 0
                for other in partners[:k]:
                    taken &= partner != other
                a = np.flatnonzero(taken)
                if len(a):
                    b = partner[a]
                    yield rows(MATCH, t, a, b, agree(bits[0][a], bits[1][a], bits[0][b], bits[1][b]))
            a = np.flatnonzero(opening)
            if len(a):
                yield rows(OPEN, t, a, a, head=doc[a] == doc[0])
                for kind, before in zip(HEADS, beside):
                    c = a[before[a] < 0]
                    yield rows(kind, t, c, c)
            for at_end in ([opening] if opens else []) + ([seed == seed[-1]] if closes and not (opens and seed[0] == seed[-1]) else []):
                a = np.flatnonzero(at_end)
                yield rows(EDGE, t, a[:1], a[-1:])
                for kind, before in zip(TAILS, beside):
                    last = at_end.copy()
                    last[before[a][before[a] >= 0]] = False
                    c = np.flatnonzero(last)
                    yield rows(kind, t, c, c)

    found = written(dealt_seeds(docs, borders, k, window).repartitionById(len(borders) + 1, "part").mapInArrow(run, schema), free=True)
    # two rows a range at most: the first and the last occurrence of a seed in it
    edges = found.filter(F.col("kind") == EDGE).select("seed", "part", *[f"{p}{f.name}" for p in ("", "home_") for f in here]).orderBy("seed", "part").collect()
    before = {}  # the seed's first occurrence, and its last one in a range before
    for n, e in enumerate(edges):
        follows = n > 0 and edges[n - 1].seed == e.seed
        before[e.seed, e.part] = (before[e.seed, edges[n - 1].part][0], tuple(edges[n - 1])[6:]) if follows else (tuple(e)[2:6], None)

    def closed(batches):
        for b in batches:
            part = b.column(0).to_numpy()
            for p in np.unique(part).tolist():
                t = b.filter(pa.array(part == p))
                first, last = before[t.column(1)[0].as_py(), p]
                for home, rows in ((first, t), (last, t.filter(t.column(6)))):
                    if home is None or not rows.num_rows:
                        continue
                    doc = pa.scalar(home[0], b.schema.types[2])
                    rows = rows.filter(pc.or_(pc.greater(rows.column(2), doc), pc.and_(pc.equal(rows.column(2), doc), pc.greater(rows.column(3), home[1]))))
                    n = rows.num_rows
                    sides = [rows.column(c).to_numpy().view(np.uint64) for c in (4, 5)]
                    near = agree(*sides, *[np.full(n, x, np.int64).view(np.uint64) for x in home[2:]])
                    yield pa.RecordBatch.from_arrays([rows.column(2), pa.array([home[0]] * n, b.schema.types[2]), rows.column(3), pa.array(np.full(n, home[1], np.int32)), pa.array(near)],
                                                     names=["doc_id", "home", "pos", "home_pos", "near"])

    links = T.StructType([T.StructField("doc_id", id_type), T.StructField("home", id_type), T.StructField("pos", T.IntegerType()), T.StructField("home_pos", T.IntegerType()), T.StructField("near", T.BooleanType())])
    opened = found.filter(F.col("kind") == OPEN).select("part", "seed", "doc_id", "pos", "left", "right", "head").mapInArrow(closed, links)
    low = F.struct(*[f.name for f in here])
    # of the words on one side, a range has one first and one last occurrence
    is_left = F.col("kind").isin(HEADS[0], TAILS[0])
    ends = found.filter(F.col("kind").isin(*HEADS, *TAILS)).select(
        "seed", is_left.alias("_is_left"), F.when(is_left, F.col("left")).otherwise(F.col("right")).alias("_beside"), "part", F.col("kind").isin(*TAILS).alias("_tail"), *[f.name for f in here], low.alias("_own"))
    earlier = W.partitionBy("seed", "_is_left", "_beside").orderBy("part", "_tail").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("_home", F.last(F.when(F.col("_tail"), F.col("_own")), True).over(earlier)).filter("not _tail")

    def side(c: str):
        x, y = F.col(c), F.col(f"_home.{c}")
        same = F.bit_count(x.bitwiseAND(y))
        return (same > 0) & (2 * same >= F.greatest(F.bit_count(x), F.bit_count(y)))

    carried = carried.filter("_home IS NOT NULL").select("doc_id", F.col("_home.doc_id").alias("home"), "pos", F.col("_home.pos").alias("home_pos"), (side("left") | side("right")).alias("near"))
    return found.filter(F.col("kind") == MATCH).select("doc_id", F.col("home_doc_id").alias("home"), "pos", "home_pos", "near").unionByName(opened).unionByName(carried)


def chains_of(pos: np.ndarray, home: np.ndarray, k: int, gap_cost: float, max_gap: int) -> list[list[int]]:
    """Best chains of matches, as lists of indices; matches are sorted by (pos, home) and each is used once at most."""
    order = np.unique(home)
    ranks, pos, home = (np.searchsorted(order, home) + 1).tolist(), pos.tolist(), home.tolist()
    size = len(order)
    tree = [(-np.inf, -1)] * (size + 1)  # Fenwick tree: best (score + cost of its place, match) up to a rank
    score, back = [float(k)] * len(pos), [-1] * len(pos)
    reach, i, n = max_gap + k, 0, len(pos)
    while i < n:
        j, here = i, pos[i]
        while j < n and pos[j] == here:
            best, prev, r = -np.inf, -1, ranks[j] - 1
            while r > 0:
                entry = tree[r]
                if entry[0] > best:
                    best, prev = entry
                r -= r & -r
            if prev >= 0:
                gain = best - gap_cost * (here + home[j])
                if gain > 0 and here - pos[prev] <= reach and home[j] - home[prev] <= reach:
                    score[j] += gain - max(0, k - min(here - pos[prev], home[j] - home[prev]))
                    back[j] = prev
            j += 1
        for x in range(i, j):  # matches at one position cannot follow each other
            entry, r = (score[x] + gap_cost * (here + home[x]), x), ranks[x]
            while r <= size:
                if entry[0] > tree[r][0]:
                    tree[r] = entry
                r += r & -r
        i = j
    used, out = [False] * n, []
    for x in np.argsort(-np.array(score), kind="stable").tolist():
        chain = []
        while x >= 0 and not used[x]:
            used[x] = True
            chain.append(x)
            x = back[x]
        if chain:
            out.append(chain[::-1])
    return out


def pair_runs(batches, size: int = 1 << 16):
    """(table, starts): whole runs of rows with the same first two columns, many in one table, and where each starts."""
    held, n, full = [], 0, size

    def cut(tables):
        t = pa.Table.from_batches(tables).combine_chunks()
        new = np.ones(t.num_rows, bool)
        new[1:] = False
        for c in t.columns[:2]:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)).to_numpy()
        return t, np.flatnonzero(new)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < full:
            continue
        t, starts = cut(held)
        last = int(starts[-1])
        if last:
            yield t.slice(0, last), starts[:-1]
        held, n = t.slice(last).to_batches(), t.num_rows - last
        full = max(size, 2 * n)
    if held:
        yield cut(held)


def chains(found: DataFrame, k: int, gap_cost: float, max_gap: int, id_type) -> DataFrame:
    """doc_id, home, pos, home_pos, sizes (arrays): the chains between a document and a home, one after another, best
    first, and how many seeds each has. Of chains of one seed, those whose neighbours agree."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("home", id_type), T.StructField("pos", ints), T.StructField("home_pos", ints), T.StructField("sizes", ints)])

    def run(batches):
        held: list = []
        for t, starts in pair_runs(batches):
            every_pos, every_home, every_near = (t.column(c).to_numpy() for c in (2, 3, 4))
            ends = np.r_[starts[1:], t.num_rows]
            some = (ends > starts + 1) | every_near[starts]  # a lone match goes on if the words beside it agree
            starts, ends = starts[some], ends[some]
            for doc, other, lo, hi in zip(t.column(0).take(pa.array(starts)).to_pylist(), t.column(1).take(pa.array(starts)).to_pylist(), starts.tolist(), ends.tolist()):
                pos, home, near = every_pos[lo:hi], every_home[lo:hi], every_near[lo:hi]
                if hi == lo + 1:
                    held.append((doc, other, pos, home, [1]))
                else:
                    one = np.ones(len(pos), bool)
                    one[1:] = (pos[1:] != pos[:-1]) | (home[1:] != home[:-1])
                    pos, home, near = pos[one], home[one], near[one]
                    kept = [c for c in chains_of(pos, home, k, gap_cost, max_gap) if len(c) > 1 or near[c[0]]]
                    if kept:
                        every = list(itertools.chain.from_iterable(kept))
                        held.append((doc, other, pos[every], home[every], [len(c) for c in kept]))
                if len(held) > 2000:
                    yield _rows(held, schema)
                    held = []
        if held:
            yield _rows(held, schema)

    return found.repartition("doc_id", "home").sortWithinPartitions("doc_id", "home", "pos", "home_pos").mapInArrow(run, schema)


def _rows(held: list, schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*held), schema)], names=schema.names)


def edit_matches(a: list, b: list) -> int:
    """Equal words in the best alignment of two short stretches."""
    if not a or not b:
        return 0
    if len(a) == len(b):
        same = sum(map(operator.eq, a, b))
        if same >= len(a) - 1:
            return same
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            above = best[j]
            best[j] = max(above, best[j - 1], before + (x == y))
            before = above
    return best[-1]


def extend(a: list, b: list, i: int = 0, j: int = 0, shift: int | None = None) -> list[tuple[int, int, int]]:
    """[(words of a, words of b, equal words)]: stretches by which two texts go on alike from words i and j.

    Runs of equal words are followed; after a difference the nearest small step to AGAIN equal words goes on. In one
    text, with a from word `shift` on, no step may bring the two together.
    """
    na, nb = len(a), len(b)
    out = []
    while True:
        n, run = min(na - i, nb - j), 0
        while run < n and a[i + run] == b[j + run]:
            run += 1
            if run % 64 == 0:  # most runs end soon
                while run + 64 <= n and a[i + run:i + run + 64] == b[j + run:j + run + 64]:
                    run += 64
        if run:
            out.append((run, run, run))
        i, j = i + run, j + run
        most_x, most_y = na - i - AGAIN, nb - j - AGAIN
        for x, y in STEPS:
            if x <= most_x and y <= most_y and a[i + x] == b[j + y] and a[i + x:i + x + AGAIN] == b[j + y:j + y + AGAIN] and (shift is None or shift + i + x - j - y > 0):
                out.append((x, y, edit_matches(a[i:i + x], b[j:j + y])))
                i, j = i + x, j + y
                break
        else:
            return out


def stretches(a: list, b: list) -> list[tuple[int, int, int]]:
    """What lies between two seeds: what goes on from the first, a gap, and what leads to the second."""
    if not a or not b:
        return [(len(a), len(b), 0)] if a or b else []
    if a == b:
        return [(len(a), len(a), len(a))]
    head = extend(a, b)
    i, j = sum(x for x, _, _ in head), sum(y for _, y, _ in head)
    tail = extend(a[i:][::-1], b[j:][::-1])[::-1]
    p, q = len(a) - sum(x for x, _, _ in tail), len(b) - sum(y for _, y, _ in tail)
    gap = [(p - i, q - j, edit_matches(a[i:p], b[j:q]))] if p > i or q > j else []
    return head + gap + tail


def align(a: list, b: list, back_a: list, back_b: list, pos, home_pos, k: int, same_text: bool = False, offset: int = 0) -> tuple[int, int, list[tuple[int, int, int]]]:
    """(start, home start, stretches) of a chain, aligned between its seeds and extended at both ends. back_a, back_b: the
    words from the last to the first. a starts at word `offset` of its text; places in it count from there."""
    i, j = pos[0], home_pos[0]
    before = extend(back_a, back_b, max(0, len(a) - i), max(0, len(b) - j))
    if same_text:  # read backwards, a step of the home's words more brings the two together
        before = _apart(before, i + offset - j)
    start, home_start = i - sum(x for x, _, _ in before), j - sum(y for _, y, _ in before)
    out, at, to, n = before[::-1], i, j, 0
    while n < len(pos):
        p, h = pos[n], home_pos[n]
        n += 1
        if p < at or h < to:  # the seed overlaps the one before
            step = min(p + k - at, h + k - to)
            if step <= 0:
                continue
            x, y = a[at:p + k], b[to:h + k]
            out.append((p + k - at, h + k - to, len(x) if x == y else edit_matches(x, y)))
        else:
            if p > at or h > to:
                out += stretches(a[at:p], b[to:h])
            x, y = a[p:p + k], b[h:h + k]
            out.append((k, k, 0 if len(x) < k or len(y) < k else k if x == y else sum(map(operator.eq, x, y))))
        at, to, run = p + k, h + k, 0
        while n < len(pos) and pos[n] - home_pos[n] == p - h:  # the next seeds in step, as long as all words are equal
            end = pos[n] + k
            x = a[at:end]
            if len(x) < end - at or x != b[to:home_pos[n] + k]:
                break
            run += end - at
            at, to, n = end, home_pos[n] + k, n + 1
        if run:
            out.append((run, run, run))
    return start, home_start, out + extend(a, b, at, to, offset if same_text else None)


def _apart(found: list[tuple[int, int, int]], shift: int) -> list[tuple[int, int, int]]:
    for n, (x, y, _) in enumerate(found):
        shift += y - x
        if shift <= 0:
            return found[:n]
    return found


def pieces(found: list[tuple[int, int, int]], min_words: int, min_identity: float) -> list[tuple[int, int]]:
    """Ranges of stretches that are passages: all, or else the longest that are similar enough, then the longest of what
    is left on either side. Weak ends are trimmed while enough words are left."""
    if not found:
        return []
    x, y, same = np.array(found).T
    own = np.r_[0, np.cumsum(x)]
    score = np.r_[0, np.cumsum(same - min_identity * np.maximum(x, y))]
    if own[-1] >= min_words and same.sum() >= min_identity * max(own[-1], y.sum()):
        return [(0, len(found))]
    out, todo = [], [(0, len(found))]
    while todo:
        lo, hi = todo.pop()
        if own[hi] - own[lo] < min_words:
            continue
        best = None
        lows = []  # starts with ever lower scores; an end reaches back to the first that is not above its own
        for z in range(lo, hi + 1):
            if not lows or score[z] < score[lows[-1]]:
                lows.append(z)
            left, right = 0, len(lows) - 1
            while left < right:
                mid = (left + right) // 2
                if score[lows[mid]] <= score[z] + 1e-9:
                    right = mid
                else:
                    left = mid + 1
            s = lows[left]
            if own[z] - own[s] >= min_words and (best is None or own[z] - own[s] > best[0]):
                best = (own[z] - own[s], s, z)
        if best is None:
            continue
        _, s, z = best
        first, last = s, z
        for e in range(z - 1, s, -1):
            if score[e] > score[last] and own[e] - own[first] >= min_words:
                last = e
        for e in range(s + 1, last):
            if score[e] < score[first] and own[last] - own[e] >= min_words:
                first = e
        out.append((first, last))
        todo += [(lo, first), (last, hi)]
    return sorted(out)


def passages_of(a: list, b: list, pos, home_pos, sizes, k: int, min_words: int, min_identity: float, same_text: bool = False,
                offset: int = 0, low: int = 0, high: int | None = None) -> list[tuple[int, int, int, int, float]] | None:
    """(start, end, home start, home end, identity) of the passages of two texts; a chain inside one found is not repeated.

    a may be a stretch of its text from word `offset` on, in which places count from its own start. None if an alignment
    came below word `low` or above `high`, where words that are not in the stretch might count.
    """
    out, n, back_a, back_b = [], 0, a[::-1], b[::-1]
    for size in sizes:
        p, h = pos[n:n + size], home_pos[n:n + size]
        n += size
        if any(s <= p[0] and p[-1] + k <= e and hs <= h[0] and h[-1] + k <= he for s, e, hs, he, _ in out):
            continue
        start, home_start, found = align(a, b, back_a, back_b, p, h, k, same_text, offset)
        words = sum(f[0] for f in found)
        if start < low or high is not None and start + words > high:
            return None
        if words < min_words:
            continue
        x, y, same = ([0, *itertools.accumulate(f[c] for f in found)] for c in range(3))
        for lo, hi in pieces(found, min_words, min_identity):
            span = (start + x[lo], start + x[hi], home_start + y[lo], home_start + y[hi])
            if not any(s <= span[0] and span[1] <= e and hs <= span[2] and span[3] <= he for s, e, hs, he, _ in out):
                out.append((*span, (same[hi] - same[lo]) / max(span[1] - span[0], span[3] - span[2], 1)))
    return out


def distinct_neighbours(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values without those that equal the one before, and the place of each row's value among them."""
    new = np.ones(len(column), bool)
    new[1:] = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)), True).to_numpy(zero_copy_only=False)
    return column.take(pa.array(np.flatnonzero(new))), np.cumsum(new) - 1


def stretch_rows(own: DataFrame, k: int, margin: int | None) -> DataFrame:
    """doc_id, home, pos, home_pos, sizes, _from, _rest, _before, _own of chains with their text (`_own`): the words from
    `margin` before the first seed to `margin` after the last, or all. _from and _rest: words left out on either side,
    _before: code points before the stretch."""
    ints = [T.StructField(c, T.IntegerType()) for c in ("_from", "_rest", "_before")]
    schema = T.StructType([*[own.schema[c] for c in ("doc_id", "home", "pos", "home_pos", "sizes")], *ints, T.StructField("_own", T.StringType())])

    def run(batches):
        for b in slices(batches, 5):
            texts, which = distinct_neighbours(b.column(5))
            raw, offsets = text_bytes(texts)
            starts, ends, first = word_places(raw, offsets)
            words = np.diff(first)[which]
            pos = b.column(2)
            row_starts = np.r_[0, np.cumsum(pc.list_value_length(pos).to_numpy())][:-1]
            places = pos.flatten().to_numpy()
            lo, hi = np.zeros(b.num_rows, np.int64), words.copy()
            if margin is not None:
                low, high = np.minimum.reduceat(places, row_starts) - margin, np.maximum.reduceat(places, row_starts) + k + margin
                inside = high - margin <= words  # else the seeds are those of another row with this id
                lo[inside], hi[inside] = np.maximum(low, 0)[inside], np.minimum(high, words)[inside]
            start, end = offsets[which].copy(), offsets[which + 1].copy()
            some = lo < hi
            at = first[which]
            start[some], end[some] = starts[(at + lo)[some]], ends[(at + hi - 1)[some]]
            points = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
            cut = pa.array([raw[x:y].tobytes() for x, y in zip(start.tolist(), end.tolist())], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *[pa.array(c.astype(np.int32)) for c in (lo, words - hi, points[start] - points[offsets[which]])], cut], names=schema.names)

    return own.select("doc_id", "home", "pos", "home_pos", "sizes", "_own").mapInArrow(run, schema)


def aligned(both: DataFrame, k: int, min_words: int, min_identity: float, id_type) -> DataFrame:
    """Passages of stretches (see stretch_rows) with the home's text, `_text`; where a stretch was too short, the chains."""
    counts = [T.StructField(c, T.LongType()) for c in COUNTS]
    ints = T.ArrayType(T.IntegerType())
    chain = [T.StructField(c, ints) for c in ("pos", "home_pos", "sizes")]
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("home_id", id_type), *counts, T.StructField("identity", T.DoubleType()), *chain])

    def run(batches):
        for b in slices(batches, 8, 9):
            own, whole = text_bytes(b.column(8)), distinct_neighbours(b.column(9))
            starts, ends, first = word_places(*own)
            ids = word_hashes(own[0], starts, ends)
            raw, offsets = text_bytes(whole[0])
            places = word_places(raw, offsets)
            home_ids, home_first, told, there = word_hashes(raw, *places[:2]), places[2], -1, []
            points = np.r_[0, np.cumsum((own[0] & 0xC0) != 0x80)]
            held = []
            docs, homes = b.column(0).to_pylist(), b.column(1).to_pylist()
            pos, home_pos, sizes, before, rest, chars = (b.column(c).to_pylist() for c in range(2, 8))
            for n, h in enumerate(whole[1].tolist()):
                x, y = int(first[n]), int(first[n + 1])
                if h != told:
                    told, there = h, home_ids[home_first[h]:home_first[h + 1]].tolist()
                a, out = ids[x:y].tolist(), before[n]
                here = [p - out for p in pos[n]] if out else pos[n]
                found = passages_of(a, there, here, home_pos[n], sizes[n], k, min_words, min_identity, docs[n] == homes[n],
                                    out, LOOK if out else 0, y - x - LOOK if rest[n] else None)
                if found is None:
                    held.append((docs[n], homes[n], *[None] * 8, pos[n], home_pos[n], sizes[n]))
                    continue
                for s, e, hs, he, identity in found:
                    if s < 0 or e > y - x:  # seeds of another row with this id
                        continue
                    origin = points[own[1][n]] - chars[n]
                    held.append((docs[n], homes[n], s + out, e + out, hs, he, int(points[starts[x + s]] - origin), int(points[ends[x + e - 1]] - origin), e - s, identity, None, None, None))
            if held:
                yield _rows(held, schema)

    return both.select("doc_id", "home", "pos", "home_pos", "sizes", "_from", "_rest", "_before", "_own", "_text").mapInArrow(run, schema)


def uncovered(found: DataFrame, least: int) -> DataFrame:
    """Without the passages that add fewer than `least` words to those of the document with smaller homes."""
    def run(batches):
        for t in runs(batches, 1):
            taken = np.zeros(max(t.column("end").to_pylist()), bool)
            keep = []
            for n, (s, e) in enumerate(zip(t.column("start").to_pylist(), t.column("end").to_pylist())):
                if e - s - int(taken[s:e].sum()) >= least:
                    keep.append(n)
                    taken[s:e] = True
            yield from t.take(pa.array(keep)).combine_chunks().to_batches()

    return found.repartition("doc_id").sortWithinPartitions("doc_id", "home_id", "start", F.col("end").desc()).mapInArrow(run, found.schema)


def repeated_passages(docs: DataFrame, k: int = K, window: int = WINDOW, min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY,
                      gap_cost: float = GAP_COST, max_gap: int = MAX_GAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage of a document that an earlier document (a smaller id), or the same one further up, holds too:
    doc_id, home_id, start, end, home_start, home_end (words from 0, ends exclusive), char_start, char_end (code points
    in the document's text), n_words, identity.

    Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Identity is the share of equal words in the longer stretch. A
    null, empty or short text holds no passage; rows without an id take no part; of rows that repeat an id, each is
    compared with the homes of both. Other columns of `docs` are ignored, so their names cannot clash.
    """
    id_type = docs.schema[id_col].dataType
    linked = chains(matches(docs, k, window, id_col, text_col), k, gap_cost, max_gap, id_type)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def found(chained: DataFrame, margin: int | None) -> DataFrame:
        own = chained.join(texts, chained["doc_id"] == texts["_id"]).select("doc_id", "home", "pos", "home_pos", "sizes", F.col("_text").alias("_own"))
        cut = stretch_rows(own, k, margin)
        return aligned(cut.join(texts, cut["home"] == texts["_id"]), k, min_words, min_identity, id_type)

    near = written(found(linked, MARGIN), free=True)
    passages = ["doc_id", "home_id", *COUNTS, "identity"]
    far = near.filter("pos IS NOT NULL").select("doc_id", F.col("home_id").alias("home"), "pos", "home_pos", "sizes").distinct()
    return uncovered(near.filter("pos IS NULL").select(*passages).unionByName(found(far, None).select(*passages)), k)
