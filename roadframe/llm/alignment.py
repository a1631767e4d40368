"""Alignment of two tokenizers over the same text, by windows between white-space anchors.

Both tokenizers encode the whole text. A byte offset where a token of each side ends and where the next token of each
side begins with a space is an anchor; anchors cut a document into windows of token ids. Words repeat, so windows do:
each distinct pair of id tuples is aligned once per task and remembered. Links are counted over the corpus without
sending one row per link or per document: a slice of a task's documents lists its distinct id pairs once, the lists
are added up by pair, and each slice gets the totals of its own pairs back.
"""

from __future__ import annotations

import gc
import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from roadframe.llm import bpe
from roadframe.llm.common import written

#: Characters of the documents that share one list of id pairs, and of those encoded at once. They bound a task's
#: memory, not the result.
SLICE_CHARS, TOGETHER = 4_000_000, 256_000
#: Links of the windows that a task remembers before it starts afresh, between two slices.
REMEMBERED = 1_500_000
#: The reader without its memory: remembered functions travel by name only, and workers need no installed package.
read_ranks = bpe.read_ranks.__wrapped__
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def json_token_bytes(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level JSON tokenizer; its special tokens keep their spelling."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    letters = byte_letters()
    of = {i: bytes(letters[c] for c in t) for t, i in held["model"]["vocab"].items() if all(c in letters for c in t)}
    of |= {t["id"]: t["content"].encode("utf-8") for t in held.get("added_tokens", [])}
    return [of.get(i, b"") for i in range(max(of) + 1)]


def piece_token_bytes(model) -> list[bytes]:
    """Bytes of every piece of a sentencepiece model: U+2581 is a space, byte pieces are their byte."""
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]


class Aligner:
    """Windows of one pair of tokenizers, each aligned once. A window is known by its two tuples of ids, as bytes."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.bytes = bytes_a, bytes_b
        self.size = [np.array([len(t) for t in side], np.int64) for side in self.bytes]
        self.length_a = self.size[0].tolist()
        self.space = [np.array([t[:1] == b" " for t in side]) for side in self.bytes]
        #: Every id with what may follow it in the text of groups: A with "," or "|", B with "," or ";".
        self.spelt = [f"{k}{mark}" for side, marks in zip(self.bytes, (",|", ",;")) for mark in marks for k in range(len(side))]
        self.forget()

    def forget(self):
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.new: list[tuple[bytes, bytes]] = []
        self.text: list[str] = []
        self.groups: list[int] = []
        self.links: list[bytes] = []
        self.held = 0

    def covers(self, ids_a: list[int], ids_b: list[int], plain: bytes) -> bool:
        """Whether both sides spell the text. A byte-level encoder cuts the bytes and changes none, so its length tells."""
        return b"".join(map(self.bytes[1].__getitem__, ids_b)) == plain and sum(map(self.length_a.__getitem__, ids_a)) == len(plain)

    def windows(self, ids_a: list[int], ids_b: list[int]) -> list[int]:
        """Numbers of the document's windows in order. New ones get a number and wait for align_new."""
        a, b = np.array(ids_a, "<u4"), np.array(ids_b, "<u4")
        ends_a, ends_b = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        at = np.searchsorted(ends_b, ends_a[:-1])
        cut = np.flatnonzero((ends_b[at] == ends_a[:-1]) & self.space[0][a[1:]])
        cut = cut[self.space[1][b[at[cut] + 1]]]
        bytes_a, bytes_b, known = a.tobytes(), b.tobytes(), self.known
        out, from_a, from_b = [], 0, 0
        for to_a, to_b in zip([*(4 * cut + 4).tolist(), len(bytes_a)], [*(4 * at[cut] + 4).tolist(), len(bytes_b)]):
            key = bytes_a[from_a:to_a], bytes_b[from_b:to_b]
            w = known.get(key)
            if w is None:
                w = known[key] = len(known)
                self.new.append(key)
            out.append(w)
            from_a, from_b = to_a, to_b
        return out

    def align_new(self) -> None:
        """Align the waiting windows in one go: both sides of a window cover the same bytes, so windows laid end to end
        behave like one document whose borders are ends of both sides."""
        if not self.new:
            return
        (a, ends_a, count_a), (b, ends_b, count_b) = (self._laid_out(k) for k in range(2))
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        links = (a[at_a].astype(np.int64) << 32 | b[at_b]).tobytes()
        shared = ends[(ends_a[at_a] == ends) & (ends_b[at_b] == ends)]
        group = np.concatenate([2 * np.searchsorted(shared, ends_a), 2 * np.searchsorted(shared, ends_b) + 1])
        order = np.argsort(group, kind="stable")
        last = np.append(group[order][1:] != group[order][:-1], True)
        size_a, size_b = map(len, self.bytes)
        token = np.concatenate([a, b.astype(np.int64) + 2 * size_a])[order]
        token += last * np.where(order < len(a), size_a, size_b)
        spelt = list(map(self.spelt.__getitem__, token.tolist()))
        window_ends = ends_a[np.cumsum(count_a) - 1]
        upto = [np.cumsum(count_a + count_b), np.searchsorted(shared, window_ends) + 1, 8 * (np.searchsorted(ends, window_ends) + 1)]
        from_token = from_group = from_link = 0
        for to_token, to_group, to_link in zip(*(u.tolist() for u in upto)):
            self.text.append("".join(spelt[from_token:to_token]))
            self.groups.append(to_group - from_group)
            self.links.append(links[from_link:to_link])
            from_token, from_group, from_link = to_token, to_group, to_link
        self.held += len(links) // 8
        self.new = []

    def _laid_out(self, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, their ends, ids per window) of the waiting windows."""
        ids = np.frombuffer(b"".join(k[side] for k in self.new), "<u4")
        return ids, np.cumsum(self.size[side][ids]), np.array([len(k[side]) // 4 for k in self.new], np.int64)


def slice_pairs(aligner: Aligner, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct windows, place of each window of the slice among them, [distinct pairs, links of each in the slice,
    start of each distinct window's links, place of each link's pair])."""
    windows, local = np.unique(numbers, return_inverse=True)
    links = list(map(aligner.links.__getitem__, windows.tolist()))
    sizes = np.array([len(x) // 8 for x in links], np.int64)
    pairs, place = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True)
    times = np.repeat(np.bincount(local, minlength=len(windows)), sizes)
    total = np.bincount(place, weights=times, minlength=len(pairs)).astype(np.int64)
    return windows, local, [pairs, total, np.cumsum(sizes) - sizes, place]


def encoders(json_path: str, ranks_path: str, pattern: str, piece_path: str):
    """(encode A, encode B, bytes of A's ids, bytes of B's ids). The rank file gives the JSON tokenizer's ids faster."""
    import sentencepiece
    import tiktoken

    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
    model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
    return fast.encode_ordinary, lambda texts: model.encode(texts, num_threads=1), json_token_bytes(json_path), piece_token_bytes(model)


def _aligned(docs: DataFrame, paths: tuple, slice_chars: int) -> DataFrame:
    """Rows of documents with their windows, and one row per slice with its pairs, told apart by `pairs` being null."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS],
        T.StructField("groups_sha256", T.StringType()), T.StructField("slice", T.LongType()),
        T.StructField("windows", T.ArrayType(T.IntegerType())),
        *[T.StructField(c, longs) for c in ("pairs", "links", "starts", "places")]])

    def run(batches):
        gc.disable()  # millions of remembered tuples, no cycles: the collector would walk them again and again
        try:
            yield from slices_of(batches)
        finally:
            gc.enable()

    def slices_of(batches):
        encode_a, encode_b, bytes_a, bytes_b = encoders(*paths)
        aligner = Aligner(bytes_a, bytes_b)
        number = TaskContext.get().partitionId() << 32
        ids, rows, chars = [], [], 0

        def flush():
            nonlocal number, ids, rows, chars
            n, sizes = len(rows), np.array([len(r[-1]) for r in rows] + [0])
            windows, local, lists = slice_pairs(aligner, np.array(list(chain.from_iterable(r[-1] for r in rows)), np.int64))
            ends = np.cumsum(sizes)
            per_doc = [np.diff(np.concatenate([[0], np.cumsum(of[local])])[np.concatenate([[0], ends[:-1]])]) for of in (
                np.array([aligner.groups[w] for w in windows.tolist()], np.int64), np.array([len(aligner.links[w]) // 8 for w in windows.tolist()], np.int64))]
            held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(local, pa.int32()))
            cols = [pa.concat_arrays([*ids, pa.nulls(1, ids[0].type)]),
                    *[pa.array([*(r[k] for r in rows), None], pa.int64()) for k in range(2)],
                    *[pa.array([*x.tolist(), None], pa.int64()) for x in per_doc],
                    pa.array([*(r[2] for r in rows), None], pa.string()), pa.array([number] * (n + 1), pa.int64()), held,
                    *[pa.array([*[None] * n, x], pa.list_(pa.int64())) for x in lists]]
            ids, rows, chars, number = [], [], 0, number + 1
            if aligner.held > REMEMBERED:
                aligner.forget()
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        for batch in batches:
            texts = batch.column(1).to_pylist()
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and size < min(TOGETHER, slice_chars):
                    size += len(texts[last] or "") + 1
                    last += 1
                part = [t or "" for t in texts[first:last]]
                found = []
                for text, ids_b in zip(part, encode_b(part)):
                    ids_a = encode_a(" " + text) if text else []
                    whole = text and aligner.covers(ids_a, ids_b, b" " + text.encode("utf-8"))
                    found.append((len(ids_a), len(ids_b), aligner.windows(ids_a, ids_b)) if whole else None)
                aligner.align_new()
                for held in found:
                    if held is None:
                        rows.append((0, 0, "", []))
                        continue
                    n_a, n_b, numbers = held
                    digest = hashlib.sha256("".join(map(aligner.text.__getitem__, numbers))[:-1].encode()).hexdigest()
                    rows.append((n_a, n_b, digest, numbers))
                ids.append(batch.column(0).slice(first, last - first))
                chars += size
                if chars >= slice_chars:
                    yield flush()
                first = last
        if rows:
            yield flush()

    return docs.mapInArrow(run, schema)


def align_tokens(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, piece_path: str, id_col: str = "doc_id",
                 text_col: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes space + text, B the text (and adds the space itself); special tokens are ordinary text. A null or empty
    text, and one whose tokens' bytes do not give space + text on both sides, has no tokens: zeros and ''. Every row
    gives a row, repeated ones too, and counts in the pair counts; null ids stay null. An empty table gives no rows.
    Other columns of `docs` are ignored, so their names cannot clash. The vocabulary files must exist on the workers.
    """
    paths = json_path, ranks_path, pattern, piece_path
    table = written(_aligned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), paths, slice_chars))
    totals, places = pair_counts(table), _places(table)
    best = totals.select("pair", "count", (F.col("count") == F.max("count").over(W.partitionBy("id_b"))).alias("best"))
    back = places.join(best, "pair").select(F.col("slice").alias("_slice"), "place", "count", "best")
    names = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]
    kinds = {f.name: f.dataType for f in table.schema}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.LongType())) for c in names])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = left.filter(pa.compute.is_valid(left["pairs"]))
        docs_ = left.filter(pa.compute.is_null(left["pairs"]))
        n_best, count_sum = np.zeros(len(docs_), np.int64), np.zeros(len(docs_), np.int64)
        if len(right):
            order = np.argsort(right["place"].to_numpy())
            starts, places_ = (np.array(mine[c][0].values, np.int64) for c in ("starts", "places"))
            held = docs_["windows"].combine_chunks()
            flat, ends = held.flatten().to_numpy(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(held).to_numpy())])
            for c, out in (("best", n_best), ("count", count_sum)):
                per_window = np.add.reduceat(np.asarray(right[c].to_numpy(), np.int64)[order][places_], starts)
                out += np.diff(np.concatenate([[0], np.cumsum(per_window[flat])])[ends])
        return pa.table({c: docs_[c] if c in docs_.column_names else pa.array(n_best if c == "n_best" else count_sum) for c in names})

    return table.groupBy("slice").cogroup(back.groupBy("_slice")).applyInArrow(run, schema)


def _places(table: DataFrame) -> DataFrame:
    held = table.filter(F.col("pairs").isNotNull())
    return held.select("slice", F.posexplode(F.arrays_zip("pairs", "links")).alias("place", "p")).select(
        "slice", "place", F.col("p.pairs").alias("pair"), F.col("p.links").alias("links"))


def pair_counts(table: DataFrame) -> DataFrame:
    """Links of every id pair over the corpus: pair, id_b, count. At most one row per pair of the two vocabularies."""
    return _places(table).groupBy("pair").agg(F.sum("links").alias("count")).withColumn("id_b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))


def vocabulary_map(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, piece_path: str, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """id_a, id_b, count: how often the two tokenizers' ids are linked over all of `docs`."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = pair_counts(_aligned(d, (json_path, ranks_path, pattern, piece_path), SLICE_CHARS))
    return counts.select(F.shiftright("pair", 32).alias("id_a"), "id_b", "count")
