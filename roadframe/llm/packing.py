"""Packing by shortest-pack-first over the length histogram.

Documents become token ids in one pass; only lengths and checksums go on. A document longer than a sequence is cut
into full sequences and a remainder. The histogram of piece lengths (at most one entry per length) is all that the
packing itself needs: lengths are placed longest first into the open pattern with the most room, if it takes
them, and only the counts of equal patterns are kept. Patterns are then joined back to the pieces by their rank among
pieces of the same length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from roadframe.llm.bpe import read_ranks
from roadframe.llm.common import ordered, written

SPECIAL = "<|endoftext|>"
END_ID = 1


def token_pieces(docs: DataFrame, vocab_json: str, vocab_ranks: str, pattern: str, size: int = 2048,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut every document's ids (its text's, then the end id) into pieces: doc_id, start, length, ids_crc32, doc_tokens
    and, if asked for, ids.

    The rank file holds the same vocabulary as the JSON file and gives the same ids faster; a text that spells the
    special token, which the JSON tokenizer maps to its own id, goes through that tokenizer.
    """
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens")]]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def run(batches):
        import tiktoken
        from tokenizers import Tokenizer

        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(vocab_ranks), special_tokens={})
        full = None

        def ids_of(text):
            nonlocal full
            if SPECIAL in text:
                full = full or Tokenizer.from_file(vocab_json)
                ids = full.encode(text, add_special_tokens=False).ids
            else:
                ids = fast.encode_ordinary(text)
            ids.append(END_ID)
            return np.array(ids, dtype="<u4")

        for b in batches:
            row, start, length, crc, total, held = [], [], [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = ids_of(text or "")
                for at in range(0, len(ids), size):
                    piece = ids[at:at + size]
                    row.append(k)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        held.append(piece.astype(np.int64))
            cols = [b.column(0).take(pa.array(row, pa.int64())), *[pa.array(c, pa.int64()) for c in (start, length, crc, total)]]
            if with_ids:
                cols.append(pa.array(held, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """[(count, lengths longest first)] that use up the histogram; every pattern's sum is at most `size`.

    Works on counts: one step places many equal pieces into many equal patterns, and each length splits at most one
    group of patterns, so there are at most two patterns per length whatever the number of pieces.
    """
    rooms: list[int] = []  # sorted rooms that open patterns have
    groups: dict[int, list[list]] = {}  # room -> [[count, lengths]]
    done: list[tuple[int, tuple[int, ...]]] = []

    def put(room, count, lengths):
        if room == 0:
            done.append((count, lengths))
        elif room in groups:
            groups[room].append([count, lengths])
        else:
            groups[room] = [[count, lengths]]
            bisect.insort(rooms, room)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not rooms or rooms[-1] < length:  # no pattern takes it: open new ones, as full of this length as they get
                each = size // length
                whole, rest = divmod(left, each)
                if whole:
                    put(size - each * length, whole, (length,) * each)
                if rest:
                    put(size - rest * length, 1, (length,) * rest)
                break
            room = rooms[-1]  # the shortest pack; one piece each, then others may be shorter
            count, lengths = groups[room].pop()
            if not groups[room]:
                del groups[room]
                del rooms[-1]
            used = min(count, left)
            if used < count:
                put(room, count - used, lengths)
            put(room - length, used, lengths + (length,))
            left -= used
    for room in rooms:
        done += [(count, lengths) for count, lengths in groups[room]]
    return done


def places(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset, pieces per sequence): where ranks of a length go."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for count, lengths in patterns:
        offset = k = 0
        while k < len(lengths):
            length = lengths[k]
            same = lengths.count(length)
            rank = taken.get(length, 0)
            taken[length] = rank + count * same
            out.append((length, rank, rank + count * same - 1, sequence, offset, same))
            offset += same * length
            k += same
        sequence += count
    return out


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """Add sequence_id (gapless from 0) and offset to rows with doc_id, start and length (1 to `size`).

    Every row is placed once, repeated rows too; null ids sort first. Only the length histogram (at most `size` rows)
    comes to the driver, and the table of places that goes back has at most a few rows per length.
    """
    ranked = ordered(pieces, ["length"], ["doc_id", "start"], "_rank")
    histogram = {int(r["length"]): r["count"] for r in pieces.groupBy("length").count().collect()}
    rows = places(pack_histogram(histogram, size))
    spark = pieces.sparkSession
    at = spark.createDataFrame(rows, "_length bigint, _first bigint, _last bigint, _sequence bigint, _offset bigint, _same bigint")
    hit = ranked.join(F.broadcast(at), (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last")))
    step = F.col("_rank") - F.col("_first")
    return hit.select(*pieces.columns,
                      (F.col("_sequence") + F.expr("(_rank - _first) div _same")).alias("sequence_id"),
                      (F.col("_offset") + step % F.col("_same") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, vocab_json: str, vocab_ranks: str, pattern: str, size: int = 2048,
                   id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    A null text is empty and gives the end id alone. Other columns of `docs` are ignored, so their names cannot clash.
    """
    return pack(written(token_pieces(docs, vocab_json, vocab_ranks, pattern, size, id_col, text_col, with_ids)), size)
