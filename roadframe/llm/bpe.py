"""Byte-level BPE by merge replay over a corpus slice.

Spark deals the documents to tasks; a task takes its documents in slices (Arrow batches). The distinct pre-tokens
("words") of a slice form one long symbol list, and an inverted index holds, for every mergeable pair, the positions
where it stands. Ranks leave a heap in ascending order; a rank's merge is applied at all its positions at once, and
only the pairs to the left and right of each position are looked up again. Each distinct word is encoded once per
slice, however often it occurs, and words seen lately are remembered up to a bound.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

#: Words remembered between slices; beyond it the memory is emptied. Only speed depends on it.
REMEMBERED = 400_000
#: Characters of text in one slice.
SLICE_CHARS = 8_000_000


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def word_patterns(pattern: str) -> tuple[str, str | None]:
    """(pattern, or the same with the encoder's own Unicode tables; code points on which both may differ).

    Two regex engines may know different Unicode versions. The encoder is asked for its letters and numbers among the
    code points that this Python's tables leave unassigned. The second value is None where the engines agree.
    """
    import unicodedata

    import tiktoken

    new = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn")
    bytes_only = {bytes([i]): i for i in range(256)}
    disputed: set[str] = set()
    for cls in (r"\p{L}", r"\p{N}"):
        probe = tiktoken.Encoding("probe", pat_str=cls, mergeable_ranks=bytes_only, special_tokens={})
        theirs = set(bytes(probe.encode_ordinary(new)).decode("utf-8"))
        ours = set(regex.findall(cls, new))
        made = cls
        for sign, odd in (("--", ours - theirs), ("||", theirs - ours)):
            if odd:
                made = f"[{made}{sign}[{_ranges(odd)}]]"
        pattern = pattern.replace(cls, made)
        disputed |= ours ^ theirs
    return pattern, f"[{_ranges(disputed)}]" if disputed else None


def _ranges(chars: set[str]) -> str:
    points, out = sorted(map(ord, chars)), []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08X}-\\U{z:08X}" for a, z in out)


class Replay:
    """Encodes words with a rank table by replaying merges over all of them together.

    The words stand one after the other as a list of symbols with links to both neighbours. `index` maps a rank to the
    places of its pairs. A rank with many places is applied to all of them by array operations; the places of a rare
    one, and of a rank whose merges depend on their order inside a word, are taken one by one from the left.
    """

    FEW = 48

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.pairs: dict[int, int | None] = {}
        #: Tokens that a token of a lower rank contains as a half: after such a merge a lower rank can come up.
        self.early = {ranks[h] for t, r in ranks.items() for k in range(1, len(t)) for h in (t[:k], t[k:]) if ranks.get(h, -1) > r}

    def rank_of(self, key: int) -> int | None:
        """Rank of what a pair makes; a pair is first << 20 | second."""
        try:
            return self.pairs[key]
        except KeyError:
            if len(self.pairs) > 4 * REMEMBERED:
                self.pairs.clear()
            r = self.pairs[key] = self.ranks.get(self.tokens[key >> 20] + self.tokens[key & 0xFFFFF])
            return r

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word. A word that is itself a token is that token, as in the public encoder."""
        out: list = [None] * len(words)
        rest = []
        for k, w in enumerate(words):
            r = self.ranks.get(w)
            if r is None:
                rest.append(k)
            else:
                out[k] = [r]
        rest = [k for k in rest if words[k]]
        if not rest:
            return [x or [] for x in out]
        sizes = np.array([len(words[k]) for k in rest])
        start = self.byte[np.frombuffer(b"".join(words[k] for k in rest), dtype=np.uint8)]
        n = len(start)
        ends = np.cumsum(sizes)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        # one memory for single places (fast in Python) and for whole arrays of places
        self.sym, self.nxt, self.prv = (array("q", x.tobytes()) for x in (start, after, before))
        self.word = np.repeat(np.arange(len(rest)), sizes)
        self.index: dict[int, list] = {}
        self.heap: list[int] = []
        at = np.flatnonzero(after >= 0)
        self._add(at, start[at] << 20 | start[at + 1])
        while self.heap:
            r = heapq.heappop(self.heap)
            places = self.index.pop(r, None)
            if places is None:
                continue
            if len(places) <= self.FEW and all(type(p) is int for p in places):
                self._one_by_one(r, sorted(set(places)))
            else:
                self._together(r, np.unique(np.concatenate([np.atleast_1d(p) for p in places])))
        sym, nxt = self.sym, self.nxt
        for k, at in zip(rest, (ends - sizes).tolist()):
            ids, i = [], at
            while i >= 0:
                ids.append(sym[i])
                i = nxt[i]
            out[k] = ids
        return [x or [] for x in out]

    def _add(self, at: np.ndarray, keys: np.ndarray) -> None:
        """Index the pairs `keys` at the places `at`."""
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        cuts = np.flatnonzero(np.diff(keys, prepend=-1)).tolist()
        for a, z in zip(cuts, [*cuts[1:], len(keys)]):
            q = self.rank_of(int(keys[a]))
            if q is not None:
                if q not in self.index:
                    self.index[q] = []
                    heapq.heappush(self.heap, q)
                if z - a > 8:
                    self.index[q].append(at[a:z])
                else:
                    self.index[q].extend(at[a:z].tolist())

    def _together(self, r: int, at: np.ndarray) -> None:
        sym, nxt, prv = (np.frombuffer(x, np.int64) for x in (self.sym, self.nxt, self.prv))
        at = at[(sym[at] >= 0) & (nxt[at] >= 0)]
        second = nxt[at]
        keys = sym[at] << 20 | sym[second]
        good = [k for k in np.unique(keys).tolist() if self.rank_of(k) == r]
        if not good:
            return
        if len(good) > 1 or good[0] >> 20 == good[0] & 0xFFFFF or r in self.early:
            self._one_by_one(r, at.tolist())
            return
        hold = keys == good[0]
        at, second = at[hold], second[hold]
        after = nxt[second]
        sym[at], sym[second], nxt[at] = r, -1, after
        on = after >= 0
        prv[after[on]] = at[on]
        left = prv[at]
        back = left >= 0
        self._add(np.concatenate([left[back], at[on]]), np.concatenate([sym[left[back]] << 20 | r, r << 20 | sym[after[on]]]))

    def _one_by_one(self, r: int, places: list[int]) -> None:
        sym, nxt, prv, index = self.sym, self.nxt, self.prv, self.index
        later, waiting = [], set()
        for i in places:
            j = nxt[i] if sym[i] >= 0 else -1
            if j < 0 or self.rank_of(sym[i] << 20 | sym[j]) != r:
                continue  # a neighbour has changed since
            if waiting and self.word[i] in waiting:
                later.append(i)
                continue
            after = nxt[j]
            sym[i], sym[j], nxt[i] = r, -1, after
            if after >= 0:
                prv[after] = i
            before = prv[i]
            for place, key in ((before, sym[before] << 20 | r if before >= 0 else -1), (i, r << 20 | sym[after] if after >= 0 else -1)):
                if key >= 0 and (q := self.rank_of(key)) is not None:
                    if q not in index:
                        index[q] = []
                        heapq.heappush(self.heap, q)
                    index[q].append(place)
                    if q < r:  # comes before the other places of r in this word
                        waiting.add(self.word[i])
        if later:
            index.setdefault(r, []).extend(later)
            heapq.heappush(self.heap, r)


def slices(texts: list, limit: int = SLICE_CHARS):
    """Runs of texts with about `limit` characters."""
    run, chars = [], 0
    for t in texts:
        run.append(t or "")
        chars += len(run[-1])
        if chars >= limit:
            yield run
            run, chars = [], 0
    if run:
        yield run


class Encoder:
    """Whole texts to id bytes (little-endian unsigned 32-bit)."""

    def __init__(self, vocab_path: str, pattern: str, patched: str, disputed: str | None):
        self.replay = Replay(read_ranks(vocab_path))
        self.plain = regex.compile(pattern).findall
        self.patched = regex.compile(patched, regex.V1).findall
        self.odd = regex.compile(disputed).search if disputed else None
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        odd = self.odd and not text.isascii() and self.odd(text)
        return self.patched(text) if odd else self.plain(text)

    def encode(self, texts: list) -> list[bytes]:
        out = []
        for run in slices(texts):
            split = [self.words(t) for t in run]
            new = list({w for words in split for w in words if w not in self.known})
            if len(self.known) + len(new) > REMEMBERED:
                self.known = {}
                new = list({w for words in split for w in words})
            for w, ids in zip(new, self.replay.encode([w.encode("utf-8") for w in new])):
                self.known[w] = np.asarray(ids, dtype="<u4").tobytes()
            out.extend(b"".join(map(self.known.__getitem__, words)) for words in split)
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_texts(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded text.

    A null text counts as empty: no tokens, and the digests of no bytes. Every row gives a row, repeated ones too;
    null ids stay null. Other columns of `docs` are ignored, so their names cannot clash. `vocab_path` is read by
    every task and must exist on the workers. Special tokens are ordinary text.
    """
    patched, disputed = word_patterns(pattern)
    fields = [docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    fields[0] = T.StructField("doc_id", fields[0].dataType)
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("decoded", T.StringType())]

    def run(batches):
        encoder = Encoder(vocab_path, pattern, patched, disputed)
        for b in batches:
            ids = encoder.encode(b.column(1).to_pylist())
            plain = [encoder.decode(x) for x in ids]
            cols = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in plain], pa.string())]
            if with_ids:
                cols += [pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64())),
                         pa.array([x.decode("utf-8", "replace") for x in plain], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
