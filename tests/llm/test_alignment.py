"""Token alignment against a plain version by byte ranges, with the JSON tokenizer itself."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from roadframe.llm import alignment as A
from roadframe.llm.queries import QUERIES

PATHS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def spans(sizes):
    at, out = 0, []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return out


def plain(rows):
    """[(id, results)] by comparing byte ranges; no windows, no memory."""
    one = Tokenizer.from_file(PATHS[0])
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=PATHS[3])
    bytes_a, bytes_b = A.json_token_bytes(PATHS[0]), A.piece_token_bytes(two)
    docs, counts = [], Counter()
    for i, text in rows:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(of[k] for k in ids) != whole for of, ids in ((bytes_a, a), (bytes_b, b))):
            docs.append((i, None))
            continue
        sa, sb = spans([len(bytes_a[k]) for k in a]), spans([len(bytes_b[k]) for k in b])
        shared = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, links, at, k, m = [], [], 0, 0, 0
        for end in shared:
            ga, gb = [], []
            while k < len(sa) and sa[k][1] <= end:
                ga.append((a[k], sa[k]))
                k += 1
            while m < len(sb) and sb[m][1] <= end:
                gb.append((b[m], sb[m]))
                m += 1
            groups.append(",".join(str(x) for x, _ in ga) + "|" + ",".join(str(x) for x, _ in gb))
            links += [(x, y) for x, (s, e) in ga for y, (t, f) in gb if s < f and t < e]
        counts.update(links)
        docs.append((i, (len(a), len(b), groups, links)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(i, (0, 0, 0, 0, 0, 0, "") if d is None else (
        d[0], d[1], len(d[2]), len(d[3]), sum(counts[p] == best[p[1]] for p in d[3]), sum(counts[p] for p in d[3]),
        hashlib.sha256(";".join(d[2]).encode()).hexdigest())) for i, d in docs], counts


def same(got, rows):
    expected, _ = plain(rows)
    assert Counter((r["doc_id"], *(r[c] for c in NAMES)) for r in got) == Counter((i, *v) for i, v in expected)


def test_query_against_plain_python(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    same(QUERIES["op12_alignment"](spark, sf).collect(), [(r["doc_id"], r["text"]) for r in d])


ODD = [(1, None), (2, ""), (3, " "), (4, "a  b\n\nc\t d"), (5, "naïve café 東京 🙂 Ελλάδα"), (6, "x <|endoftext|> y <s> </s> <0x41>"), (7, "▁ literal"),
       (8, "word " * 3000), (9, "q" * 3000), (None, "no id"), (None, None), (10, "same text"), (10, "same text"), (11, " nbsp line"), (12, "  lead")]


def test_odd_rows_in_small_slices(spark):
    d = spark.createDataFrame([(i, t, 1, "x", [2]) for i, t in ODD], "doc_id bigint, text string, slice int, pairs string, windows array<int>").repartition(3)
    for chars in (1, 100, 10 ** 6):
        same(A.align_tokens(d, *PATHS, slice_chars=chars).collect(), ODD)


def test_no_rows(spark):
    assert A.align_tokens(spark.createDataFrame([], "doc_id bigint, text string"), *PATHS).collect() == []


def test_vocabulary_map(spark):
    d = spark.createDataFrame(ODD, "doc_id bigint, text string")
    got = {(r["id_a"], r["id_b"]): r["count"] for r in A.vocabulary_map(d, *PATHS).collect()}
    assert got == dict(plain(ODD)[1])


@pytest.mark.parametrize("limit", [0, 10])
def test_forgetting_changes_nothing(spark, monkeypatch, limit):
    monkeypatch.setattr(A, "REMEMBERED", limit)
    test_odd_rows_in_small_slices(spark)
