"""The whole pipeline against a plain Python version on the small documents."""

import zlib

import duckdb
import numpy as np
import public_tokenizers as P

import corpus_pipeline
from roadframe.llm import pii, twins


def _near_groups(texts, words, percent):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    label = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and label[a] != label[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((label[a], label[b]))
                    label = {i: x if v == y else v for i, v in label.items()}
    return label


def test_pipeline_equals_plain_python(spark, sf):
    from tokenizers import Tokenizer
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    good = {i for i, kept in con.execute(f"SELECT doc_id, kept FROM ({twins.QUALITY})").fetchall() if kept}
    texts = {i: t for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall() if i in good}
    last = {}
    for i in sorted(texts):
        last[texts[i].encode().lower()] = i
    texts = {i: texts[i] for i in sorted(last.values())}
    label = _near_groups(texts, 5, 80)
    texts = {i: t for i, t in texts.items() if label[i] == i}
    anchors, tokenizer = pii.automaton(), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = set()
    for i, t in texts.items():
        ids = np.array(tokenizer.encode(pii.redact(t, pii.find_spans(t, anchors)), add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(ids), 2048):
            piece = ids[at:at + 2048]
            want.add((i, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows} == want and len(rows) == len(want)
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(ends) == list(range(len(ends))) and max(ends.values()) <= 2048
