"""Passages from stretches of the documents: the same as from whole texts, with far fewer bytes sent."""

import random

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from roadframe.llm import common, passages, words

TEXT = "doc_id bigint, text string"


def some(rng, n):
    return ["".join(rng.choice("abcdeXYé漢") for _ in range(rng.randint(1, 20))) for _ in range(n)]


def test_hashes_of_many_words_at_once():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abXYZé漢 \t\n\x1c") for _ in range(rng.randrange(200))) for _ in range(300)] + [None, "", " ", *["Q" * k for k in range(40)]]
    for column in (pa.array(texts), pa.array(texts)[7:90]):
        raw, offsets = words.text_bytes(column)
        starts, ends, first = words.word_places(raw, offsets)
        ids = words.word_hashes(raw, starts, ends).tolist()
        got = [ids[x:y] for x, y in zip(first, first[1:])]
        assert got == [[xxhash.xxh3_64_intdigest(w) for w in (t or "").encode().lower().split()] for t in column.to_pylist()]


def made(rng):
    """Copies that go on for long around few shared seeds, with changes, in other scripts, twice in a text, and an id twice."""
    docs = []
    for t in range(12):
        p, q = some(rng, 300), some(rng, 60)
        changed = [w if rng.random() > 0.12 else "other" for w in p]
        docs += [(10 * t + k, " ".join(some(rng, 90) + part + some(rng, 90))) for k, part in ((1, p), (2, changed), (3, q), (4, q + some(rng, 40) + q), (5, p[:200]))]
    return docs + [docs[3], (docs[8][0], docs[9][1])]


def test_short_stretches_give_what_whole_texts_give(spark, monkeypatch):
    docs = spark.createDataFrame(made(random.Random(2)), TEXT)
    found = {}
    for margin in (0, 12, 30, 64, 10**6):
        monkeypatch.setattr(passages, "MARGIN", margin)
        found[margin] = sorted(tuple(r) for r in passages.repeated_passages(docs).collect())
    assert len(found[64]) > 40
    assert all(f == found[10**6] for f in found.values())


def test_characters_count_from_the_start_of_the_text(spark):
    docs = made(random.Random(3))[:-1]
    texts = dict(docs)
    got = passages.repeated_passages(spark.createDataFrame(docs, TEXT)).collect()
    assert any(r.start > 80 for r in got)
    for r in got:
        assert texts[r.doc_id][r.char_start:r.char_end].split() == texts[r.doc_id].split()[r.start:r.end] and r.n_words == r.end - r.start


def test_long_texts_send_the_words_around_their_chains(spark, monkeypatch):
    """Every chain took the whole text of its document to its home."""
    rng = random.Random(4)
    p = some(rng, 60)
    docs = spark.createDataFrame([(k, " ".join(some(rng, 5000) + p + some(rng, 5000))) for k in range(6)], TEXT)
    sent, whole = [], passages.aligned
    monkeypatch.setattr(passages, "aligned", lambda both, *a: sent.append(both.agg(F.sum(F.length("_own"))).first()[0]) or whole(both, *a))
    assert {(r.doc_id, r.n_words >= 55) for r in passages.repeated_passages(docs).collect()} == {(k, True) for k in range(1, 6)}
    longest = docs.agg(F.max(F.length("text"))).first()[0]
    assert sum(s or 0 for s in sent) < longest


def test_shuffle_files_of_the_seeds_do_not_stay(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    d = spark.range(1000).repartition(3)
    assert common.written(d, free=True).count() == 1000 and spark.conf.get(name, None) == before


def test_seeds_of_most_documents_are_cut_into_ranges(spark, monkeypatch):
    """A frequent seed takes many ranges; the matches across them are those of one range."""
    rng = random.Random(5)
    p = some(rng, 60)
    rows = [(k, " ".join(some(rng, 30) + (p if k % 10 == 0 else p[:35] if k % 2 else p[25:]) + some(rng, 30))) for k in range(600)]
    number, name = spark.createDataFrame(rows, TEXT), spark.createDataFrame([(f"d{k:04}", t) for k, t in rows], "doc_id string, text string")
    found = {}
    for kind, docs in (("number", number), ("name", name)):
        for least, parts in ((4096, 4), (4, 40), (1, 300)):
            monkeypatch.setattr(passages, "LEAST_CUT", least)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            cuts = [c for c in passages.seed_borders(docs, passages.K, passages.WINDOW) if c[1] is not None]
            assert bool(cuts) == (least < 4096)
            found[kind, least] = sorted((int(str(r[0]).strip("d")), int(str(r[1]).strip("d")), *r[2:]) for r in passages.repeated_passages(docs).collect())
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {r[0] for r in found["number", 4096]} == set(range(10, 600, 10))
    assert all(f == found["number", 4096] for f in found.values())
