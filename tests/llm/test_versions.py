"""Fingerprints against plain multiset arithmetic and plain neighbours in id order."""

import hashlib
import random
from collections import Counter

import numpy as np

from roadframe.llm import versions as V
from roadframe.llm.queries import QUERIES

LONG = " ".join(f"w{k}" for k in range(30000))
SCHEMA = "doc_id bigint, text string, range string, at string, n_chars bigint, fingerprint string"


def alike(a, b):
    a, b = Counter(V.parts_of(a)), Counter(V.parts_of(b))
    return sum((a & b).values()) / sum((a | b).values()) if a | b else 1.0


def check(got, rows):
    """`rows` in order; every result equals the plain one."""
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    seen = Counter()
    for (i, text), (_, after) in zip(rows, [*rows[1:], *rows[:1]]):
        k = len(text) // 2
        edited = text[:len(text) - k] + after[:k]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        r = next(r for r in by[i] if (r["n_chars"], r["edited_sha256"]) == (len(text), sha))
        assert abs(r["near_edited"] - alike(text, edited)) < 1e-12 and abs(r["near_next"] - alike(text, after)) < 1e-12
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited)
        seen[i] += 1
    assert seen == Counter(r["doc_id"] for r in got)


def test_query_against_plain_python(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = sorted((r["doc_id"], r["text"] or "") for r in d)
    got = QUERIES["op11_fingerprints"](spark, sf).collect()
    check(got, rows)
    prints = {}
    for r in got:
        prints.setdefault(r["fingerprint"], set()).add(dict(rows)[r["doc_id"]])
    assert all(len(t) == 1 for t in prints.values())


def test_odd_rows(spark):
    rows = [(None, "no id"), (1, ""), (2, " "), (3, "same"), (4, "same"), (5, LONG), (6, "é" * 9), (7, "a\n" * 500), (8, "a\n" * 499), (9, "🙂🙂🙂")]
    d = spark.createDataFrame([(i, t or None, "x", "y", None, "z") for i, t in random.Random(1).sample(rows, len(rows))], SCHEMA).repartition(3)
    got = V.half_edit_report(d).collect()
    check(got, rows)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["fingerprint"] == by[4]["fingerprint"] and by[3]["near_next"] == 1.0 and by[7]["near_next"] > 0.99
    assert by[1]["n_chars"] == 0 and by[1]["near_edited"] == 1.0


def test_lone_repeated_and_no_rows(spark):
    one = V.half_edit_report(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).collect()
    assert [(r["n_chars"], r["edited_sha256"]) for r in one] == [(4, hashlib.sha256(b"abab").hexdigest())]
    same = V.half_edit_report(spark.createDataFrame([(1, "abcd")] * 7, "doc_id bigint, text string")).collect()
    assert len(same) == 7 and {r["near_next"] for r in same} == {1.0}
    assert V.half_edit_report(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_compare_recovers_the_differing_digests(spark):
    old = "".join(f"paragraph {k} of some length, not short at all\n" for k in range(400))
    cases = [(1, old, old.replace("graph 7 of", "graph 7 OF")), (2, None, None), (3, old, None), (4, old, old), (4, old, old)]
    got = {r["id"]: r for r in V.compare_versions(spark.createDataFrame(cases, "id long, a string, b string"), "id", "a", "b").collect()}
    for i, a, b in cases:
        da, db = ({int(x) for x in V.part_digests(t or "").view(np.int64)} for t in (a, b))
        assert set(got[i]["gone"]) == da - db and set(got[i]["came"]) == db - da
    assert got[1]["cells"] == V.CELLS and got[3]["cells"] > V.CELLS and got[4]["likeness"] == 1.0 and got[2]["likeness"] == 1.0 and got[3]["likeness"] == 0.0
    assert V.compare_versions(spark.createDataFrame([], "id long, a string, b string"), "id", "a", "b").collect() == []


def test_parts_are_the_text_and_survive_edits_elsewhere():
    r = random.Random(3)
    text = "".join(r.choice("abcdefgh \n") for _ in range(5000))
    assert b"".join(V.parts_of(text)).decode() == text
    changed = text[:2500] + "X" + text[2501:]
    assert len(set(V.parts_of(text)) ^ set(V.parts_of(changed))) <= 8
