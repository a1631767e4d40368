"""Passages that a document holds beside differing text, with other partners, twice, or with many changes."""

import random

from roadframe.llm import passages


def found(spark, docs):
    return passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()


def words(rng, n):
    return [f"v{rng.randrange(10**6)}" for _ in range(n)]


def test_header_and_footer_around_a_differing_middle(spark):
    rng, docs = random.Random(1), []
    for t in range(20):
        head, foot = words(rng, 50), words(rng, 50)
        docs += [(2 * t + k, " ".join(words(rng, 80) + head + words(rng, 35) + foot + words(rng, 80))) for k in range(2)]
    got = {(r["doc_id"], r["home_id"], a) for r in found(spark, docs) for a in (80, 165) if abs(r["start"] - a) <= 5 and abs(r["end"] - a - 50) <= 5}
    print("header and footer", len(got), "of 40")
    assert got == {(2 * t + 1, 2 * t, a) for t in range(20) for a in (80, 165)}


def test_overlapping_parts_in_earlier_documents(spark):
    rng, docs = random.Random(2), []
    for t in range(20):
        p = words(rng, 60)
        docs += [(10 * t + k, " ".join(words(rng, 80) + part + words(rng, 80))) for k, part in ((1, p[:30]), (2, p[30:]), (3, p), (4, p))]
    got = {(r["doc_id"], r["home_id"]) for r in found(spark, docs)}
    print("overlapping parts", len(got), "of 20")
    assert got == {(10 * t + 4, 10 * t + 3) for t in range(20)}


def test_copies_inside_one_document(spark):
    rng = random.Random(3)
    p, q = words(rng, 60), words(rng, 60)
    w = lambda: words(rng, 80)
    docs = [(1, w() + p + w()), (2, w() + p + w() + p + w()), (3, w() + q + w() + q + w()), (4, w() + p[:6] + w() + p + w())]
    got = {(r["doc_id"], r["home_id"], round(r["start"], -1), round(r["end"], -1)) for r in found(spark, [(k, " ".join(x)) for k, x in docs])}
    print("copies inside", got)
    assert got == {(2, 1, 80, 140), (2, 1, 220, 280), (3, 3, 220, 280), (4, 1, 170, 230)}
    for n in (50, 51):  # a text of one word, and of two in turn
        for r in found(spark, [(1, " ".join(["so"] * n)), (2, "on and " * n)]):
            assert r["doc_id"] == r["home_id"] and r["start"] > r["home_start"]


def test_recall_by_edit_rate(spark):
    rng, docs, n = random.Random(4), [], 0
    for step in (10, 8, 6):
        for _ in range(40):
            p = words(rng, 60)
            q = p[:]
            for k in rng.sample(range(60), 60 // step):
                q[k] = "changed"
            docs += [(2 * n, " ".join(words(rng, 80) + p + words(rng, 80))), (2 * n + 1, " ".join(words(rng, 80) + q + words(rng, 80)))]
            n += 1
    got = {(r["doc_id"], r["home_id"]) for r in found(spark, docs)}
    recall = [sum((2 * k + 1, 2 * k) in got for k in range(i, i + 40)) for i in (0, 40, 80)]
    print("recall of 40 with one change in 10, 8, 6:", recall)
    assert got <= {(2 * k + 1, 2 * k) for k in range(n)} and min(recall) >= 38


def test_partial_holders_between_the_full_ones(spark):
    rng, docs = random.Random(5), []
    for t in range(20):
        p = words(rng, 60)
        docs += [(100 * t + k, " ".join(words(rng, 80) + part + words(rng, 80)))
                 for k, part in ((1, p[:35]), (2, p[25:]), (20, p), (30, p[:35]), (31, p[25:]), (50, p))]
    for parts in (4, 40):  # with 40, seeds reach over ranges
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {(r["doc_id"], r["home_id"]) for r in found(spark, docs)}
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        print("partial holders", len(got), "of 20")
        assert got == {(100 * t + 50, 100 * t + 20) for t in range(20)}


def test_one_passage_in_most_documents(spark):
    rng = random.Random(6)
    p = words(rng, 60)
    docs = [(k, " ".join(words(rng, 30) + (p if k % 10 == 0 else p[:35] if k % 2 else p[25:]) + words(rng, 30))) for k in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    got = {r["doc_id"] for r in found(spark, docs)}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    print("hot passage", len(got), "of 59")
    assert got == set(range(10, 600, 10))


def test_odd_rows(spark):
    rng = random.Random(7)
    p = " ".join(words(rng, 60))
    far = " ".join(words(rng, 200000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, p), (4, p), (5, p.upper()), (None, p), (6, far + " " + p)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, home_id string, seed string")
    got = {(r["doc_id"], r["home_id"], r["start"]) for r in passages.repeated_passages(docs).collect()}
    assert (5, 4, 0) in got and (6, 4, 200000) in got and {g[0] for g in got} <= {4, 5, 6}
