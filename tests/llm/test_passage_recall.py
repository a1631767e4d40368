"""Exact repeats in the documents themselves, against a table of all windows of fifty words."""

import re

from roadframe.llm import passages

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_every_repeated_window_is_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: re.findall(WORDS, (r["text"] or "").translate({c: c + 32 for c in range(65, 91)})) for r in docs.collect()}
    seen, want = {}, {}  # window -> its first place; document -> words in windows that stand further up or in a smaller document
    for d in sorted(texts):
        w = texts[d]
        for k in range(len(w) - 49):
            at = seen.setdefault(tuple(w[k:k + 50]), (d, k))
            if at[0] < d or at[1] + 50 <= k:
                want.setdefault(d, set()).update(range(k, k + 50))
    got: dict = {}
    for r in passages.repeated_passages(docs).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    words = sum(map(len, want.values()))
    found = sum(len(x & got.get(d, set())) for d, x in want.items())
    docs_found = sum(d in got for d in want)
    print(f"documents {docs_found} of {len(want)}, words {found} of {words}")
    assert len(want) > 10 and docs_found >= 0.98 * len(want) and found >= 0.98 * words
