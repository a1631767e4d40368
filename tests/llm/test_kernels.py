"""Operators against brute force on the small tables and on random input."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest

import __spark_entry__ as entry
from roadframe.llm import bpe, packing, passages, pii, sharding


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, sf, name):
    return entry.queries()[name](spark, sf).collect()


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_pii_base_spans_on_the_documents(spark, sf, texts):
    for r in rows(spark, sf, "op7_pii"):
        base = base_spans(texts[r["doc_id"]] or "")
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[1] == k for s in base) for k in range(4)]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))


def test_pii_base_spans_on_random_texts():
    rng, anchors = random.Random(3), pii.automaton()
    parts = ["4111 1111 1111 1111", "1.2.3.4", "300.1.1.1", "01.002.3.4.5.6.7.8", "a@b.c@d.e", "+1 (499) 555-6503", "+12", "x@y@z.com", "é@ü.de", "1" * 5000]
    for _ in range(3000):
        t = "".join(rng.choice("@@..%+-- 0123456789ab()é") for _ in range(rng.choice([5, 60])))
        t += " ".join(rng.choice(parts) for _ in range(3))
        assert [s for s in pii.find_spans(t, anchors) if s[1] < 4] == base_spans(t)


def test_pii_cues():
    found = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.find_spans(t, pii.automaton())]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in found("Pay to IBAN DE89 3704 0044 0532 0130 00 today")
    assert ("account", "12345678") in found("account number: 12345678 is hers")
    assert ("secret", "1eb9c654e721b4f812088970e66a6345") in found('token = "1eb9c654e721b4f812088970e66a6345"')
    assert ("url", "https://ann:pw@host.example/x") in found("see https://ann:pw@host.example/x.")
    assert found("see http://www.apache.org/licenses/ and a token of thanks, on account of 12 things") == []
    assert pii.redact("a x@y.de b", pii.find_spans("a x@y.de b", pii.automaton())) == "a [EMAIL] b"


def test_bpe_equals_the_public_encoder(spark, sf, texts):
    import tiktoken
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows(spark, sf, "op10_bpe"):
        t = texts[r["doc_id"]] or ""
        ids = np.asarray(public.encode_ordinary(t), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    rng = random.Random(4)
    chars = lambda: rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x600), rng.randrange(0x600, 0xD800), rng.randrange(0xE000, 0x110000), 10, 32, 0x85, 0x558])
    odd = ["".join(chr(chars()) for _ in range(rng.choice([1, 5, 60]))) for _ in range(1500)]
    odd += ["", "  ", "a" * 3000, "abaab" * 300, "<|endoftext|>", "é" * 999, "".join(rng.choice("abcd") for _ in range(9000))]
    encoder = bpe.Encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, *bpe.word_patterns(P.PATTERN))
    for t, ids in zip(odd, encoder.encode(odd)):
        assert np.frombuffer(ids, "<u4").tolist() == public.encode_ordinary(t)
        assert encoder.decode(ids) == t.encode()


def test_packing_places_every_id_once(spark, sf, texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, used = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows(spark, sf, "op9_packing"):
        pieces[r["doc_id"]].append(r)
        used[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, mine in pieces.items():
        ids = np.array(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(mine, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:at].tobytes())
        assert at == len(ids)
    assert sorted(used) == list(range(len(used)))
    for mine in used.values():
        at = 0
        for r in sorted(mine, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    total = sum(r["length"] for mine in used.values() for r in mine)
    assert len(used) <= 1.02 * total / 2048 + 1


def test_histogram_packing_uses_every_piece():
    rng = random.Random(5)
    for _ in range(20):
        h = dict(collections.Counter(rng.choice([rng.randrange(1, 2049), rng.randrange(1, 300), 37]) for _ in range(rng.choice([1, 50, 5000]))))
        used = collections.Counter()
        for count, lengths in packing.pack_histogram(h, 2048):
            assert sum(lengths) <= 2048
            for x in lengths:
                used[x] += count
        assert used == h


def _smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, need, held = (low + high) // 2, 1, 0
        for s in sizes:
            if held + s > mid:
                need, held = need + 1, 0
            held += s
        low, high = (low, mid) if need <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("hot", [0, 40])
def test_sharding_capacity_and_balance(spark, hot):
    rng = random.Random(6)
    texts = [(i, "x" * rng.randrange(0, 50) + str(i)) for i in range(120)] + [(200 + i, "hot" * 20) for i in range(hot)]
    got = {r["doc_id"]: r for r in sharding.shard(spark.createDataFrame(texts, "doc_id bigint, text string"), 8).collect()}
    groups = collections.OrderedDict()
    for i, t in sorted(texts):
        groups.setdefault(t, []).append(i)
    sizes = [len(ids) * (len(t) + 1) for t, ids in groups.items()]
    by = collections.Counter()
    for i, t in texts:
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(t) + 1, zlib.crc32(t.encode()))
        by[got[i]["shard"]] += len(t) + 1
    assert max(by.values()) <= _smallest_capacity(sizes, 8)
    for ids in groups.values():
        assert len({got[i]["shard"] for i in ids}) == 1
    for s in by:
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got.values())))
    if not hot:
        assert set(by) == set(range(8)) and max(by.values()) - min(by.values()) <= 2 * max(sizes)


def _sets(texts, n):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    return out


def _components(sets, percent):
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_all_pairs(spark, sf, texts):
    sets = _sets(texts, 3)
    want = _components(sets, 85)
    for r in rows(spark, sf, "op8_minhash"):
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_in_one_large_group(spark):
    """Copies with random edits: links of every strength around the threshold, over several blocks."""
    from roadframe.llm import neardup
    rng = random.Random(7)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = {}
    for i in range(420):
        t = base[:]
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9])):
            t[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        texts[i] = " ".join(t)
    want = _components(_sets(texts, 3), 85)
    assert 1 < len(set(want.values())) < 400
    old = neardup.BUCKET_BLOCK, neardup.TEXT_BLOCK
    neardup.BUCKET_BLOCK, neardup.TEXT_BLOCK = 64, 64
    try:
        got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    finally:
        neardup.BUCKET_BLOCK, neardup.TEXT_BLOCK = old
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_passages_find_planted_ones_and_leave_others(spark):
    rng = random.Random(8)
    words = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    plain, edited, docs = words(60), words(80), []
    fuzzy = edited[:]
    for k in (20, 45, 70):
        fuzzy[k] = "changed"
    del fuzzy[33]
    for i in range(30):
        inner = {3: plain, 7: plain, 9: plain, 12: edited, 20: fuzzy}.get(i, [])
        docs.append((i, " ".join(words(70) + inner + words(90))))
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["home_id"]) for r in got) == [(7, 3), (9, 3), (20, 12)]
    for r in got:
        assert abs(r["start"] - 70) <= 2 and abs(r["end"] - r["start"] - (79 if r["doc_id"] == 20 else 60)) <= 3
        text = dict(docs)[r["doc_id"]]
        assert text[r["char_start"]:r["char_end"]].split() == text.split()[r["start"]:r["end"]]


def test_chain_scores_equal_a_quadratic_search():
    rng = random.Random(9)
    for _ in range(50):
        m = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(25)})
        pos, home = np.array([p for p, _ in m]), np.array([h for _, h in m])
        best = [5.0] * len(m)
        for i in range(len(m)):
            for j in range(i):
                if m[j][0] < m[i][0] and m[j][1] < m[i][1]:
                    p, h = m[i][0] - m[j][0], m[i][1] - m[j][1]
                    gain = best[j] - 0.05 * (p + h)
                    if gain > 0:
                        best[i] = max(best[i], 5 + gain - max(0, 5 - min(p, h)))
        chains = passages.chains_of(pos, home, 5, 0.05, 1000)
        for c in chains:
            assert all(m[a][0] < m[b][0] and m[a][1] < m[b][1] for a, b in zip(c, c[1:]))
        assert len({x for c in chains for x in c}) == sum(map(len, chains))
