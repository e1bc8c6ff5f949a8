"""Leaked passages against all windows in plain Python."""

import collections
import random
import re

import numpy as np

from tarnwork.llm import decontamination as d


def similarity(a, b):
    a, b = collections.Counter(a), collections.Counter(b)
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def grams(words):
    k = min(5, len(words))
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def brute(text, item):
    """Best similarity over all windows of the item's length."""
    words, own = re.findall(r"\w+", (text or "").lower()), re.findall(r"\w+", (item or "").lower())
    if not words or not own:
        return 0.0
    size = min(len(own), len(words))
    if len(own) < 5 and len(words) < len(own):
        return 0.0
    return max(similarity(grams(words[i : i + size]), grams(own)) for i in range(len(words) - size + 1))


def test_hamming_index_finds_all():
    r = np.random.default_rng(0)
    prints = r.integers(0, 2**63, 300).astype(np.uint64)
    queries = np.concatenate([prints[:50] ^ (np.uint64(1) << r.integers(0, 63, 50).astype(np.uint64)), r.integers(0, 2**63, 300).astype(np.uint64)])
    for radius in (0, 7, 19, 26):
        q, i = d.HammingIndex(prints, radius).search(queries)
        want = {(a, b) for a in range(len(queries)) for b in range(len(prints)) if int(queries[a] ^ prints[b]).bit_count() <= radius}
        assert set(zip(q.tolist(), i.tolist())) == want


def test_matches_equal_brute_force(spark):
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    pick = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(pick(r.randrange(12, 60)))) for i in range(25)] + [(50, None), (51, " ,. "), (52, "tiny Item"), (53, "tiny item"), (54, "aa aa aa aa aa aa aa aa aa"), (None, " ".join(pick(20)))]
    texts = [None, "", "one", "a tiny, item here", "aa " * 30, "item tiny"]
    for i in range(120):
        own = items[r.randrange(25)][1].split()
        for _ in range(r.choice([0, 0, 1, 2])):
            own[r.randrange(len(own))] = r.choice(words)
        own = own[: r.choice([len(own), len(own), len(own) - 2])]
        texts.append(" ".join(pick(r.randrange(80)) + own + pick(r.randrange(80))).upper() if i % 3 else " ".join(pick(100)))
    texts.append(items[-1][1])
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id bigint, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {(i, b): brute(t, x) for i, t in enumerate(texts) for b, x in items}
    want = {k: s for k, s in want.items() if s >= 0.8}
    for block in (2_000_000, 40):
        got = {(g["doc_id"], g["item_id"]): g["similarity"] for g in d.contaminated(docs, bench, block_words=block).collect()}
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert d.contaminated(docs.limit(0), bench).count() == 0
    assert d.contaminated(docs, bench.limit(0)).count() == 0
