"""Links and components against all pairs in plain Python."""

import random
import re

import pytest

from tarnwork.llm import jaccard
from tarnwork.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, num, den):
    sets, parent = [grams(t, k) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return sorted(((d, len(sets[i]), best.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(150)] + ["É", "the", "of"] * 20
    base = [[r.choice(vocabulary) for _ in range(r.randrange(20, 160))] for _ in range(12)]
    passage = [r.choice(vocabulary) for _ in range(12)]
    texts = [None, "", " \n", "One", "one", "two words", "TWO  words", "a b c", "a b c"]
    for b in base:
        for _ in range(9):
            t = list(b)
            for _ in range(r.randrange(0, 4)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.append(" ".join(t + (passage if r.random() < 0.3 else [])))
    line = [r.choice(vocabulary) for _ in range(300)]  # a long chain of small steps
    for _ in range(25):
        line = list(line)
        line[r.randrange(300)] = r.choice(vocabulary)
        line[r.randrange(300)] = r.choice(vocabulary)
        texts.append(" ".join(line))
    texts += [texts[20]] * 5
    ids = list(range(len(texts)))
    r.shuffle(ids)
    return list(zip(ids, texts)) + [(None, texts[20]), (ids[30], texts[30]), (None, "alone in here")]


@pytest.mark.parametrize("k,num,den,block", [(3, 90, 100, 20_000), (5, 80, 100, 7)])
def test_components_equal_all_pairs(spark, k, num, den, block):
    rows = corpus(k)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, n int").repartition(3)
    got = jaccard.jaccard_components(docs, k, num, den, block=block).collect()
    assert sorted(((g["doc_id"], g["n_shingles"], g["component_id"]) for g in got), key=str) == brute(rows, k, num, den)


def test_empty(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_contraction_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(50)] + [(5, 5), (7, 6), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert len(got) == 252 and len({got[i] for i in range(201)}) == 1 and len({got[1000 + i] for i in range(51)}) == 1 and got[0] != got[1000]
