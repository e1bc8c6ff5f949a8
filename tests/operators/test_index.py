"""The posting blocks, their search and the cutting of Han runs against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import lexical, segment
from tarnwork.sources import files


def plain_bm25(chunks, queries, k, keywords=None):
    cut = segment.Segmenter().tokens
    counts = {i: Counter(cut(t)) for i, t in chunks}
    for i, words in (keywords or {}).items():
        if i in counts:
            counts[i].update(words)
    n, df = len(counts), Counter(t for c in counts.values() for t in c)
    mean = sum(sum(c.values()) for c in counts.values()) / n
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for q, text in queries:
        scores = []
        for i, c in counts.items():
            dl = sum(c.values())
            s = sum((low if raw[t] < 0 else raw[t]) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * dl / mean)) for t in cut(text) if t in c)
            scores.append((-round(s, 6), i))
        for rank, (s, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k], 1):
            out[q, rank] = (i, -s)
    return out


def made(seed, n=150, m=12):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    text = lambda low, high: " ".join(words[min(39, int(r.expovariate(0.12)))] for _ in range(r.randrange(low, high)))
    chunks = [(f"c{i:03}", text(0, 60)) for i in range(n)] + [("none", None), ("empty", ""), ("same1", "w1 w2 w3"), ("same2", "w1 w2 w3"), ("num", "12 3.5 77")]
    return chunks, [(q, text(1, 9)) for q in range(m)] + [(98, None), (99, "unknown")]


@pytest.mark.parametrize("seed", [1, 2])
def test_search_is_exact_over_shards_and_blocks(spark, seed, monkeypatch):
    if seed == 2:  # of the workers too: they read these when a task's function is unpickled
        monkeypatch.setattr(lexical, "QUERY_BLOCK", 4)
    chunks, queries = made(seed)
    c = spark.createDataFrame(chunks, "id string, text string").repartition(3)
    q = spark.createDataFrame(queries, "query_id bigint, query string")
    index = lexical.build_index(c)
    for k in (1, 3, 1000):
        got = {(x["query_id"], x["rank"]): (x["id"], x["score"]) for x in lexical.bm25_search(index, q, k).collect()}
        want = plain_bm25(chunks, queries, k)
        assert got.keys() == want.keys()
        for at, (i, s) in want.items():
            assert got[at][0] == i and abs(got[at][1] - s) < 2e-6, at
    kept = lexical.bm25_search(index, q, 3, keep=lambda hits: hits.filter("id > 'c050'")).collect()
    want = {}
    for (query, _), (i, s) in sorted(plain_bm25(chunks, queries, 1000).items()):
        if i > "c050":
            want.setdefault(query, []).append(i)
    assert {(x["query_id"], x["rank"]): x["id"] for x in kept} == {(query, n + 1): i for query, ids in want.items() for n, i in enumerate(ids[:3])}


def test_pruning_changes_nothing():
    import numpy as np

    r = np.random.default_rng(5)
    lengths = r.integers(1, 50, 400)
    for case in range(30):
        rows = []
        for t in range(12):
            docs = np.sort(r.choice(400, r.integers(1, 300), replace=False))
            for a in range(0, len(docs), 64):
                part = docs[a : a + 64]
                tf = r.integers(1, 6, len(part))
                bound = float(lexical.saturation(tf.max(), lengths[part].min(), 20.0))
                asked = [(q, float(w)) for q, w in enumerate(r.exponential(1, 3) * (t % 4 + 0.1) * (-1 if case == 7 and t == 3 else 1)) if (q + t) % 3]
                rows.append((f"t{t}", bound, part, tf, asked))
        weight = {}
        for row in rows:  # one weight a term and query
            row[4][:] = [(q, weight.setdefault((row[0], q), w)) for q, w in row[4]]
        got = {}
        for q, i, s in lexical.best_in_shard(rows, lengths, list(range(400)), 10, 20.0):
            got.setdefault(q, []).append((-s, i))
        for q in range(3):
            acc = np.zeros(400)
            for _, _, docs, tf, asked in rows:
                for a, w in asked:
                    if a == q:
                        acc[docs] += w * lexical.saturation(tf, lengths[docs], 20.0)
            want = sorted((-round(s, 6), i) for i, s in enumerate(acc) if round(s, 6) > 0)[:10]
            assert [i for _, i in got[q]] == [i for _, i in want]


def test_blocks_of_a_shard():
    import pyarrow as pa

    shard = lexical.Shard()
    for n in range(1500):
        shard.add(n, Counter({"common": n % 3 + 1, f"rare{n % 700}": 1}))
    rows = shard.blocks(7, pa.int64()).to_pylist()
    assert rows[0]["term"] is None and rows[0]["ids"] == list(range(1500)) and rows[0]["tf"] == [n % 3 + 2 for n in range(1500)]
    assert [r["term"] for r in rows[1:]] == sorted(r["term"] for r in rows[1:])
    common = [r for r in rows if r["term"] == "common"]
    assert [r["n"] for r in common] == [512, 512, 476] and all(len(r["docs"]) == r["n"] and r["total"] == sum(r["tf"]) and r["most"] == 3 and r["shortest"] == 2 for r in common)
    assert sum(r["total"] for r in rows) == sum(rows[0]["tf"])


def test_scan_of_the_index_is_pruned(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"alpha{i} beta") for i in range(20)], "id int, text string")
    files.save_index(lexical.build_index(chunks), str(tmp_path / "index"))
    index = files.load_index(spark, str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "alpha7 beta")], "query_id int, query string")
    hits = lexical.bm25_search(index, q)
    plan = hits._jdf.queryExecution().toString()
    assert hits.first()["id"] == 7 and "PushedFilters: [Or(IsNull(term),In(term, [alpha7,beta]))" in plan


# ---- Han words


def test_cases_of_the_field():
    cut = segment.Segmenter().tokens
    assert {"中小微企业", "贷款贴息"} <= set(cut("中小微企业贷款贴息政策")) and "专精特新" in cut("专精特新小巨人企业认定")
    assert not {"是", "一"} & set(cut("这是一个测试")) and "重要" in cut("### 第一条 **重要内容**")
    own = segment.Segmenter({"研究": 30, "研究生": 20, "生命": 25, "起源": 10, "命": 3, "生": 5, "贷款": 50, "贴息": 20, "企业": 40, "中小": 9})
    assert own.tokens("研究生命起源") == ["研究", "生命", "起源"]
    assert own.tokens("中小微企业贷款贴息") == ["中小微企业", "贷款贴息"]
    assert segment.Segmenter({"贷款": 50, "贴息": 20}, additions=()).tokens("贷款贴息") == ["贷款", "贴息"]
    assert own.tokens(None) == own.tokens("") == own.tokens("12 3.5%") == [] and own.tokens("ab1 研究 x") == ["ab1", "研究"]
    assert len(own.tokens("研究生命" * 20_000)) == 40_000


def test_best_path_is_the_cheapest_of_all():
    r = random.Random(2)
    for _ in range(200):
        words = {"".join(r.choices("甲乙丙", k=r.randrange(1, 4))): r.randrange(1, 50) for _ in range(8)}
        own = segment.Segmenter(words, additions=())
        run = "".join(r.choices("甲乙丙丁", k=9))

        def paths(rest):
            if not rest:
                yield []
            for size in range(1, len(rest) + 1):
                if size == 1 or rest[:size] in own.costs:
                    yield from ([rest[:size], *tail] for tail in paths(rest[size:]))

        assert abs(own.price(own.cut(run)) - min(own.price(p) for p in paths(run))) < 1e-9


def test_words_learnt_from_a_corpus_cut_it(spark):
    r = random.Random(4)
    signs = [chr(0x4E00 + i) for i in range(400)]
    words = list({"".join(r.sample(signs, r.choice([1, 2, 2, 2, 3, 4]))) for _ in range(160)})
    sentence = lambda: r.choices(words, weights=[1 / (i + 3) for i in range(len(words))], k=r.randrange(4, 12))
    docs = spark.createDataFrame([("，".join("".join(sentence()) for _ in range(5)),) for _ in range(1500)] + [(None,), ("",), ("latin",)], "text string").repartition(3)
    learnt = lexical.dictionary(segment.learn_words(docs))
    own, right, found, given = segment.Segmenter(learnt, additions=()), 0, 0, 0
    for _ in range(300):
        held_out = sentence()
        ends = lambda parts: {sum(map(len, parts[: i + 1])) for i in range(len(parts))}
        a, b = ends(held_out), ends(own.cut("".join(held_out)))
        right, found, given = right + len(a & b), found + len(b), given + len(a)
    assert right / found > 0.95 and right / given > 0.95
    assert segment.learn_words(docs.limit(0)).count() == 0


def test_index_with_a_dictionary(spark, tmp_path):
    docs = spark.createDataFrame([(1, "研究生命起源"), (2, "研究生院"), (3, "其他内容"), (4, "另外一篇")], "id int, text string")
    words = spark.createDataFrame([("研究", 30), ("研究生", 20), ("生命", 25), ("起源", 10), ("院", 5), ("其他", 9), ("内容", 9)], "word string, n bigint")
    files.save_index(lexical.build_index(docs, words=words), str(tmp_path / "index"))
    index = files.load_index(spark, str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "生命"), (2, "研究生")], "query_id int, query string")
    assert sorted((x["query_id"], x["id"]) for x in lexical.bm25_search(index, q).collect()) == [(1, 1), (2, 2)]
    column = docs.select(segment.tokens("text", lexical.dictionary(words)).alias("t")).collect()
    assert column[0]["t"] == ["研究", "生命", "起源"]


def test_column_and_segmenter_agree(spark):
    r = random.Random(6)
    parts = ["中小企业", "企业", "的", "钱", "a", "bc", "12", "3.5", " ", "，", "é", "ß1", "_", "增值税", "-", "ﬁx", "x²", "\n"]
    texts = ["".join(r.choices(parts, k=15)) for _ in range(300)] + [None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    cut = segment.Segmenter().tokens
    for x in rows.select("text", F.coalesce(lexical.tokenize("text"), F.array()).alias("t")).collect():
        assert x["t"] == cut(x["text"]), x["text"]
