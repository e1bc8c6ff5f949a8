"""The vector index, search under limits and the default pair scorer against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators import hybrid, lexical, limited, nearest, vector_index, vectors
from tarnwork.operators.vector_index import VectorIndex, recall_at
from tarnwork.plans import catalogue

RAGGED = [(100, None), (101, []), (102, [1.0, 0.0, 0.0]), (103, [0.6, None]), (104, [0.6, 0.8])]


def unit(v):
    return [float(x) for x in np.asarray(v) / np.linalg.norm(v)]


def plain_topk(rows, asked, k, allowed=lambda q, i: True):
    out = {}
    for q, v in asked:
        scores = [(-float(np.dot(v, w)), i) for i, w in rows if v and w and None not in v and None not in w and len(v) == len(w) and allowed(q, i)]
        for rank, (s, i) in enumerate(sorted(scores)[:k], 1):
            out[q, rank] = (i, round(-s, 4))
    return out


def ranked(hits):
    return {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in hits.collect()}


def test_ragged_vectors_match_their_own_length(spark):
    rows = [(i, unit([i % 3 + 1, i % 5 - 2])) for i in range(12)] + RAGGED
    asked = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 1.0, 0.0]), (5, [1.0, None]), (6, [1.0, 0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "id int, embedding array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id int, embedding array<double>")
    want = plain_topk(rows, asked, 4)
    assert ranked(vectors.vector_topk(v, q, 4)) == want
    one = F.lit(0).alias("deal")
    got = nearest.grouped_topk(v.select("*", one), q.select("*", one), 4, block_rows=3, block_queries=2)
    assert ranked(got.withColumn("score", F.round("exact", 4))) == want


def test_index_finds_the_neighbours(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    q = e.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    exact = vectors.vector_topk(e, q, 20, exclude_self=True).cache()
    VectorIndex.build(e, str(tmp_path / "index"))
    index = VectorIndex.load(spark, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/vectors")).count() == e.count()  # every row is indexed
    found = index.search(q, 20, exclude_self=True)
    got = recall_at(found, exact, 20).first()
    assert got["wanted"] == exact.count() and got["recall"] >= 0.9
    every = index.search(q, 20, exclude_self=True, probes=len(index.centroids))
    assert ranked(every) == ranked(exact)
    few = index.search(q.limit(1), 20, probes=2)
    assert "PartitionFilters: [isnotnull(list" in few._jdf.queryExecution().toString() or "PartitionFilters: [list" in few._jdf.queryExecution().toString()


def test_index_of_separate_groups_probes_few_lists(spark, tmp_path):
    r = np.random.default_rng(0)
    centres = r.normal(size=(16, 8))
    rows = [(f"v{i}", unit(centres[i % 16] + 0.05 * r.normal(size=8))) for i in range(800)]
    e = spark.createDataFrame(rows, "name string, v array<double>")
    index = VectorIndex.build(e, str(tmp_path / "index"), "name", "v", lists=16)
    assert index.probes <= 3
    q = e.limit(20).select(F.col("name").alias("asked"), "v")
    hits = index.search(q, 5, "asked", "v")
    assert hits.count() == 100 and {r["id"] for r in hits.filter("rank = 1").collect()} == {r["asked"] for r in q.collect()}


def test_index_of_odd_vectors(spark, tmp_path):
    rows = [(i, unit([i + 1, 3 - i])) for i in range(6)] + RAGGED
    e = spark.createDataFrame(rows, "id int, embedding array<double>")
    index = VectorIndex.build(e.orderBy("id"), str(tmp_path / "a"), lists=2)
    stored = spark.read.parquet(str(tmp_path / "a/vectors")).count()
    assert stored in (1, 7)  # of the length that the sample's first vector has
    assert index.search(spark.createDataFrame([(1, None)], "query_id int, embedding array<double>")).count() == 0
    empty = VectorIndex.build(e.limit(0), str(tmp_path / "b"))
    assert VectorIndex.load(spark, str(tmp_path / "b")).search(e.withColumnRenamed("id", "query_id")).count() == 0 and empty.probes == 0


def broadcast_parts(df):
    """The lines of the plan that stand below a broadcast."""
    out, deep = [], None
    for line in df._jdf.queryExecution().executedPlan().treeString().splitlines():
        at = len(line) - len(line.lstrip(" :+-*"))
        deep = None if deep is not None and at <= deep else deep
        if deep is not None:
            out.append(line)
        elif "BroadcastExchange" in line:
            deep = at
    return out


def test_exploded_sides_are_not_broadcast(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(3)
    e = spark.createDataFrame([(i, unit(r.normal(size=8))) for i in range(3000)], "id int, embedding array<double>")
    index = VectorIndex.build(e, str(tmp_path / "index"), lists=60)
    hits = index.search(e.limit(40).withColumnRenamed("id", "query_id"), 5, probes=50)
    assert not [x for x in broadcast_parts(hits) if "Generate" in x or "embedding" in x]
    few = e.filter("id < 50").select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("deal"), F.col("id").alias("query_id"), "embedding")
    dealt = nearest.dealt_blocks(e.withColumn("deal", F.col("id") % 10), few, F.xxhash64("id"), F.xxhash64("query_id"))
    for side in dealt:
        assert not [x for x in broadcast_parts(side) if "Generate" in x or "embedding" in x]
    want = ranked(hits)
    monkeypatch.setattr(nearest, "FEW_DEALS", 0)  # too many sizes to broadcast
    merged = index.search(e.limit(40).withColumnRenamed("id", "query_id"), 5, probes=50)
    assert len(want) == 200 and ranked(merged) == want and not broadcast_parts(merged)


@pytest.mark.parametrize("name", ["vector_index", "vector_index_recall"])
def test_registered_index_queries_broadcast_no_vectors(spark, name):
    hits = catalogue.queries()[name](spark, "/root/testdata/sf0.1")
    assert not [x for x in broadcast_parts(hits) if "Generate" in x or "embedding" in x]


@pytest.mark.parametrize("rows", [40, 90, 100_000])
def test_packs_give_what_their_lists_give(spark, tmp_path, monkeypatch, rows):
    r = np.random.default_rng(5)
    v = np.round(r.normal(size=(600, 6)), 1)  # with ties
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, embedding array<double>")
    index = VectorIndex.build(e, str(tmp_path / "index"), lists=12)
    monkeypatch.setattr(vector_index, "LEAST_ROWS", rows)
    monkeypatch.setattr(vector_index.packed, "__defaults__", (rows,))
    monkeypatch.setattr(vector_index, "QUERIES", 16)
    own = {x["id"]: x["list"] for x in spark.read.parquet(str(tmp_path / "index/vectors")).select("id", "list").collect()}
    sizes = {n: list(own.values()).count(n) for n in set(own.values())}
    packs = vector_index.packed(sizes, index.centroids)
    filled = {p: [sizes[n] for n in sizes if packs[n] == p] for p in {packs[n] for n in sizes}}
    assert all(sum(x) <= rows or len(x) == 1 for x in filled.values()) and set(filled) == set(range(len(filled)))
    stored = [(i, np.float32(x).astype(float).tolist()) for i, x in enumerate(v)]
    asked = [(q, v[q].tolist()) for q in range(0, 600, 7)]
    lists = {q: set(np.argsort(-(index.centroids @ np.array(x)), kind="stable")[:4].tolist()) for q, x in asked}
    want = plain_topk(stored, asked, 6, lambda q, i: q != i and own[i] in lists[q])
    got = index.search(e.filter("id % 7 = 0").withColumnRenamed("id", "query_id"), 6, probes=4, exclude_self=True)
    assert ranked(got) == want


def limits_case(seed, n=90, m=25):
    r = random.Random(seed)
    date = lambda: r.choice([None, "", "2024-02", "odd", "2023-99-01", "1999-12-31", "２０２４"] + [f"202{r.randrange(3, 6)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}"] * 20)
    vector = lambda: unit([r.gauss(0, 1) for _ in range(4)])
    chunks = [(i, vector(), r.choice(["child"] * 9 + ["parent"]), date(), r.choice(["a", "b", "a|b", None]), r.choice(["x", "y", None])) for i in range(n)]
    maybe = lambda f: f() if r.random() < 0.5 else r.choice([None, ""])
    queries = [(q, vector(), maybe(date), maybe(date), maybe(lambda: r.choice("abz")), maybe(lambda: r.choice("xyz"))) for q in range(m)]
    return chunks, queries


def admits(chunk, asked):
    _, _, role, date, authority, category = chunk
    _, _, low, high, a, c = asked
    return role == "child" and (not low or (date is not None and date >= low)) and (not high or (date is not None and date <= high)) and (not a or a == authority) and (not c or c == category)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_limits_equal_the_plain_test(spark, seed, monkeypatch):
    monkeypatch.setattr(nearest.grouped_topk, "__defaults__", (False, None, 16, 4))
    chunks, queries = limits_case(seed)
    if seed == 3:  # no dates at all
        chunks = [(*c[:3], None, *c[4:]) for c in chunks]
    c = spark.createDataFrame(chunks, "id int, embedding array<double>, role string, publish_date string, issuing_authority string, category string").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, embedding array<double>, date_from string, date_to string, issuing_authority string, category string")
    pairs = {(x["query_id"], x["id"]) for x in limited.matching(c, q).collect()}
    assert pairs == {(b[0], a[0]) for a in chunks for b in queries if admits(a, b)}
    assert limited.matching(c, q).count() == len(pairs)
    of, by = {a[0]: a for a in chunks}, {b[0]: b for b in queries}
    want = plain_topk([a[:2] for a in chunks], [b[:2] for b in queries], 5, lambda n, i: admits(of[i], by[n]))
    assert ranked(limited.limited_topk(c, q, 5)) == want
    plan = limited.matching(c, q)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert limited.matching(c.limit(0), q).count() == 0 and limited.matching(c, q.limit(0)).count() == 0


def test_filters_of_either_leg(spark):
    rows = [(i, f"alpha w{i} beta" if i in (2, 5) else f"alpha w{i}", unit([1, i]), "child", f"2024-0{i}-01", "a" if i < 4 else "b", "x") for i in range(1, 8)]
    chunks = spark.createDataFrame(rows, "id int, text string, embedding array<double>, role string, publish_date string, issuing_authority string, category string")
    asked = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0], "2024-03-01", None, "b", "")], "query_id int, query string, embedding array<double>, date_from string, date_to string, issuing_authority string, category string")
    index = lexical.build_index(chunks)
    search = lambda **k: {r["id"] for r in hybrid.hybrid_search(chunks, asked, index, top=10, **k).collect()}
    assert search(limits=True, filter_legs=("vector", "bm25")) == {4, 5, 6, 7}
    assert search(limits=True) == search(limits=True, filter_legs=()) == set(range(1, 8))
    assert search(keep=F.col("id") > 5, filter_legs=("vector", "bm25")) == {6, 7}
    assert search(keep=F.col("id") > 5, limits=True, filter_legs=("vector", "bm25")) == {6, 7}
    first = hybrid.hybrid_search(chunks, asked, index, top=3, limits=True, filter_legs=("vector", "bm25"), score=hybrid.overlap_score).orderBy("rank").collect()
    assert first[0]["id"] == 5 and [r["rerank_score"] for r in first] == [1.0, 0.5, 0.5]


def test_overlap_score(spark):
    pairs = spark.createDataFrame([("one two two", "two three"), ("", "a b"), (None, "x"), ("one", None)], "query string, text string")
    assert [r["rerank_score"] for r in hybrid.overlap_score(pairs).collect()] == [0.5, 0.0, 0.0, 0.0]


def test_neighbours_and_fitting_send_no_rows_through_the_driver(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    made = np.tile(base / np.linalg.norm(base, axis=1, keepdims=True), (50, 1))  # copies tie exactly, in whatever block they are
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(made)], "id long, embedding array<float>")
    q = v.filter("id < 100").withColumnRenamed("id", "query_id")
    for name in ("toLocalIterator", "toArrow", "toPandas"):
        monkeypatch.setattr(type(v), name, lambda *a, **b: pytest.fail("rows sent to the driver"))
    found = {}
    for r in vectors.vector_topk(v, q, 5, exclude_self=True, block=7).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"]))
    assert all(sorted(f) == list(enumerate([i for i in range(n % 40, 2000, 40) if i != n][:5], 1)) for n, f in found.items()) and len(found) == 100
    index = VectorIndex.build(v, str(tmp_path / "index"), sample=256)  # the least hashes alone are sorted
    again = VectorIndex.load(spark, str(tmp_path / "index"))
    assert again.probes == index.probes and (again.centroids == index.centroids).all()
    assert index.search(q, 5, exclude_self=True).count() == 500


def test_formatted_scores_are_rounded_by_their_exact_value(spark):
    values = [207.21855, 0.03125, 1234.00005, 0.00005, 2.5]
    hits = spark.createDataFrame([(i, 1, "s", "t", x) for i, x in enumerate(values)], "query_id int, rank int, source string, text string, score double")
    said = dict(hybrid.format_hits(hits.select("query_id"), hits).collect())
    assert [said[i].split("相关度：")[1].split("\n")[0] for i in range(len(values))] == [f"{x:.4f}" for x in values]


def test_hits_without_a_limit_are_not_held_as_objects():
    import tracemalloc

    import pyarrow as pa

    types = [pa.int64(), pa.int64(), pa.float64()]
    tracemalloc.start()
    made = lexical.tabled(((i // 1000, i, i / 7) for i in range(300_000)), types, ["q", "i", "s"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.num_rows == 300_000 and made["i"].to_pylist()[-1] == 299_999 and made.schema.types == types
    assert lexical.tabled(iter(()), types, ["q", "i", "s"]).num_rows == 0
    assert peak < 12 << 20  # as objects, some 40 MB
