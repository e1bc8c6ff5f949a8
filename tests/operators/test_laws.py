"""Laws of chunking, containment, search and the cache on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwork.functions import metadata
from tarnwork.operators import cache, chunking, evaluation, hybrid, lexical, store, vectors


def test_overlap_counts_no_last_line_feed():
    a, b, c = "a" * 650, "b" * 100, "c" * 200
    assert chunking.pack_lines("\n".join([a, b, c])) == [f"{a}\n{b}", f"{b}\n{c}"]
    assert chunking.pack_lines("") == [""] and chunking.pack_lines(None) == []
    assert chunking.pack_lines("\n" * 900)  # a long text is never lost as a whole


@pytest.mark.parametrize("seed", range(40))
def test_chunk_laws(seed):
    """Chunks cover the text in order; each begins with an overlap and ends before it is too long."""
    r = random.Random(seed)
    lines = ["x" * r.randrange(0, 30) for _ in range(r.randrange(1, 60))] + ["end"]
    text, size, overlap = "\n".join(lines), r.randrange(20, 90), r.randrange(0, 19)
    parts = chunking.pack_lines(text, size, overlap)
    if len(text) <= size:
        assert parts == [text]
        return
    done = 0
    for i, part in enumerate(parts):
        own = part.split("\n")
        new = next(k for k in range(len(own), 0, -1) if lines[done : done + k] == own[len(own) - k :]) if i else len(own)
        repeated = own[: len(own) - new]
        assert len("\n".join(repeated)) <= overlap and lines[done - len(repeated) : done] == repeated
        assert len(part) + 1 <= size or new == 1
        done += new
    assert done == len(lines)


def test_containing(spark):
    docs = spark.createDataFrame([(1, "a", "one two three four five six seven eight"), (2, "b", "x one two y"), (None, "c", "onetwo zone two"), (4, "d", None), (5, "e", "")], "doc_id bigint, source string, text string")
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "e two three four five six seven e"), (3, "one two"), (4, "two"), (5, "absent words are not in here at all")], "query_id bigint, item string")
    for chars in (1, 40, 1 << 20):  # one item a block, a few, all
        got = [(r["query_id"], r["source"]) for r in evaluation.containing(docs, items, item_chars=chars).collect()]
        assert sorted(got) == [(1, "a"), (2, "a"), (3, "a"), (3, "b"), (3, "c"), (4, "a"), (4, "b"), (4, "c")]
    odd = spark.createDataFrame([("q", ""), ("r", None), ("s", "x"), ("t", "x")], "query_id string, item string")
    assert sorted((r["query_id"], r["source"]) for r in evaluation.containing(docs, odd).collect()) == [("q", "a"), ("q", "b"), ("q", "c"), ("q", "e"), ("s", "a"), ("s", "b"), ("t", "a"), ("t", "b")]
    assert evaluation.containing(docs, odd.limit(0)).count() == 0 and evaluation.containing(docs.limit(0), odd).count() == 0


def test_vector_topk_takes_any_ids_and_null_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [1.0, 0.0]), ("e", [0.6, 0.8])]
    v = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(2)
    q = v.withColumnRenamed("id", "query_id")
    for block in (1, 2, 4096):
        got = sorted((r["query_id"], r["rank"], r["id"]) for r in vectors.vector_topk(v, q, 2, exclude_self=True, block=block).collect())
        assert got == [("a", 1, "d"), ("a", 2, "e"), ("b", 1, "e"), ("b", 2, "a"), ("d", 1, "a"), ("d", 2, "e"), ("e", 1, "b"), ("e", 2, "a")]
    assert vectors.vector_topk(v.limit(0), q, 2).count() == 0 and vectors.vector_topk(v, q.limit(0), 2).count() == 0


def test_cache_lookup_forgets(spark):
    held = spark.createDataFrame([("old", [1.0, 0.0], "2024-01-01 00:00:00"), ("new", [0.9, 0.1], "2024-01-02 12:00:00")], "key string, embedding array<float>, ts string").withColumn("ts", F.to_timestamp("ts"))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id bigint, embedding array<float>")
    got = {r["query_id"]: r["key"] for r in cache.cache_lookup(held, q, F.lit("2024-01-03 00:00:00").cast("timestamp"), threshold=0.8).collect()}
    assert got == {1: "new", 2: None}


def test_evicted_entries_are_the_oldest(spark):
    import random

    r = random.Random(7)
    time = lambda: r.choice([None, "2024-01-01 00:00:00"] + [f"2024-01-{r.randrange(2, 29):02} 00:00:{r.randrange(60):02}" for _ in range(3)])
    rows = [(f"k{i:03}", time()) for i in range(200)]
    held = spark.createDataFrame(rows, "key string, t string").select("key", F.to_timestamp("t").alias("last_accessed")).repartition(3)
    oldest = sorted(sorted(rows), key=lambda x: x[1] or "", reverse=True)  # stable: ties by key
    for size in (0, 1, 37, 100, 170, 199, 200, 500):
        for take in (0, 1000):
            got = {x["key"] for x in cache.cache_evict_lru(held, size, take=take).collect()}
            assert got == {k for k, _ in oldest[:size]}, (size, take)
    same = held.withColumn("last_accessed", F.lit("2024-01-01").cast("timestamp"))
    assert {x["key"] for x in cache.cache_evict_lru(same, 20, take=0).collect()} == {f"k{i:03}" for i in range(20)}


def test_document_of_one_source_over_many_ranges(spark):
    rows = [("big" if i % 10 else None, i // 2, f"text {i} " + "x" * (i % 7)) for i in range(400)] + [("big", 5, None)]
    chunks = spark.createDataFrame(rows, "source string, chunk_index int, text string").repartition(5)
    got = sorted((r["part"], r["detail"]) for r in store.document_detail(spark.createDataFrame([("big",)], "source string"), chunks, part_chars=100).collect())
    want = [t for s, _, t in sorted((x for x in rows if x[0] and x[2]), key=lambda x: (x[1], x[2]))]
    assert "\n".join(d for _, d in got) == "文件：big\n" + "\n".join(want) and [p for p, _ in got] == list(range(len(got)))


def test_document_in_parts(spark):
    chunks = spark.createDataFrame([("s", i, f"text {i}") for i in range(20)] + [("t", 0, "one")], "source string, chunk_index int, text string")
    asked = spark.createDataFrame([("s",), ("t",), ("u",)], "source string")
    got = {}
    for r in sorted(store.document_detail(asked, chunks, part_chars=30).collect(), key=lambda r: (r["source"], r["part"])):
        got.setdefault(r["source"], []).append(r["detail"])
    assert "\n".join(got["s"]) == "文件：s\n" + "\n".join(f"text {i}" for i in range(20)) and len(got["s"]) > 3
    assert got["t"] == ["文件：t\none"] and got["u"] == ["未找到文档"]


def test_three_sources_of_metadata(spark):
    side = lambda rows, cols: spark.createDataFrame(rows, cols)
    got = metadata.merge_metadata(side([("a", ""), ("b", "B")], "source string, title string"), side([("a", "m", "c1")], "source string, title string, category string"), side([("a", "r", "c2"), ("b", "r", "c3")], "source string, title string, category string"), ["title", "category", "region"]).collect()
    assert {r["source"]: (r["title"], r["category"], r["region"]) for r in got} == {"a": ("m", "c1", None), "b": ("B", "c3", None)}


def test_formatted_hits_are_clamped(spark):
    q = spark.createDataFrame([(1,)], "query_id bigint")
    hits = spark.createDataFrame([(1, i, "s", float(i), f"t{i}") for i in range(1, 15)], "query_id bigint, rank int, source string, score double, text string")
    count = lambda top: hybrid.format_hits(q, hits, top).first()["answer"].count("[片段")
    assert [count(n) for n in (-3, 1, 4, 99)] == [1, 1, 4, 10]
    shown = hybrid.format_hits(q, hits.withColumn("rrf_score", F.lit(0.25)), 1).first()["answer"]
    assert "0.2500" in shown


def test_dates(spark):
    said = spark.createDataFrame([("自2024年3月5日起执行，自 2024 年 12 月 15 日起施行，有效期至2026年1月31日",), ("自2024年3月5日起执行",), ("无",), (None,)], "t string")
    said = spark.createDataFrame([(r["t"].replace("自 ", "自") if r["t"] else None,) for r in said.collect()], "t string")
    got = [tuple(r) for r in said.select(metadata.effective_date("t"), metadata.expiry_date("t")).collect()]
    assert got == [("2024-12-15", "2026-01-31"), ("2024-03-05", None), (None, None), (None, None)]


def test_index_without_tokens(spark, tmp_path):
    chunks = spark.createDataFrame([("a", None), ("b", "1 2 !")], "id string, text string")
    q = spark.createDataFrame([(1, "word")], "query_id bigint, query string")
    for c in (chunks, chunks.limit(0)):
        assert lexical.bm25_search(lexical.build_index(c, path=f"{tmp_path}/{c.count()}"), q).count() == 0
