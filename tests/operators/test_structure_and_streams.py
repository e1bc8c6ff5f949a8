"""Tables, structured chunks, files and streams on small cases worked out by hand."""

import json
import random
import weakref
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tarnwork.functions import tables as T
from tarnwork.operators import conversation, lexical, structure, tables
from tarnwork.sources import files
from tarnwork.streaming import jobs

TABLE = "| a | b |\n| --- | --- |\n| 1 | 2 |\n|  | 3 |"


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_tables(spark):
    text = f"# T\n\n## 第三条 补贴标准\n\n{TABLE}\n\nmid\n| x |\n| y |\n\n{TABLE}"
    assert one(spark, text, T.extract_tables) == [TABLE, TABLE]
    assert one(spark, None, T.extract_tables) is None and one(spark, "", T.extract_tables) == []
    assert one(spark, TABLE, T.table_to_sentences) == "a为1，b为2。\na为3。"
    assert one(spark, "> x\n>\n> y", T.table_to_sentences) == "x\n\ny"
    assert one(spark, "| a |\n| - |", T.table_to_sentences) == "| a |\n| - |"
    assert one(spark, text, lambda c: T.table_section(F.lit(TABLE), c)) == "第三条 补贴标准"
    assert one(spark, "none", lambda c: T.table_section(F.lit(TABLE), c)) == ""
    got = one(spark, '```json\n{"questions": ["q"], "keywords": {"k": 5}}\n```', T.table_qk_reply)
    assert got["questions"] == ["q"] and got["keywords"] == {"k": 5}
    bad = one(spark, "oops", T.table_qk_reply)
    assert bad["questions"] == [] and bad["keywords"] == {}


def test_keyword_anchor(spark):
    docs = spark.createDataFrame([("s", TABLE)], "source string, markdown string")
    replies = spark.createDataFrame([("s", 0, '{"keywords": {"k": 5}}')], "source string, table_no int, reply string")
    chunks = spark.createDataFrame([("s", "c0", 0, "no"), ("s", "c1", 1, TABLE), ("s", "c2", 2, TABLE)], "source string, id string, chunk_index int, text string")
    rows = tables.table_keyword_anchor(tables.process_tables(docs, replies), chunks).collect()
    assert [(r["id"], r["keywords"]) for r in rows] == [("c1", {"k": 5})]


def test_split_structure(spark):
    law = "---\ntitle: x\n---\n# T\nlost\n## A\n### 1\na\n### 2\nb\n#### deep\nc\n## B\nbody\n### 3\nd"
    docs = spark.createDataFrame([("law", law), ("flat", "# T\nall of it"), ("none", "text"), ("empty", ""), ("null", None)], "source string, markdown string")
    got = {}
    for r in structure.split_structure(docs).orderBy("source", "p_idx").collect():
        got.setdefault(r["source"], []).append((r["heading"], r["text"], r["level"]))
    assert got["law"] == [("A > 1", "### 1\na", 3), ("A > 2", "### 2\nb\n#### deep\nc", 3), ("B", "## B\nbody", 3), ("B > 3", "### 3\nd", 3)]
    assert got["flat"] == [("T", "# T\nall of it", 0)] and got["none"] == [("", "text", 0)]
    assert got["empty"] == [("", "", 0)] and got["null"] == [("", "", 0)]


def test_parent_child(spark):
    items = "\n".join(f"（{n}）" + "字" * 200 for n in "一二三")
    assert [len(s) for s in structure.sub_sections(items)] == [203, 203, 203]
    long = "\n".join("x" * 99 for _ in range(20))
    docs = spark.createDataFrame([("s", long, "c")], "source string, markdown string, category string")
    rows = structure.parent_child(docs).collect()
    parents = {r["id"] for r in rows if r["role"] == "parent"}
    children = [r for r in rows if r["role"] == "child"]
    assert len(parents) == 3 and {r["parent_id"] for r in children} == parents
    assert len({r["id"] for r in rows}) == len(rows) and all(r["category"] == "c" for r in rows)
    assert all(len(r["text"]) <= 300 for r in children)


def test_files(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, text in {"a.md": "# A", "sub/a.txt": "later", "b.HTML": "no", "c.htm": " ", "d.pdf": "no"}.items():
        (tmp_path / "in" / name).write_text(text)
    found = files.scan_corpus(spark, str(tmp_path / "in"))
    assert {(r["source"], r["file_type"]) for r in found.collect()} == {("a.md", "markdown"), ("a.txt", "markdown"), ("c.htm", "html")}
    full, blank = files.split_blank(found)
    assert full.count() == 2 and [r["stem"] for r in blank.collect()] == ["c"]
    files.write_parsed(full, str(tmp_path / "parsed"))
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "parsed")).collect()] == ["later"]

    chunks = spark.createDataFrame([("1", "alpha beta"), ("2", "beta gamma"), ("3", "delta")], "id string, text string")
    files.save_index(lexical.build_index(chunks), str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, "gamma")], "query_id int, query string")
    assert [r["id"] for r in lexical.bm25_search(files.load_index(spark, str(tmp_path / "index")), asked).collect()] == ["2"]

    (tmp_path / "eval.json").write_text(json.dumps([{"id": 1, "question": "q", "expected_sources": ["s"]}]))
    assert files.read_eval_set(spark, str(tmp_path / "eval.json")).first()["expected_sources"] == ["s"]
    files.write_report(spark.createDataFrame([("x", 0.123456)], "name string, v double"), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).first()["v"] == 0.1235


def test_stream_ingest_adds_each_id_once(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("1", "a")], "id string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    for run in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        jobs.stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / f"cp{run}")).start().awaitTermination()
        assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]


def test_filters_forget_nothing_and_bound_what_is_read(spark, tmp_path):
    hashes = np.random.default_rng(1).integers(0, 2**63, (5000, 2)).astype(np.uint64)
    made = jobs.make_filter(hashes[:2500])
    assert jobs.may_hold(made, hashes[:2500]).all() and jobs.may_hold(made, hashes[2500:]).mean() < 0.03
    assert len(made) < 2500 * 1.3 and not jobs.may_hold(jobs.make_filter(hashes[:0]), hashes).any()

    path, rows = str(tmp_path / "table"), lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("x"))
    spark.createDataFrame([], "_bucket int, made binary").write.parquet(f"{path}-filters")
    assert jobs.add_new(rows(0, 1000), path, buckets=16) == []
    assert len(jobs.add_new(rows(1000, 1020), path, buckets=16)) <= 6  # all new: only errors of the filters
    read = jobs.add_new(rows(990, 1000).unionByName(rows(2000, 2005)), path, buckets=16)
    of = {r["id"]: r["_bucket"] for r in jobs._hashed(rows(0, 2005), "id", 16).collect()}
    assert {of[str(i)] for i in range(990, 1000)} <= set(read) and len(read) < 16
    assert jobs.add_new(rows(0, 1020), path, buckets=16) == sorted(set(of[str(i)] for i in range(1020)))
    stored = sorted(int(r["id"]) for r in spark.read.parquet(path).collect())
    assert stored == [*range(1020), *range(2000, 2005)]
    # A batch that failed after its filters were written and before its rows.
    jobs.filters_of(rows(3000, 3010), "id", 16).write.mode("append").parquet(f"{path}-filters")
    jobs.add_new(rows(3000, 3010), path, buckets=16)
    assert spark.read.parquet(path).count() == len(stored) + 10


def test_documents_are_chunked_inside_the_stream(spark, tmp_path):
    docs = spark.createDataFrame([("a", "# T\n\n## A\nx　\n\n\n\ny\n## B\nz"), ("b", "  \n"), ("c", None), ("d", "plain")], "source string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    for run in range(2):
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        jobs.stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / f"cp{run}"), prepare=jobs.clean_and_chunk).start().awaitTermination()
        got = sorted((r["source"], r["role"], r["text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [(s, r, t) for s, r, t in sorted((s, r, t) for r in ("child", "parent") for s, t in (("a", "## A\nx\n\ny"), ("a", "## B\nz"), ("d", "plain")))]


def test_ingest_stages_texts_once_and_keeps_the_first_of_repeats(spark, tmp_path, monkeypatch):
    staged, stage = [], jobs.stage
    monkeypatch.setattr(jobs, "stage", lambda df, label, **options: staged.append(df.columns) or stage(df, label, **options))
    path, kind = str(tmp_path / "table"), "id string, n int, text string"
    spark.createDataFrame([], "_bucket int, made binary").write.parquet(f"{path}-filters")
    one = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "z"), (None, 1, "n")], kind)
    two = spark.createDataFrame([("a", 0, "late"), ("c", 2, "v"), ("c", 1, "w")], kind)
    for batch in (one, two, one.filter("id is not null"), two):
        staged.clear()
        jobs.add_new(batch, path, order=["n"], buckets=4)
        assert sum("text" in columns for columns in staged) == 1
    got = spark.read.parquet(path).select("id", "n", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 1, "y"), ("b", 1, "z"), ("c", 1, "w"), (None, 1, "n")], key=str)


def test_stream_history_equals_the_batch_window(spark, tmp_path):
    said = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for c in (1, 2) for t in range(4 + 3 * c)] + [(1, 99, "system", "x")]
    rows = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.stream_history(stream, 2).writeStream.format("memory").queryName("histories").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["conv_id"], t) for r in spark.table("histories").collect() for t in r["turns"]}
    assert got == {(r["conv_id"], r["turn"]) for r in conversation.history_window(rows, 2).collect()}


def test_stream_cache_equals_the_ordered_walk(spark, tmp_path):
    at = lambda s: pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s)
    rows = spark.createDataFrame(pd.DataFrame([("a", at(0)), ("a", at(10)), ("a", at(11)), ("b", at(5)), ("a", at(20))], columns=["key", "ts"]))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.stream_cache(stream, 10).writeStream.format("memory").queryName("cached").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r["key"], r["ts"].second): r["hit"] for r in spark.table("cached").collect()}
    assert got == {("a", 0): False, ("a", 10): True, ("a", 11): False, ("b", 5): False, ("a", 20): True}


def one_at_a_time(frames):
    """Frames of which none may be held but the last."""
    given = []
    for make in frames:
        assert all(f() is None for f in given[:-1])
        frame = make()
        given.append(weakref.ref(frame))
        yield frame
        del frame


def test_stream_steps_hold_no_frames_and_equal_the_plain_walk():
    r = random.Random(3)
    for most in (2, 4, 6):
        for _ in range(60):
            kept, plain, base = [], [], 0
            for _ in range(3):
                rows = [(base + r.randrange(12), r.choice(["user", "assistant", "assistant"]), f"m{r.random()}") for _ in range(r.randrange(1, 15))]
                base += 12
                parts = [rows[a : a + 4] for a in range(0, len(rows), 4)]
                kept = jobs.last_window(kept, one_at_a_time([lambda p=p: pd.DataFrame(p, columns=["turn", "role", "text"]) for p in parts]), most)
                for m in sorted(rows, key=lambda m: m[0]):
                    full = len(plain) >= most
                    plain = [*plain, list(m)][-most:]
                    if full and plain[0][1] == "assistant":
                        plain = plain[1:]
                assert kept == plain
    for _ in range(100):
        stored = r.choice([None, 1_000_000 * r.randrange(50)])
        seconds = [r.randrange(200) for _ in range(r.randrange(1, 40))]
        parts = [seconds[a : a + 7] for a in range(0, len(seconds), 7)]
        found = jobs.walk_times(stored, one_at_a_time([lambda p=p: pd.DataFrame({"ts": pd.to_datetime(p, unit="s")}) for p in parts]), 10)
        hits, at = [], stored
        for t in sorted(seconds):
            hits.append(at is not None and t * 1_000_000 - at <= 10_000_000)
            at = at if hits[-1] else t * 1_000_000
        assert (found[0], found[1].view("int64").tolist(), found[2].tolist()) == (at, [t * 1_000_000 for t in sorted(seconds)], hits)


def test_stream_cache_holds_a_state_a_bucket_and_carries_its_keys_on(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    first, second = [("a", 0), ("b", 8), (None, 20), *((f"k{i}", 19) for i in range(50))], [("a", 16), ("b", 17), ("b", 19), (None, 29), ("k7", 29), ("k8", 30)]
    for n, rows in enumerate((first, second)):
        spark.createDataFrame([(k, at(s)) for k, s in rows], "key string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    made = jobs.stream_cache(stream, 10, "5 seconds", buckets=3)
    run = made.writeStream.format("memory").queryName("cached_buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r["key"], r["ts"].second): r["hit"] for r in spark.table("cached_buckets").collect()}
    want = {(k, s): False for k, s in first} | {("a", 16): False, ("b", 17): True, ("b", 19): False, (None, 29): True, ("k7", 29): True, ("k8", 30): False}
    assert got == want
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress) <= 3


def test_walk_of_many_keys_equals_the_walk_of_each():
    r = random.Random(5)
    for _ in range(100):
        held = {k: 1_000_000 * r.randrange(50) for k in r.sample("abc", r.randrange(4))}
        rows = [(r.choice(["a", "b", "c", "d", None]), r.randrange(200)) for _ in range(r.randrange(1, 60))]
        parts = [rows[a : a + 7] for a in range(0, len(rows), 7)]
        frame = lambda p: pd.DataFrame({"key": pd.Series([k for k, _ in p], dtype=object), "ts": pd.to_datetime([s for _, s in p], unit="s")})
        after = jobs.unpacked(jobs.packed(held))
        assert after == held
        names, codes, times, hits = jobs.walk_keys(after, one_at_a_time([lambda p=p: frame(p) for p in parts]), 10)
        for n, name in enumerate(names):
            stored, at, hit = jobs.walk_times(held.get(name), [frame([(k, s) for k, s in rows if k == name])], 10)
            assert after[name] == stored and times[codes == n].tolist() == at.tolist() and hits[codes == n].tolist() == hit.tolist()
        assert {k for k, _ in rows} == set(names) and {**held, **after} == after
