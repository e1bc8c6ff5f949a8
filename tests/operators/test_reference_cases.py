"""Small cases with the results worked out by hand."""

from pyspark.sql import functions as F

from tarnwork.functions import metadata as M
from tarnwork.functions import text as T
from tarnwork.operators import chunking, conversation, evaluation, hybrid, lexical, store


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def test_cleaning(spark):
    assert one(spark, "\n　a  \n\n\n\n\nb\t\n", T.clean_markdown) == "a\n\nb"
    assert one(spark, " a \n\n b", T.txt_normalize) == "a\nb"
    assert one(spark, "登录 | 注册\n\n# x\n首页Home\ny", lambda c: T.noise_lines(c, "登录|首页")) == "# x\ny"
    assert one(spark, "发布来源：财政部\nx", T.publish_source) == "财政部"
    assert one(spark, "nothing", T.publish_source) is None
    assert one(spark, "**一、总则**\n**小题**\n**长句。**", T.md_standardize) == "\n#### 一、总则\n\n### 小题\n**长句。**"
    assert one(spark, "第一章 总则\n3\n第三条 x\n一、y\n（一）z\n1.w\nv", T.outline_to_markdown) == "\n## 第一章 总则\n\n### 第三条 x\n\n#### 一、y\n\n- （一）z\n- 1.w\nv"


def test_tables_of_cells(spark):
    rows = spark.createDataFrame([(1, [["a", "b"], ["c", None], ["d"]]), (2, [["x"], ["y"]]), (3, [])], "i int, rows array<array<string>>")
    got = {r["i"]: r["m"] for r in rows.select("i", T.cells_to_table("rows").alias("m")).collect()}
    assert got == {1: "| a | b |\n| --- | --- |\n| c |  |\n| d |  |", 2: "> x\n>\n> y", 3: ""}


def test_dates_and_numbers(spark):
    t = "财金〔2026〕15号\n2024 年 3 月 5 日\n自2026年4月1日起施行，有效期至2027年12月31日。\n2026年3月15日"
    assert one(spark, t, M.policy_number) == "财金〔2026〕15号"
    assert one(spark, t, M.publish_date) == "2026-03-15"
    assert one(spark, t, M.effective_date) == "2026-04-01"
    assert one(spark, t, M.expiry_date) == "2027-12-31"
    assert one(spark, "广东省 x", M.applicable_region) == "广东省"
    assert one(spark, "", M.publish_date) is None


def test_chunking():
    assert chunking.pack_paragraphs("aa\n\nbb\ncc", 5, 1) == ["aa\nbb", "b\ncc"]
    assert chunking.pack_paragraphs("", 5, 1) == [] and chunking.pack_paragraphs(None) == []
    assert chunking.pack_lines("aa\nbb\ncc", 6, 3) == ["aa\nbb", "bb\ncc"]
    assert chunking.pack_lines("short", 800) == ["short"]


def test_bm25(spark):
    chunks = spark.createDataFrame([("1", "loan help loan"), ("2", "other words"), ("3", "more other words"), ("4", "new firm"), ("5", "plain text")], "id string, text string")
    q = spark.createDataFrame([(1, "loan"), (2, ""), (3, "unknown")], "query_id int, query string")
    got = lexical.bm25_search(lexical.build_index(chunks), q).collect()
    assert [(r["query_id"], r["id"], r["rank"]) for r in got] == [(1, "1", 1)]
    keys = spark.createDataFrame([("2", {"loan": 9}), ("9", {"x": 1})], "id string, keywords map<string,int>")
    got = lexical.bm25_search(lexical.build_index(chunks, keywords=keys), q).orderBy("rank").collect()
    assert got[0]["id"] == "2" and len(got) == 2


def test_fusion(spark):
    legs = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "c", 2), (1, 1, "b", 1), (1, 1, "a", 2)], "query_id int, leg int, id string, rank int")
    got = hybrid.rrf_merge(legs).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "b", "c"] and got[0]["rrf_score"] > 1 / 61
    hits = spark.createDataFrame([(1, "c1", "p1", 0.5, 1), (1, "c2", "p1", 0.3, 2), (2, "c3", None, 0.2, 1)], "query_id int, id string, parent_id string, rrf_score double, rank int")
    parents = spark.createDataFrame([("p1", "t")], "id string, text string")
    assert sorted((r["query_id"], r["id"], r["rrf_score"]) for r in hybrid.resolve_parents(hits, parents).collect()) == [(1, "p1", 0.5), (2, "c3", 0.2)]


def test_conversations(spark):
    rows = [("c", i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(7)] + [("d", 0, "system", "s"), ("d", 1, "user", "x" * 300)]
    m = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = conversation.history_window(m, 2).filter("conv_id = 'c'").orderBy("turn").collect()
    assert [r["turn"] for r in got] == [4, 5, 6]
    context = {r["conv_id"]: r["context"] for r in conversation.recent_context(m, 1).collect()}
    assert context == {"c": "助手: m5\n用户: m6", "d": "用户: " + "x" * 200 + "..."}


def test_evaluation(spark):
    assert one(spark, "“a”.html", evaluation.normalize_source) == '"a"'
    bad = spark.createDataFrame([("{oops",), ('```json\n{"faithfulness": 5, "relevance": 4, "completeness": 3, "correctness": 4, "reason": "r"}\n```',)], "reply string").select(*evaluation.judge_reply("reply")).collect()
    assert tuple(bad[0]) == (0, 0, 0, 0, "JSON 解析失败: {oops") and tuple(bad[1]) == (5, 4, 3, 4, "r")


def test_store(spark):
    chunks = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one")], "source string, chunk_index int, text string")
    asked = spark.createDataFrame([("a",), ("b",)], "source string")
    assert {r["source"]: r["detail"] for r in store.document_detail(asked, chunks).collect()} == {"a": "文件：a\none\ntwo", "b": "未找到文档"}


def test_publish_source_reads_whole_texts(spark, tmp_path):
    from tarnwork.plans import catalogue

    rows = [(1, "x" * 60 + "\n发布来源: far\n" + "y" * 99, "own"), (2, "z" * 5000, "own")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["publish_source"] for r in catalogue.publish_source(spark, str(tmp_path)).collect()} == {1: "far", 2: "own"}
