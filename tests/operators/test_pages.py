"""Pages, Han words, encoders and hybrid search on small cases worked out by hand."""

import numpy as np
from pyspark.sql import functions as F

from tarnwork.functions import html, metadata
from tarnwork.operators import evaluation, hybrid, lexical, vectors


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def md(spark, page):
    return one(spark, page, lambda c: html.html_markdown(c, F.lit("stem"), "登录|首页"))


def test_markdown(spark):
    page = """<html><head><title>A &amp; B</title></head><body><nav>menu</nav><h2>Head</h2><p>One <b>two</b>
    <a href="x">three</a>.</p><ul><li>i</li><li>j &amp;lt;</li></ul><p>登录 | x</p><script>if (a < b) {}</script><!-- no -->
    <table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>a<br>b</td></tr></table><p>end</p><footer>f</footer></body></html>"""
    want = "# A & B\n\n## Head\n\nOne **two** three.\n\n- i\n- j &lt;\n\n| k | v |\n| --- | --- |\n| 1 | a b |\n\nend"
    assert md(spark, page) == want
    assert md(spark, "<title>T</title><h1>T</h1><p>x") == "# T\n\nx"
    assert md(spark, "") == "# stem\n\n" and md(spark, None) is None
    wide = "w" * 201
    assert md(spark, f"<table><tr><td>{wide}</td><td>b</td></tr></table>") == f"# stem\n\n{wide}\nb"


def test_layout_tables(spark):
    layout = lambda t: one(spark, t, html.is_layout_table)
    long = "<td>" + "x" * 201 + "</td>"
    assert layout("<table></table>") is True
    assert layout(f"<table><tr>{long}</tr></table>") is True
    assert layout(f"<table><tr>{long}<td></td><td></td></tr></table>") is False
    assert layout(f"<table><tr><th>h</th></tr><tr>{long}</tr></table>") is False
    assert layout("<table><tr><td>a</td></tr></table>") is False


def test_meta(spark):
    tags = "<meta name='keywords' content='a,b'><META content=\"2024-03-15\" name=\"PublishDate\"><meta name=author content=x><meta name='author' content='p'><meta name='source' content='q'><meta name='date' content=''>"
    assert one(spark, tags, html.html_meta) == {"keywords": "a,b", "publish_date": "2024-03-15", "author": "q"}
    assert one(spark, "", html.html_meta) == {} and one(spark, None, html.html_meta) is None


def test_han_words(spark):
    cut = lambda t: one(spark, t, lexical.tokenize)
    assert cut("政府性融资担保和贷款贴息") == ["政府性融资担保", "贷款贴息"]
    assert cut("支持企业的abc钱 12 专精特新") == ["支持", "持企", "企业", "业的", "abc", "专精特新"]
    assert cut("") == [] and cut(None) is None
    assert one(spark, "企业的", lambda c: lexical.tokenize(c, ["企业的"])) == ["企业的"]


def test_embed_column(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "b a", "", None, "c"] * 20)], "id int, text string")
    got = {r["id"]: np.array(r["embedding"]) for r in vectors.embed_column(rows, batch_size=3).collect()}
    assert len(got) == 100 and np.allclose(got[0], got[1]) and not got[2].any() and not got[3].any()
    assert np.isclose(np.linalg.norm(got[4]), 1) and np.allclose(got[4], vectors.hashed_words(["c"])[0])
    lengths = vectors.embed_column(rows, encode=lambda texts: np.array([[len(t or "")] for t in texts]))
    assert {r["id"]: r["embedding"] for r in lengths.collect()}[0] == [3.0]


def test_hybrid_search(spark):
    chunks = spark.createDataFrame([(1, "alpha beta", 10), (2, "gamma delta", 10), (3, "alpha omega", 30)], "id bigint, text string, parent_id bigint")
    chunks = vectors.embed_column(chunks)
    asked = vectors.embed_column(spark.createDataFrame([(7, "alpha beta")], "query_id bigint, query string"), "query")
    index = lexical.build_index(chunks)
    first = hybrid.hybrid_search(chunks, asked, index, top=2).orderBy("rank").collect()
    assert first[0]["id"] == 1 and len(first) == 2
    scored = hybrid.hybrid_search(chunks, asked, index, top=1, score=lambda p: p.withColumn("rerank_score", F.col("id"))).collect()
    assert [r["id"] for r in scored] == [3]
    parents = spark.createDataFrame([(10,), (30,)], "id bigint")
    assert {r["id"] for r in hybrid.hybrid_search(chunks, asked, index, parents=parents).collect()} == {10, 30}
    kept = hybrid.hybrid_search(chunks, asked, lexical.build_index(chunks.filter("id > 1")), keep=F.col("id") > 1).collect()
    assert 1 not in {r["id"] for r in kept}


def test_compare_modes_over_nested_unions(spark):
    """Legs that are each dealt by query, fused, and joined to another search."""
    pairs = spark.range(40).selectExpr("id % 8 query_id", "id div 8 id")
    ranked = lambda o: lexical.top_k(pairs, 5, "query_id", o).select("query_id", "id", "rank")
    legs = ranked(F.col("id")).withColumn("leg", F.lit(0)).unionByName(ranked(F.desc("id")).withColumn("leg", F.lit(1)))
    fused = hybrid.rrf_merge(legs)
    assert fused.count() == 40
    hits = legs.filter("leg = 0").select(F.lit("one").alias("mode"), "query_id", "id", "rank").unionByName(fused.select(F.lit("both").alias("mode"), "query_id", "id", "rank"))
    hits = hits.withColumn("source", F.col("id"))
    wanted = spark.range(8).selectExpr("id query_id", "cast(0 as bigint) source")
    got = {r["mode"]: (r["total"], r["recall"], r["mrr"]) for r in evaluation.compare_modes(wanted, hits, 1).collect()}
    assert got["one"] == (8, 1.0, 1.0) and got["both"][0] == 8


def test_reply_prompt(spark):
    rows = spark.createDataFrame([("a" * 1001, ["x", "y"]), ("b", []), (None, ["x"])], "t string, m array<string>")
    got = [r[0] for r in rows.select(metadata.reply_prompt("t", "m")).collect()]
    assert got[0] == "缺失字段: x, y\n\n" + "a" * 1000 + "\n...\n" + "a" * 500 and got[1:] == [None, None]
