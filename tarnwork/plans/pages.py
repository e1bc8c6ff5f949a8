"""Registered queries on pages, encoders, hybrid search, files and streams."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..folders import fresh_dir
from ..functions import html as H
from ..functions import metadata as M
from ..functions.text import clean_markdown
from ..operators import evaluation, hybrid, lexical, store, vectors
from ..sources import files
from ..streaming import jobs
from .catalogue import BM25, LEGS, SPOKEN, SWEEP, _legs, _sweep, corpus, query, spread, table

@query(r"SELECT page_id, 'made ' || page_id AS author, 'a,b' AS keywords, strftime(DATE '2024-01-01' + CAST(page_id % 365 AS INT), '%Y-%m-%d') AS publish_date FROM pages")
def html_meta(spark, sf_dir):
    key, day = F.col("page_id").cast("string"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 365).cast("int")), "yyyy-MM-dd")
    tags = F.concat(F.lit('<meta name="author" content="first"><meta name="Source" content=" made '), key, F.lit('"><meta name=\'keywords\' content=\'a,b\'><meta content="'), day, F.lit('" name="PublishDate"><meta name="description" content=""><meta name="robots" content="x">'))
    got = table(spark, sf_dir, "pages").select("page_id", H.html_meta(F.concat(F.lit("<head>"), tags, F.lit("</head>"), F.col("html"))).alias("m"))
    return got.select("page_id", *(F.col("m")[k].alias(k) for k in ("author", "keywords", "publish_date")))


@query()
def html_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", H.html_markdown("html", F.lit("stem"), "登录|首页").alias("markdown"))


MARKDOWN = """SELECT o_orderkey, '# Order ' || o_orderkey || chr(10) || chr(10) || '## State **' || o_orderstatus || '**' || chr(10) || chr(10) || 'Priority *' || o_orderpriority || '*' || chr(10) || chr(10)
|| CASE WHEN o_orderkey % 2 = 0 THEN array_to_string(['- one', '  - inner ' || o_orderkey, '  - last', '- two'], chr(10)) ELSE array_to_string(['1. one', '   - inner ' || o_orderkey, '   - last', '2. two'], chr(10)) END || chr(10) || chr(10)
|| array_to_string(['> said ' || o_custkey, '>', '> end'], chr(10)) || chr(10) || chr(10) || array_to_string(['```', '  a ' || o_custkey, '    b <', '```'], chr(10)) || chr(10) || chr(10)
|| array_to_string(CASE WHEN o_orderkey % 3 = 0 THEN [repeat('wide ', 41) || 'x', CAST(o_custkey AS VARCHAR)] ELSE ['| k | v |', '| --- | --- |', '| ' || o_custkey || ' | ' || o_orderstatus || ' & x |'] END, chr(10)) || chr(10) || chr(10) || 'tail' AS markdown FROM orders"""


@query(MARKDOWN)
def html_markdown_composed(spark, sf_dir):
    """Pages with nested and unclosed lists, quotes, preformatted blocks, data and layout tables."""
    o = spread(table(spark, sf_dir, "orders"))
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "ul").otherwise("ol")
    grid = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("<table><tr><td>"), F.repeat(F.lit("wide "), F.lit(41)), F.lit("x<td>"), cust, F.lit("</table>"))).otherwise(
        F.concat(F.lit("<table><tr><th>k</th><th>v</th></tr><tr><td>"), cust, F.lit("</td><td>"), "o_orderstatus", F.lit(" &amp; x</table>"))
    )
    page = F.concat(
        F.lit("<html><head><title>Order "), key, F.lit("</title><style>p{}</style></head><body><nav><ul><li>menu</ul></nav><p>登录 | 注册</p><h2>State <b>"), "o_orderstatus", F.lit("</b></h2><div><p>Priority <i>"), "o_orderpriority",
        F.lit("</i>\n<"), kind, F.lit("><li>one<ul><li>inner "), key, F.lit("<li>last</ul><li>two</"), kind, F.lit("></div><blockquote><p>said "), cust, F.lit("<p>end</blockquote><pre>  a "), cust, F.lit("\n    b &lt;</pre>"), grid, F.lit("<footer>foot</footer>tail"),
    )
    return o.select("o_orderkey", H.html_markdown(page, F.lit("stem")).alias("markdown"))


@query("SELECT o_orderkey, o_orderkey % 4 = 1 AS layout FROM orders")
def layout_table(spark, sf_dir):
    k = F.col("o_orderkey")
    cell = F.when(k % 4 < 2, F.repeat(F.lit("wide "), F.lit(60))).otherwise("short")
    tag = F.when(k % 4 == 0, "th").otherwise("td")
    made = F.concat(F.lit("<table><tr><"), tag, F.lit(">"), "o_orderpriority", F.lit("</"), tag, F.lit("></tr><tr><td>"), cell, F.lit("</td></tr></table>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", H.is_layout_table(made).alias("layout"))


@query("SELECT o_custkey, term, count(*) AS tf FROM (SELECT o_custkey, unnest(CASE WHEN o_orderkey % 2 = 0 THEN ['企业', '业的', '的钱', '增值税'] ELSE list_concat(['专精特新'], string_split(o_orderpriority[3:], ' ')) END) AS term FROM orders) WHERE length(term) >= 2 GROUP BY ALL")
def tokenize_han(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 2 == 0, "企业的钱增值税").otherwise(F.concat(F.lit("专精特新2 "), F.substr("o_orderpriority", F.lit(3)), F.lit(" 3.5%")))
    orders = table(spark, sf_dir, "orders")
    words = orders.select("o_custkey", F.explode(lexical.tokenize(text)).alias("term"))
    return words.groupBy("o_custkey", "term").agg(F.count(F.lit(1)).alias("tf"))


@query()
def embed_column(spark, sf_dir):
    return vectors.embed_column(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "embedding")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS letters, CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS blanks FROM documents")
def embed_column_plugged(spark, sf_dir):
    """An encoder that callers plug in: a vector of the text's length and its blanks."""
    encode = lambda texts: [[len(t), t.count(" ")] for t in texts]
    made = vectors.embed_column(table(spark, sf_dir, "documents").select("doc_id", "text"), encode=encode)
    return made.select("doc_id", F.col("embedding")[0].cast("bigint").alias("letters"), F.col("embedding")[1].cast("bigint").alias("blanks"))


HYBRID = f"""{BM25.replace("FROM documents", "FROM chunk").replace("WITH tok", "WITH chunk AS (SELECT doc_id, text, source, embedding FROM documents JOIN embeddings ON vec_id = doc_id), tok").replace("FROM benchmark", "FROM asked").replace("tok AS (SELECT doc_id,", "asked AS (SELECT item_id, b.text, embedding FROM benchmark b JOIN embeddings ON vec_id = item_id), tok AS (SELECT doc_id,")},
near AS (SELECT item_id AS query_id, doc_id AS id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS s FROM asked a, chunk c),
legs AS (SELECT query_id, 0 AS leg, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM near QUALIFY rank <= 20 UNION ALL SELECT query_id, 1, id, rank FROM top),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS raw, min(leg * 100 + rank) AS seen FROM legs GROUP BY ALL)
SELECT query_id, id, round(raw, 6) AS rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, seen, id) AS INT) AS rank FROM f QUALIFY rank <= 7"""


@query(HYBRID)
def hybrid_search(spark, sf_dir):
    """Documents that have a vector of their id, asked for by the benchmark texts that have one."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    chunks = corpus(spark, sf_dir).select("id", "text", "source").join(e, "id")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).join(e.withColumnRenamed("id", "query_id"), "query_id")
    return hybrid.hybrid_search(chunks, asked, lexical.build_index(chunks, path=fresh_dir(spark, "index")))


@query("SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk_index FROM documents WHERE source IN ('src1', 'src2')")
def get_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    numbered = docs.withColumn("chunk_index", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("bigint") - 1)
    return store.get_by_source(numbered, ["src1", "src2"])


@query("SELECT source AS stem, max(doc_id) AS doc_id, arg_max(text, doc_id) AS text FROM documents WHERE source IS NOT NULL GROUP BY source")
def write_parsed(spark, sf_dir):
    """The table written and read back: the last document of each stem."""
    path = fresh_dir(spark, "parsed")
    docs = table(spark, sf_dir, "documents").filter("source is not null")
    files.write_parsed(docs.select("doc_id", F.col("source").alias("stem"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("path"), "text"), path)
    return spark.read.parquet(path).select("stem", "doc_id", "text")


@query(BM25 + " SELECT * FROM top")
def save_and_load_index(spark, sf_dir):
    """Search over an index written and read back."""
    path = fresh_dir(spark, "index")
    files.save_index(lexical.build_index(corpus(spark, sf_dir)), path)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lexical.bm25_search(files.load_index(spark, path), asked)


@query("SELECT source, 'markdown' AS file_type, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents WHERE source IS NOT NULL GROUP BY source")
def scan_corpus(spark, sf_dir):
    """The documents written as text files, a folder a source, and scanned."""
    path = fresh_dir(spark, "files")
    table(spark, sf_dir, "documents").filter("source is not null").select("source", "text").write.partitionBy("source").text(path)
    found = files.scan_corpus(spark, path).withColumn("source", F.regexp_extract("path", "source=([^/]+)/", 1))
    return found.groupBy("source", "file_type").agg(F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@query("SELECT doc_id AS id, source, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n FROM documents")
def write_chunks(spark, sf_dir):
    """A chunk table written over an older one and added to, then read back."""
    path, chunks = fresh_dir(spark, "chunks"), corpus(spark, sf_dir).select("id", "source")
    files.write_chunks(chunks.limit(0), path)
    files.write_chunks(chunks, path, clean=True)
    files.write_chunks(chunks.filter("id % 2 = 0"), path)
    return spark.read.parquet(path).groupBy("id", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(item_id AS INT) AS id, text AS question, 'src' || item_id || ',x' AS expected, CASE WHEN item_id % 2 = 0 THEN 'even' END AS category FROM benchmark")
def read_eval_set(spark, sf_dir):
    """The benchmark written as an evaluation set, one item a line, and read back."""
    path, b = fresh_dir(spark, "eval-set"), table(spark, sf_dir, "benchmark")
    made = b.select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.array(F.concat(F.lit("src"), F.col("item_id").cast("string")), F.lit("x")).alias("expected_sources"), F.when(F.col("item_id") % 2 == 0, "even").alias("category"))
    made.write.json(path)
    return files.read_eval_set(spark, path, lines=True).select("id", "question", F.array_join("expected_sources", ",").alias("expected"), "category")


@query("SELECT CAST(item_id AS INT) AS id, text AS question, 'src' || item_id AS expected FROM benchmark")
def read_eval_set_array(spark, sf_dir):
    """The same as one JSON array, the form in which such a set (a stated, small one) is kept."""
    path, b = fresh_dir(spark, "eval-array"), table(spark, sf_dir, "benchmark")
    item = F.struct(F.col("item_id").alias("id"), F.col("text").alias("question"), F.array(F.concat(F.lit("src"), F.col("item_id").cast("string"))).alias("expected_sources"))
    b.agg(F.to_json(F.collect_list(item)).alias("value")).coalesce(1).write.text(path)
    return files.read_eval_set(spark, path).select("id", "question", F.array_join("expected_sources", ",").alias("expected"))


@query(f"WITH {SWEEP}, best AS (SELECT value FROM sweep ORDER BY recall_at_k DESC, value LIMIT 1) SELECT CAST(s.value AS BIGINT) AS value, round(recall_at_k, 4) AS recall_at_k, round(mrr, 4) AS mrr, CAST(failures AS BIGINT) AS failures, s.value = best.value AS best FROM sweep s, best")
def write_report(spark, sf_dir):
    """The report of a sweep with its best row, written as JSON and read back."""
    path, sweep = fresh_dir(spark, "report"), _sweep(spark, sf_dir)
    files.write_report(sweep, path, best=evaluation.best_param(sweep))
    shape = "value double, recall_at_k double, mrr double, failures bigint"
    best = spark.read.schema(shape).json(f"{path}-best").select("value", F.lit(True).alias("best"))
    return spark.read.schema(shape).json(path).join(best, "value", "left").select(F.col("value").cast("bigint").alias("value"), "recall_at_k", "mrr", "failures", F.coalesce("best", F.lit(False)).alias("best"))


def streamed(spark, rows, label):
    """``rows`` written as a table and read as a stream."""
    path = fresh_dir(spark, label)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_ingest(spark, sf_dir):
    """Two runs of one stream into one table; the second finds every id there."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws("::", F.col("user_id").cast("string"), "event_type").alias("id"), "user_id", "event_type")
    path = fresh_dir(spark, "chunk-table")
    for run in ("first", "second"):
        jobs.stream_ingest(streamed(spark, rows, f"events-{run}"), path, fresh_dir(spark, "checkpoint")).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


CLEANED = r"regexp_replace(regexp_replace(regexp_replace(replace(text, '　', ' '), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, CAST(1 AS BIGINT) AS parents, CAST(1 AS BIGINT) AS ids FROM (SELECT doc_id, {CLEANED} AS t FROM documents) WHERE t <> '' AND length(t) <= 1500")
def stream_ingest_documents(spark, sf_dir):
    """Documents cleaned and cut into parents and children inside the stream, twice over; of those
    that are one parent, how many parents the table holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = fresh_dir(spark, "chunk-table")
    plan = lambda batch: jobs.clean_and_chunk(batch, "doc_id")
    stream = streamed(spark, docs, "documents")
    for _ in range(2):
        jobs.stream_ingest(stream, path, fresh_dir(spark, "checkpoint"), prepare=plan).start().awaitTermination()
    stored = spark.read.parquet(path)
    short = docs.withColumn("t", clean_markdown("text")).filter("t <> '' and length(t) <= 1500").select("doc_id")
    parents = stored.filter("role = 'parent'").join(short, "doc_id", "left_semi")
    return parents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parents"), F.count_distinct("id").alias("ids"))


@query(f"WITH {SPOKEN} SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn) AS kept FROM m WHERE back <= 4 AND NOT (total > 4 AND back = 4 AND role = 'assistant') GROUP BY conv_id")
def stream_history(spark, sf_dir):
    """The windows after the last message, from a stream of all messages."""
    path = fresh_dir(spark, "histories")
    stream = streamed(spark, table(spark, sf_dir, "conversations"), "messages")
    made = jobs.stream_history(stream, 2)
    spark.createDataFrame([], made.schema).withColumn("batch", F.lit(0).cast("bigint")).write.parquet(path)
    add = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)
    made.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", fresh_dir(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(path).groupBy("conv_id").agg(F.max_by(F.struct("turns", "roles"), "batch").alias("w"))
    said = F.zip_with("w.turns", "w.roles", lambda t, r: F.concat_ws(":", t.cast("string"), r))
    return last.select("conv_id", F.array_join(said, ",").alias("kept"))


@query("SELECT doc_id, '缺失字段: title, ' || lang || chr(10) || chr(10) || left(text, 1000) || CASE WHEN length(text) > 1000 THEN chr(10) || '...' || chr(10) || right(text, 500) ELSE '' END AS prompt FROM documents WHERE doc_id % 2 = 0")
def reply_prompt_rows(spark, sf_dir):
    """Fields are missing in every other document; only those get a prompt."""
    gone = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("title"), F.col("lang"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", M.reply_prompt("text", gone).alias("prompt")).filter("prompt is not null")


@query(
    f"""WITH {LEGS}, lab AS (SELECT vec_id AS id, label AS source FROM embeddings), e2 AS (SELECT vec_id AS query_id, label AS source FROM embeddings WHERE vec_id % 20 = 0),
rows AS (SELECT 'vector' AS mode, query_id, id, rank FROM v UNION ALL SELECT 'hybrid', query_id, id, rank FROM fused),
src AS (SELECT mode, query_id, source, row_number() OVER (PARTITION BY mode, query_id ORDER BY min(rank), source) AS rank FROM rows JOIN lab USING (id) GROUP BY mode, query_id, source),
h AS (SELECT mode, query_id, min(rank) AS first FROM src JOIN e2 USING (query_id, source) GROUP BY ALL)
SELECT m.mode, count(*) AS total, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM (SELECT DISTINCT mode FROM rows) m CROSS JOIN e2 LEFT JOIN h ON h.mode = m.mode AND h.query_id = e2.query_id GROUP BY 1"""
)
def compare_modes(spark, sf_dir):
    """The vector leg alone against the fused legs; the label of a vector is its source."""
    e = table(spark, sf_dir, "embeddings")
    named = e.select(F.col("vec_id").alias("id"), F.col("label").alias("source"))
    wanted = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("source"))
    legs = _legs(spark, sf_dir)
    modes = legs.filter("leg = 0").select(F.lit("vector").alias("mode"), "query_id", "id", "rank")
    modes = modes.unionByName(hybrid.rrf_merge(legs).select(F.lit("hybrid").alias("mode"), "query_id", "id", "rank"))
    return evaluation.compare_modes(wanted, modes.join(named, "id"), 3)


@query(
    f"""WITH {LEGS}, lab AS (SELECT vec_id AS id, label AS source FROM embeddings), e2 AS (SELECT vec_id AS query_id, label AS source FROM embeddings WHERE vec_id % 20 = 0),
h AS (SELECT query_id, min(rank) AS first FROM l JOIN lab USING (id) JOIN e2 USING (query_id, source) GROUP BY 1)
SELECT 'v1' AS mode, count(*) AS total, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM e2 LEFT JOIN h USING (query_id)"""
)
def compare_modes_repeats(spark, sf_dir):
    """A mode in which repeats of a source keep their ranks."""
    e = table(spark, sf_dir, "embeddings")
    named = e.select(F.col("vec_id").alias("id"), F.col("label").alias("source"))
    wanted = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("source"))
    hits = _legs(spark, sf_dir).filter("leg = 1").join(named, "id").select(F.lit("v1").alias("mode"), "query_id", "source", "rank")
    return evaluation.compare_modes(wanted, hits, 3, repeats=("v1",))


@query(
    """WITH RECURSIVE o AS (SELECT user_id || ':' || event_type AS key, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS i FROM events),
r AS (SELECT key, i, ts, ts AS stored, false AS hit FROM o WHERE i = 1 UNION ALL SELECT o.key, o.i, o.ts, CASE WHEN epoch_us(o.ts) - epoch_us(stored) <= 86400000000 THEN stored ELSE o.ts END, epoch_us(o.ts) - epoch_us(stored) <= 86400000000 FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1)
SELECT key, count(*) AS asked, count(*) FILTER (hit) AS hits FROM r GROUP BY key"""
)
def stream_cache(spark, sf_dir):
    """Hits a key of a stream of all events, within a day of the miss that stored the answer."""
    path = fresh_dir(spark, "answers")
    rows = table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    made = jobs.stream_cache(streamed(spark, rows, "asked"))
    made.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", fresh_dir(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(path).groupBy("key").agg(F.count(F.lit(1)).alias("asked"), F.count_if("hit").alias("hits"))
