"""Registered queries on tables inside documents and on structured chunks.

The documents are composed from ``orders``: a section a customer, with a pipe table of the
customer's orders, so that DuckDB can compose what is expected."""

from pyspark.sql import functions as F

from ..functions import tables as T
from ..operators import structure, tables
from .catalogue import CHUNKED, composed, query, table

LINE = "'| ' || o_orderkey || ' | ' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END || ' | ' || o_orderpriority || ' |'"
MD = f"md AS (SELECT o_custkey, '| order | status | priority |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg({LINE}, chr(10) ORDER BY o_orderkey) AS t FROM orders GROUP BY o_custkey)"
SAID = "string_agg(CASE WHEN o_orderkey % 3 = 0 THEN 'order为' || o_orderkey || '，status为' || o_orderpriority ELSE 'order为' || o_orderkey || '，status为' || o_orderstatus || '，priority为' || o_orderpriority END || '。', chr(10) ORDER BY o_orderkey)"


def order_reports(spark, sf_dir):
    """``source``, ``markdown``: a title, a heading, the table and a closing line."""
    key = F.col("o_orderkey").cast("string")
    line = F.concat(F.lit("| "), key, F.lit(" | "), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")), F.lit(" | "), "o_orderpriority", F.lit(" |"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("rows"))
    who = F.col("o_custkey").cast("string")
    text = F.concat(F.lit("# Report\n\n### Orders of "), who, F.lit("\n\n| order | status | priority |\n| --- | --- | --- |\n"), "rows", F.lit("\n\nEnd of the report."))
    return rows.select(F.col("o_custkey").alias("source"), text.alias("markdown"))


def replies(spark, sf_dir):
    who = F.col("o_custkey").cast("string")
    good = F.concat(F.lit('{"questions": ["q'), who, F.lit('"], "keywords": {"k'), who, F.lit('": 5}}'))
    reply = F.when(F.col("o_custkey") % 10 == 0, "{bad").when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).otherwise(good)
    return table(spark, sf_dir, "orders").select("o_custkey").distinct().select(F.col("o_custkey").alias("source"), F.lit(0).alias("table_no"), reply.alias("reply"))


@query(f"WITH {MD} SELECT o_custkey AS source, CAST(0 AS INT) AS table_no, t AS markdown FROM md")
def extract_tables(spark, sf_dir):
    return order_reports(spark, sf_dir).select("source", F.posexplode(T.extract_tables("markdown")).alias("table_no", "markdown"))


@query(f"SELECT o_custkey AS source, {SAID} AS said FROM orders GROUP BY o_custkey")
def table_to_sentences(spark, sf_dir):
    return extract_tables(spark, sf_dir).select("source", T.table_to_sentences("markdown").alias("said"))


@query("SELECT DISTINCT o_custkey AS source, CAST(0 AS INT) AS table_no, 'Orders of ' || o_custkey AS section FROM orders")
def table_section(spark, sf_dir):
    return tables.process_tables(order_reports(spark, sf_dir)).select("source", "table_no", "section")


@query("SELECT DISTINCT o_custkey AS source, CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 'q' || o_custkey END AS questions, CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 'k' || o_custkey || '=5' END AS keywords FROM orders")
def table_qk_reply(spark, sf_dir):
    got = replies(spark, sf_dir).select("source", T.table_qk_reply("reply").alias("r"))
    return got.select("source", F.array_join("r.questions", ",").alias("questions"), _pairs("r.keywords"))


def _pairs(c):
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("keywords")


@query(f"SELECT o_custkey AS source, CAST(0 AS INT) AS table_no, CAST(0 AS INT) AS page, {SAID} AS natural_language, 'Orders of ' || o_custkey AS section, CASE WHEN o_custkey % 10 = 0 THEN '' ELSE 'k' || o_custkey || '=5' END AS keywords FROM orders GROUP BY o_custkey")
def process_tables(spark, sf_dir):
    return tables.process_tables(order_reports(spark, sf_dir), replies(spark, sf_dir)).select("source", "table_no", "page", "natural_language", "section", _pairs("keywords"))


@query("SELECT DISTINCT o_custkey AS source, CAST(0 AS INT) AS table_no, md5(o_custkey || '::child::0::0::0') AS id FROM orders WHERE o_custkey % 10 <> 0")
def table_keyword_anchor(spark, sf_dir):
    docs = order_reports(spark, sf_dir)
    children = structure.parent_child(docs).filter("role = 'child'")
    found = tables.process_tables(docs, replies(spark, sf_dir))
    return tables.table_keyword_anchor(found, children, order=("p_idx", "pp_idx", "c_idx")).select("source", "table_no", "id")


# The composed documents have a line an order: a second-level heading, a third-level one or text.
SECTIONS = """o AS (SELECT o_custkey, o_orderkey AS k, o_orderkey % 4 AS m, CASE WHEN o_orderkey % 4 = 0 THEN '## ' WHEN o_orderkey % 4 = 1 THEN '### ' ELSE 'text ' END || o_orderkey AS line FROM orders),
lv AS (SELECT o_custkey, CASE WHEN n3 >= 3 THEN 3 WHEN n2 >= 2 THEN 2 WHEN n2 + n3 = 0 THEN 0 WHEN n2 > n3 THEN 2 WHEN n3 > n2 THEN 3 WHEN s2 < s3 THEN 2 ELSE 3 END AS sl FROM (SELECT o_custkey, count_if(m = 0) AS n2, count_if(m = 1) AS n3, coalesce(min(CASE WHEN m = 0 THEN k END), 1e18) AS s2, coalesce(min(CASE WHEN m = 1 THEN k END), 1e18) AS s3 FROM o GROUP BY o_custkey)),
s AS (SELECT o.*, sl, sum(CASE WHEN m = 0 OR (m = 1 AND sl = 3) THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY k) AS part, max(CASE WHEN m = 0 THEN k END) OVER (PARTITION BY o_custkey ORDER BY k) AS above FROM o JOIN lv USING (o_custkey)),
pt AS (SELECT o_custkey, sl, part, string_agg(line, chr(10) ORDER BY k) AS text, arg_min(m, k) AS m0, min(k) AS k0, arg_min(coalesce(above, -1), k) AS a0, count(*) AS n FROM s GROUP BY ALL),
sec AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY part) - 1 AS INT) AS p_idx, CASE WHEN sl = 0 OR m0 >= 2 THEN '' WHEN m0 = 0 THEN CAST(k0 AS VARCHAR) WHEN sl = 3 THEN CASE WHEN a0 >= 0 THEN a0 || ' > ' ELSE '' END || k0 ELSE '' END AS heading, text, CAST(sl AS INT) AS level FROM pt WHERE NOT (sl = 3 AND m0 = 0 AND n = 1))"""


@query(f"WITH {SECTIONS} SELECT * FROM sec")
def split_structure(spark, sf_dir):
    return structure.split_structure(composed(spark, sf_dir), "o_custkey", "md")


PACKED = CHUNKED.format(body="body", some="length(body) > 300", fit="300", restart="list_min(list_filter(o, lambda x: x >= o[f + 1] - 1 - 50))")
FAMILY = PACKED.replace("FROM documents", "FROM whole").replace("WITH RECURSIVE t AS", f"WITH RECURSIVE {SECTIONS}, whole AS (SELECT o_custkey * 1000 + p_idx AS doc_id, text AS body FROM sec), t AS").replace("SELECT doc_id, k AS chunk_index", "SELECT doc_id, CAST(k AS INT) AS chunk_index")


@query(
    FAMILY
    + """, kid AS (SELECT doc_id, chunk_index AS c_idx, text FROM chunk WHERE NOT final OR regexp_matches(text, '\\S') UNION ALL SELECT doc_id, 0, body FROM whole WHERE length(body) <= 300),
f AS (SELECT o_custkey, p_idx, heading AS section_path, CAST(0 AS INT) AS pp_idx, CAST(NULL AS INT) AS c_idx, text FROM sec UNION ALL SELECT sec.o_custkey, p_idx, heading, 0, CAST(c_idx AS INT), kid.text FROM sec JOIN kid ON doc_id = o_custkey * 1000 + p_idx)
SELECT md5(CASE WHEN c_idx IS NULL THEN o_custkey || '::parent::' || p_idx || '::0' ELSE o_custkey || '::child::' || p_idx || '::0::' || c_idx END) AS id, CASE WHEN c_idx IS NULL THEN 'parent' ELSE 'child' END AS role, CASE WHEN c_idx IS NOT NULL THEN md5(o_custkey || '::parent::' || p_idx || '::0') END AS parent_id, * REPLACE (coalesce(c_idx, -1) AS c_idx) FROM f"""
)
def parent_child(spark, sf_dir):
    return structure.parent_child(composed(spark, sf_dir), "o_custkey", "md").withColumn("c_idx", F.coalesce("c_idx", F.lit(-1)))


@query(
    """WITH i AS (SELECT o_custkey, o_orderkey, '（' || ['一', '二', '三'][o_orderkey % 3 + 1] || '）' || repeat('order ' || o_orderkey || ' ', 4) || 'end' AS item FROM orders),
w AS (SELECT o_custkey, string_agg(item, chr(10) ORDER BY o_orderkey) AS t FROM i GROUP BY o_custkey)
SELECT o_custkey, CAST(0 AS INT) AS c_idx, t AS text FROM w WHERE length(t) <= 300 UNION ALL SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT), item FROM i JOIN w USING (o_custkey) WHERE length(t) > 300"""
)
def sub_sections(spark, sf_dir):
    """Items of composed sections, whole where they are short."""
    k = F.col("o_orderkey")
    item = F.concat(F.lit("（"), F.get(F.array(F.lit("一"), F.lit("二"), F.lit("三")), (k % 3).cast("int")), F.lit("）"), F.repeat(F.concat(F.lit("order "), k.cast("string"), F.lit(" ")), F.lit(4)), F.lit("end"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("i")))), lambda x: x["i"]), "\n").alias("md"))
    made = structure.parent_child(rows, "o_custkey", "md", parent_size=1 << 30)
    return made.filter("role = 'child'").select("o_custkey", "c_idx", "text")
