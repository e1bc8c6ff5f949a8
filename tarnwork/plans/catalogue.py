"""The registered queries of the library and the SQL they are checked against.

A query takes (spark, sf_dir).  Chinese formats are exercised on notices composed from
``orders``; the driver's own texts are invented European prose."""

from pyspark.sql import functions as F

from ..folders import fresh_dir, stage
from ..functions import metadata as M
from ..functions import text as T
from ..functions.defaults import AUTHORITIES, CATEGORIES, REFERRING, TEXT_NOISE, any_of
from ..operators import cache, chunking, conversation, evaluation, hybrid, lexical, limited, sections, store, vectors
from ..sources import files

QUERIES, SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


# ---- documents and cleaning


@query("SELECT source, count(*) AS n FROM documents WHERE regexp_matches(text, '\\S') GROUP BY source")
def drop_empty_docs(spark, sf_dir):
    full, _ = files.split_blank(table(spark, sf_dir, "documents"))
    return full.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS total_files, count(*) FILTER (n_chars >= 100) AS processed, count(*) FILTER (n_chars < 100) AS failed FROM documents")
def ingest_report(spark, sf_dir):
    return files.ingest_report(_partly_blank(spark, sf_dir))


@query("SELECT doc_id, source FROM documents WHERE n_chars < 100")
def failed_docs(spark, sf_dir):
    return files.failed_docs(_partly_blank(spark, sf_dir)).select("doc_id", "source")


def _partly_blank(spark, sf_dir):
    """The documents, with blanks in place of the texts under 100 characters."""
    return table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("n_chars") < 100, " \n\t ").otherwise(F.col("text")))


CLEAN = r"regexp_replace(regexp_replace(regexp_replace(replace(%s, chr(12288), ' '), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
SPACED = r"replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(10) || chr(10) || chr(12288))"


@query(f"SELECT doc_id, {CLEAN % SPACED} AS cleaned FROM documents")
def clean_markdown(spark, sf_dir):
    spaced = F.replace(F.col("text"), F.lit(". "), F.lit(".  \n\n\n\n　"))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_markdown(spaced).alias("cleaned"))


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS body FROM documents""")
def txt_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.txt_normalize("text").alias("body"))


NOISE = "The|And|Of|Is"


@query(rf"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(trim(x), '^(?:{NOISE})')), chr(10)) AS kept FROM documents""")
def noise_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.noise_lines("text", NOISE).alias("kept"))


@query("SELECT doc_id, source AS publish_source FROM documents")
def publish_source(spark, sf_dir):
    said = F.concat("text", F.lit("\n发布来源: "), F.col("source"), F.lit(" \n"))
    return table(spark, sf_dir, "documents").select("doc_id", T.publish_source(said).alias("publish_source"))


@query("""SELECT o_orderkey, '# ' || o_orderpriority || chr(10) || chr(10) || '#### 一、' || o_custkey || chr(10) || chr(10) || '### ' || o_orderstatus || chr(10) || 'body' AS standard FROM orders""")
def md_standardize(spark, sf_dir):
    raw = F.concat(F.lit("# "), "o_orderpriority", F.lit("\n发布来源：x\n\n\n**一、"), F.col("o_custkey").cast("string"), F.lit("**\n**"), "o_orderstatus", F.lit("**\nbody"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.md_standardize(raw).alias("standard"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS title FROM orders")
def md_title(spark, sf_dir):
    raw = F.concat(F.lit("\nLogin | Join\n"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("# "), F.col("o_custkey").cast("string"))).otherwise(F.col("o_orderpriority")), F.lit("\nmore"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.md_title(raw, F.lit("stem"), "Login").alias("title"))


@query("""SELECT o_orderkey, chr(10) || '## 第一章 ' || o_custkey || chr(10) || chr(10) || '### 第三条 x' || chr(10) || chr(10) || '#### 一、y' || chr(10) || chr(10) || '- （一）z' || chr(10) || '- 1.' || o_orderstatus || chr(10) || o_orderpriority AS outline FROM orders""")
def outline_to_markdown(spark, sf_dir):
    raw = F.concat(F.lit("第一章 "), F.col("o_custkey").cast("string"), F.lit("\n12\n第三条 x\n一、y\n（一）z\n 1."), "o_orderstatus", F.lit("\n"), "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.outline_to_markdown(raw).alias("outline"))


@query(
    """SELECT r_regionkey, '| nation | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE CAST(n_nationkey AS VARCHAR) END || ' |', chr(10) ORDER BY n_nationkey) AS md
FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey"""
)
def cells_to_table(spark, sf_dir):
    row = F.when(F.col("n_nationkey") % 3 == 0, F.array(F.col("n_name"))).otherwise(F.array(F.col("n_name"), F.col("n_nationkey").cast("string")))
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = joined.groupBy("r_regionkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    return rows.select("r_regionkey", T.cells_to_table(F.concat(F.array(F.array(F.lit("nation"), F.lit("key"))), F.col("rows"))).alias("md"))


FINAL = """'---' || chr(10) || 'title: ' || CASE WHEN doc_id % 2 = 0 THEN '"no: ' || doc_id || '"' ELSE 'no ' || doc_id END || chr(10) || 'source: ' || source || chr(10) || 'category: ' || lang || chr(10) || '---'"""


@query(f"SELECT doc_id, {FINAL} || chr(10) || chr(10) || {CLEAN % 'text'} || chr(10) AS final_document FROM documents")
def final_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("title", F.concat(F.when(F.col("doc_id") % 2 == 0, "no: ").otherwise("no "), F.col("doc_id").cast("string"))).withColumn("category", F.col("lang"))
    for f in T.FIELDS:
        if f not in docs.columns:
            docs = docs.withColumn(f, F.lit(None).cast("string"))
    return docs.select("doc_id", T.final_document("text").alias("final_document"))


HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?is)<nav\b.*?</nav>', '', 'g'), '(?is)<footer\b.*?</footer>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<[^>]*>', chr(10), 'g')"""


@query(
    rf"""SELECT page_id, replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS title,
array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace({HTML}, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS body FROM pages"""
)
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_title("html", F.lit("stem")).alias("title"), T.html_text("html").alias("body"))


# Lines that the default list of site noise takes away, one for each way they begin, and two that stay.
NOISE_LINES = ("登录 | 注册", "2024年1月2日 星期二", "首页 Home", "首页", "Home", "政策文件库", "政策申报x", "政策宣贯", "政策汇编", "政策图谱", "政策传播", "搜索", "易找 易懂", "便捷易享", "汇编 聚焦", "数据服务", "观点 监测", "政策 活动", "| |", "首页 政策详情", "请输入政策标题", "原文", "![a](b)", "[登录", "- 首页", "- 政策文件", "-政策详情", "原文如下", "搜索结果")


@query(rf"SELECT doc_id, regexp_replace(array_to_string(list_filter(string_split({list(NOISE_LINES)!r}[doc_id % 29 + 1] || chr(10) || text, chr(10)), lambda x: NOT regexp_matches(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^(?:{any_of(TEXT_NOISE)})')), chr(10)), '^(?:[ \t]*\n)+', '') AS body FROM documents".replace("\\\\", "\\"))
def noise_lines_defaults(spark, sf_dir):
    line = F.get(F.array(*map(F.lit, NOISE_LINES)), (F.col("doc_id") % 29).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.noise_lines(F.concat(line, F.lit("\n"), "text")).alias("body"))


# ---- metadata of notices composed from orders

NAMED = ("某局", *AUTHORITIES)
SUBJECTS = ("事项", *(w for words in CATEGORIES.values() for w in words))
_D = "CAST(o_orderdate AS DATE)"
NOTICES = f"""n AS (SELECT o_orderkey, o_orderdate, {list(NAMED)!r}[o_orderkey % 33 + 1] AS name, CASE WHEN o_orderkey % 5 = 0 THEN {list(NAMED)!r}[(o_orderkey * 7 + 3) % 33 + 1] || '发' ELSE '财金' END AS prefix,
'关于' || {list(SUBJECTS)!r}[o_orderkey % 36 + 1] || '和' || {list(SUBJECTS)!r}[(o_orderkey * 5 + 1) % 36 + 1] || '的通知' AS title,
CASE o_orderkey % 4 WHEN 0 THEN '全国适用。' WHEN 1 THEN '各地区执行。' WHEN 2 THEN '浙江省' ELSE '' END AS region, ['施行', '执行', '实施'][o_orderkey % 3 + 1] AS verb FROM orders),
t AS (SELECT *, title || chr(10) || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE prefix || '〔2024〕' || o_orderkey || '号' || chr(10) END || CASE WHEN o_orderkey % 33 = 0 THEN '发布来源：' ELSE '' END || name || chr(10) || region AS said FROM n)"""


def notices(spark, sf_dir):
    """Notices that name every authority and keyword, with all forms of the fields."""
    day = lambda c: F.concat(F.year(c).cast("string"), F.lit("年"), F.month(c).cast("string"), F.lit("月"), F.dayofmonth(c).cast("string"), F.lit("日"))
    o, k = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")), F.col("o_orderkey")
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), n.cast("int"))
    d = F.col("o_orderdate").cast("date")
    prefix = F.when(k % 5 == 0, F.concat(pick(NAMED, (k * 7 + 3) % 33), F.lit("发"))).otherwise("财金")
    until = day(F.date_add(d, 400))
    body = F.concat(
        F.lit("关于"), pick(SUBJECTS, k % 36), F.lit("和"), pick(SUBJECTS, (k * 5 + 1) % 36), F.lit("的通知\n"),
        F.when(k % 11 == 0, "").otherwise(F.concat(prefix, F.lit("〔2024〕"), k.cast("string"), F.lit("号\n"))),
        F.when(k % 33 == 0, "发布来源：").otherwise(""), pick(NAMED, k % 33), F.lit("\n"), pick(("全国适用。\n", "各地区执行。\n", "浙江省 \n", ""), k % 4),
        F.lit("自"), day(F.date_add(d, 10)), F.lit("起"), pick(("施行", "执行", "实施"), k % 3), F.lit("，"),
        F.when(k % 5 == 1, F.concat(F.lit("执行至"), until)).when(k % 5 == 2, F.concat(F.lit("有效期自发布起，到"), until, F.lit("止"))).when(k % 5 == 3, "").otherwise(F.concat(F.lit("有效期至"), until)),
        F.lit("。\n"), day(d),
    )
    return o.select("o_orderkey", body.alias("text"))


_COUNTS = ", ".join(f"len(list_filter({list(words)!r}, lambda x: contains(said, x)))" for words in CATEGORIES.values())


@query(
    f"""WITH {NOTICES}, f AS (SELECT o_orderkey, title, CASE WHEN o_orderkey % 11 <> 0 THEN prefix || '〔2024〕' || o_orderkey || '号' END AS policy_number,
coalesce(CASE WHEN o_orderkey % 11 <> 0 THEN list_filter({list(AUTHORITIES)!r}, lambda x: contains(prefix, x))[1] END, list_filter({list(AUTHORITIES)!r}, lambda x: contains(said, x))[1], CASE WHEN o_orderkey % 33 = 0 THEN '某局' END) AS issuing_authority,
strftime({_D}, '%Y-%m-%d') AS publish_date, strftime({_D} + 10, '%Y-%m-%d') AS effective_date, CASE WHEN o_orderkey % 5 <> 3 THEN strftime({_D} + 400, '%Y-%m-%d') END AS expiry_date,
CASE WHEN o_orderkey % 4 < 2 THEN '全国' WHEN o_orderkey % 4 = 2 THEN '浙江省' END AS applicable_region, [{_COUNTS}] AS c FROM t),
g AS (SELECT *, CASE WHEN list_max(c) = 0 THEN '其他' ELSE {list(CATEGORIES)!r}[list_position(c, list_max(c))] END AS category FROM f)
SELECT o_orderkey, policy_number, issuing_authority, publish_date, effective_date, expiry_date, applicable_region, title, category,
array_to_string(list_filter([CASE WHEN policy_number IS NULL THEN 'policy_number' END, CASE WHEN issuing_authority IS NULL THEN 'issuing_authority' END, CASE WHEN expiry_date IS NULL THEN 'expiry_date' END, CASE WHEN applicable_region IS NULL THEN 'applicable_region' END], lambda x: x IS NOT NULL), ',') AS missing FROM g"""
)
def extract_metadata(spark, sf_dir):
    fields = ["policy_number", "issuing_authority", "publish_date", "effective_date", "expiry_date", "applicable_region", "title", "category"]
    found = M.extract_metadata(notices(spark, sf_dir)).select("o_orderkey", *fields)
    return found.withColumn("missing", F.array_join(M.missing_fields(fields), ","))


CATS = {"sea": ["the", "of"], "hill": ["le", "que", "de"], "field": ["der", "die"]}


@query(
    """WITH c AS (SELECT doc_id, source || ' ' || left(text, 1000) AS t FROM documents),
n AS (SELECT doc_id, CAST(contains(t,'the') AS INT)+CAST(contains(t,'of') AS INT) AS a, CAST(contains(t,'le') AS INT)+CAST(contains(t,'que') AS INT)+CAST(contains(t,'de') AS INT) AS b, CAST(contains(t,'der') AS INT)+CAST(contains(t,'die') AS INT) AS c FROM c)
SELECT doc_id, CASE WHEN greatest(a,b,c)=0 THEN '其他' WHEN a=greatest(a,b,c) THEN 'sea' WHEN b=greatest(a,b,c) THEN 'hill' ELSE 'field' END AS category FROM n"""
)
def classify_category(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", M.classify_category("source", "text", CATS).alias("category"))


@query("SELECT o_orderkey AS source, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey % 3 = 1 THEN o_orderpriority WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS title, CASE WHEN o_orderkey % 4 <> 0 THEN 'reply' END AS category FROM orders")
def merge_metadata(spark, sf_dir):
    """Three sources joined: parsed titles (some empty), matched ones, and replies for some."""
    o, k = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "source"), F.col("source") % 3
    parsed = o.select("source", F.when(k == 0, F.col("o_custkey").cast("string")).otherwise("").alias("title"))
    matched = o.filter(k == 1).select("source", F.col("o_orderpriority").alias("title"))
    replied = o.filter("source % 4 != 0").select("source", F.col("o_orderstatus").alias("title"), F.lit("reply").alias("category"))
    return M.merge_metadata(parsed, matched, replied, ["title", "category"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'title=' || o_custkey END AS found FROM orders")
def model_metadata_reply(spark, sf_dir):
    good = F.concat(F.lit('{"title": "'), F.col("o_custkey").cast("string"), F.lit('", "other": "x", "category": null}'))
    reply = F.when(F.col("o_orderkey") % 10 == 0, "{bad").when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).otherwise(good)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", reply.alias("reply"), F.array(F.lit("title"), F.lit("category")).alias("wanted"))
    got = M.model_metadata_reply("reply", "wanted")
    return rows.select("o_orderkey", F.array_join(F.transform(F.map_entries(got), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("found"))


# ---- sections, chunks, store

COMPOSED = """SELECT o_custkey, string_agg(CASE WHEN o_orderkey % 4 = 0 THEN '## ' || o_orderkey WHEN o_orderkey % 4 = 1 THEN '### ' || o_orderkey ELSE 'text ' || o_orderkey END, chr(10) ORDER BY o_orderkey) AS md FROM orders GROUP BY o_custkey"""


def composed(spark, sf_dir):
    key, m = F.col("o_orderkey").cast("string"), F.col("o_orderkey") % 4
    line = F.concat(F.when(m == 0, "## ").when(m == 1, "### ").otherwise("text "), key)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("md"))


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderkey % 4 AS m, CAST(sum(CASE WHEN o_orderkey % 4 < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS section_no FROM orders)
SELECT o_custkey, section_no, CASE WHEN section_no = 0 THEN 0 ELSE CAST(arg_min(m, o_orderkey) + 2 AS INT) END AS level, CASE WHEN section_no = 0 THEN '' ELSE CAST(min(o_orderkey) AS VARCHAR) END AS heading,
string_agg(CASE WHEN m = 0 THEN '## ' WHEN m = 1 THEN '### ' ELSE 'text ' END || o_orderkey, chr(10) ORDER BY o_orderkey) AS content FROM o GROUP BY o_custkey, section_no"""
)
def parse_sections(spark, sf_dir):
    return sections.parse_sections(composed(spark, sf_dir), "o_custkey", "md")


@query(
    """WITH c AS (SELECT o_custkey, count_if(o_orderkey % 4 = 0) AS n2, count_if(o_orderkey % 4 = 1) AS n3, coalesce(min(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END), 1e18) AS s2, coalesce(min(CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey END), 1e18) AS s3 FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN n3 >= 3 THEN 3 WHEN n2 >= 2 THEN 2 WHEN n2 + n3 = 0 THEN 0 WHEN n2 > n3 THEN 2 WHEN n3 > n2 THEN 3 WHEN s2 < s3 THEN 2 ELSE 3 END AS split_level FROM c"""
)
def split_level(spark, sf_dir):
    return sections.split_level(sections.parse_sections(composed(spark, sf_dir), "o_custkey", "md"), "o_custkey")


# Chunks by recursion: ``s`` is where the last chunk starts, ``f`` how many units are used up.  ``o`` lists
# the offsets behind the units; a chunk takes one new unit at least.
CHUNKED = """WITH RECURSIVE t AS (SELECT doc_id, {body} AS body FROM documents), u AS (SELECT doc_id, body, list_transform(string_split(body, chr(10)), lambda x: length(x) + 1) AS c FROM t WHERE {some}),
p AS (SELECT doc_id, body, list_prepend(0, list_transform(range(1, len(c) + 1), lambda i: CAST(list_sum(c[1:i]) AS BIGINT))) AS o FROM u),
e AS (SELECT doc_id, body, o, CAST(0 AS BIGINT) AS s, CAST(greatest(1, len(list_filter(o, lambda x: x <= {fit})) - 1) AS BIGINT) AS f, 0 AS k FROM p
UNION ALL SELECT doc_id, body, o, n, CAST(greatest(f + 1, len(list_filter(o, lambda x: x <= n + {fit})) - 1) AS BIGINT), k + 1 FROM (SELECT *, CAST(greatest(s, {restart}) AS BIGINT) AS n FROM e WHERE f < len(o) - 1)),
chunk AS (SELECT doc_id, k AS chunk_index, f = len(o) - 1 AS final, substring(body, s + 1, o[f + 1] - 1 - s) AS text FROM e)"""
PARAGRAPHS = CHUNKED.format(body=r"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))", some="body <> ''", fit="401", restart="o[f + 1] - 1 - 50")
FIXED = CHUNKED.format(body="text", some="length(body) > 800", fit="800", restart="list_min(list_filter(o, lambda x: x >= o[f + 1] - 1 - 100))")


@query(PARAGRAPHS + r" SELECT doc_id, chunk_index, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM chunk")
def chunk_paragraphs(spark, sf_dir):
    return chunking.chunk_paragraphs(table(spark, sf_dir, "documents"), "doc_id")


@query(FIXED + r" SELECT doc_id, chunk_index, text FROM chunk WHERE NOT final OR regexp_matches(text, '\S') UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 800")
def split_fixed(spark, sf_dir):
    return chunking.split_fixed(table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT doc_id, md5(source || '::parent::' || doc_id || '::0') AS id FROM documents")
def chunk_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", store.chunk_id("source", F.lit("parent"), "doc_id", F.lit("0")).alias("id"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedup_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat_ws("::", F.col("user_id").cast("string"), "event_type").alias("id"), "user_id", "event_type", "event_id")
    return store.dedup_ids(rows, ["event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def new_chunks_only(spark, sf_dir):
    return store.new_chunks_only(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def get_by_ids(spark, sf_dir):
    return store.get_by_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    """WITH d AS (SELECT source, doc_id, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 50000 AS INT) AS part FROM documents),
b AS (SELECT source, part, string_agg(text, chr(10) ORDER BY doc_id) AS body FROM d GROUP BY source, part), r AS (SELECT DISTINCT source FROM documents UNION ALL SELECT 'none')
SELECT r.source, coalesce(part, 0) AS part, CASE WHEN body IS NULL THEN '未找到文档' WHEN part = 0 THEN '文件：' || r.source || chr(10) || body ELSE body END AS detail FROM r LEFT JOIN b ON r.source = b.source"""
)
def document_detail(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("chunk_index"), "text")
    asked = docs.select("source").distinct().unionByName(spark.createDataFrame([("none",)], "source string"))
    return store.document_detail(asked, docs, part_chars=50_000)


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def store_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


LIMITED = """d AS (SELECT *, strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INT), '%Y-%m-%d') AS p FROM documents),
lq AS (SELECT *, '2024-0' || (item_id % 8 + 1) || '-01' AS f, CASE WHEN item_id % 5 = 0 THEN '2024-11-30' END AS t, CASE WHEN item_id % 2 = 0 THEN 'src' || (item_id % 20) END AS s, CASE WHEN item_id % 3 = 0 THEN 'de' ELSE '' END AS l FROM benchmark),
lim AS (SELECT item_id AS query_id, doc_id AS id FROM lq JOIN d ON p >= f AND (t IS NULL OR p <= t) AND (s IS NULL OR s = source) AND (l = '' OR l = lang))"""


def limited_items(spark, sf_dir):
    """The benchmark items as queries with limits of their own."""
    k = F.col("item_id")
    return table(spark, sf_dir, "benchmark").select(
        k.alias("query_id"), F.col("text").alias("query"), F.concat(F.lit("2024-0"), (k % 8 + 1).cast("string"), F.lit("-01")).alias("date_from"),
        F.when(k % 5 == 0, "2024-11-30").alias("date_to"), F.when(k % 2 == 0, F.concat(F.lit("src"), (k % 20).cast("string"))).alias("issuing_authority"), F.when(k % 3 == 0, "de").otherwise("").alias("category"),
    )


@query(f"WITH {LIMITED} SELECT query_id, count(*) AS n FROM lim GROUP BY 1")
def query_filter(spark, sf_dir):
    """Limits of each query: how many documents it may find."""
    return limited.matching(_dated(spark, sf_dir), limited_items(spark, sf_dir), "doc_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INT), '%Y-%m-%d') BETWEEN '2024-03-01' AND '2024-08-31' AND source = 'src3' AND lang = 'en'")
def metadata_filter(spark, sf_dir):
    return _dated(spark, sf_dir).filter(hybrid.metadata_filter("2024-03-01", "2024-08-31", "src3", "en")).select("doc_id")


def _dated(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("child").alias("role"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd").alias("publish_date"), F.col("source").alias("issuing_authority"), F.col("lang").alias("category"))


# ---- lexical search

TOKENS = r"""tok AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(regexp_replace(text, '[#*>\-|`]', ' ', 'g'), '[\p{L}\p{N}]+'), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[0-9.%]+$'))) AS term FROM documents)"""
BM25 = rf"""WITH {TOKENS}, tf AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL), dl AS MATERIALIZED (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
st AS MATERIALIZED (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM tf) / (SELECT count(*) FROM documents) AS avgdl),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
mean AS MATERIALIZED (SELECT avg(raw) AS mean FROM raw),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, mean),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(regexp_replace(text, '[#*>\-|`]', ' ', 'g'), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[0-9.%]+$'))) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id AS query_id, tf.doc_id AS id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
top AS (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20)"""


def corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(rf"WITH {TOKENS} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM tok GROUP BY doc_id")
def tokenize(spark, sf_dir):
    words = lexical.tokenize("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(words)).cast("bigint").alias("n_terms")).filter("n_tokens > 0")


def spread(rows):
    """Rows of a small file, which is one task to read, dealt to all cores."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def index(spark, sf_dir):
    """The index of the documents, written once."""
    return lexical.build_index(spread(corpus(spark, sf_dir).select("id", "text")), path=fresh_dir(spark, "index"))


@query(BM25 + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def build_index(spark, sf_dir):
    return index(spark, sf_dir)["terms"].withColumn("idf", F.round("idf", 6))


@query(BM25 + " SELECT * FROM top")
def bm25_search(spark, sf_dir):
    return lexical.bm25_search(index(spark, sf_dir), asked(spark, sf_dir))


def flagship(spark, sf_dir):
    return bm25_search(spark, sf_dir)


@query(rf"WITH {TOKENS}, tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL UNION ALL SELECT lang, doc_id, 5 FROM documents) SELECT term, doc_id AS id, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY ALL")
def weighted_keywords(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    return lexical.postings(docs, keywords=docs.select("id", F.create_map("lang", F.lit(5)).alias("keywords")))


# ---- vectors and hybrid search

VEC = """SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0"""


@query(
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / (2.0 * 2.0) * 4.0 / list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm2, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS x0 FROM embeddings"""
)
def l2_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    u = e.select("vec_id", vectors.l2_normalize("embedding").alias("u"))
    return u.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("norm2"), F.round(F.col("u")[0], 6).alias("x0"))


@query(f"SELECT query_id, id, round(s, 4) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS INT) AS rank FROM ({VEC}) QUALIFY rank <= 20")
def vector_topk(spark, sf_dir):
    return _near(spark, sf_dir)


def _near(spark, sf_dir, k=20):
    e = table(spark, sf_dir, "embeddings")
    return vectors.vector_topk(e.select(F.col("vec_id").alias("id"), "embedding"), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k, exclude_self=True)


LEGS = f"""v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM ({VEC}) QUALIFY rank <= 20),
l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY abs(id - query_id), id) AS rank FROM ({VEC}) QUALIFY rank <= 20),
legs AS (SELECT query_id, 0 AS leg, id, rank FROM v UNION ALL SELECT query_id, 1, id, rank FROM l),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS raw, min(leg * 100 + rank) AS seen FROM legs GROUP BY ALL),
fused AS (SELECT query_id, id, round(raw, 6) AS rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, seen, id) AS INT) AS rank FROM f QUALIFY rank <= 10)"""


def _legs(spark, sf_dir):
    """The vector leg, and a second leg that ranks by distance of ids."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    q = e.filter("id % 20 = 0").select(F.col("id").alias("query_id"))
    # The 20 nearest ids lie within 40 places, so the join is an equi-join on the neighbours.
    near = q.withColumn("id", F.explode(F.transform(F.sequence(F.lit(-40), F.lit(40)), lambda x: F.col("query_id") + x))).filter("id != query_id").join(e, "id", "left_semi")
    second = lexical.top_k(near, 20, "query_id", F.abs(F.col("id") - F.col("query_id")), F.col("id"))
    return _near(spark, sf_dir).select("query_id", F.lit(0).alias("leg"), "id", "rank").unionByName(second.select("query_id", F.lit(1).alias("leg"), "id", "rank"))


@query(f"WITH {LEGS} SELECT * FROM fused")
def rrf_merge(spark, sf_dir):
    return hybrid.rrf_merge(_legs(spark, sf_dir))


@query(f"WITH {LEGS}, x AS (SELECT query_id, id, rrf_score, (id * 7919 + query_id) % 1009 AS rerank_score FROM fused) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_score DESC, id) AS INT) AS rank FROM x QUALIFY rank <= 5")
def rerank(spark, sf_dir):
    fused = hybrid.rrf_merge(_legs(spark, sf_dir))
    return hybrid.rerank_scored(fused.withColumn("rerank_score", (F.col("id") * 7919 + F.col("query_id")) % 1009), 5)


@query(
    f"""WITH {LEGS}, p AS (SELECT query_id, id // 10 AS id, arg_min(rrf_score, rank) AS rrf_score, min(rank) AS first FROM fused GROUP BY query_id, id // 10)
SELECT query_id, id, rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, first) AS INT) AS rank FROM p WHERE id % 7 <> 0"""
)
def resolve_parents(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    parents = e.select(F.expr("vec_id div 10").alias("id")).distinct().filter("id % 7 != 0")
    return hybrid.resolve_parents(hybrid.rrf_merge(_legs(spark, sf_dir)).withColumn("parent_id", F.expr("id div 10")), parents)


@query(
    BM25
    + """, h AS (SELECT query_id, rank, source, score, text AS t FROM top JOIN documents ON id = doc_id WHERE rank <= 3)
SELECT item_id AS query_id, coalesce(a, '未找到相关政策') AS answer, coalesce(s, '') AS sources FROM benchmark LEFT JOIN (SELECT query_id, string_agg('[片段 ' || rank || ']' || chr(10) || '来源文件：' || source || chr(10) || '相关度：' || format('{:.4f}', score) || chr(10) || '内容：' || t, chr(10) || '---' || chr(10) ORDER BY rank) AS a FROM h GROUP BY 1) x ON x.query_id = item_id
LEFT JOIN (SELECT query_id, string_agg(source, ',' ORDER BY r) AS s FROM (SELECT query_id, source, min(rank) AS r FROM h GROUP BY ALL) GROUP BY 1) y ON y.query_id = item_id"""
)
def format_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    hits = bm25_search(spark, sf_dir).join(docs, "id")
    said = hybrid.format_hits(asked(spark, sf_dir), hits, 3)
    return said.withColumn("sources", F.array_join(hybrid.hit_sources("answer"), ","))


# ---- conversations

SPOKEN = "m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WHERE role IN ('user', 'assistant'))"


@query(f"WITH {SPOKEN} SELECT conv_id, turn, role, text FROM m WHERE back <= 4 AND NOT (total > 4 AND back = 4 AND role = 'assistant')")
def history_window(spark, sf_dir):
    return conversation.history_window(table(spark, sf_dir, "conversations"), 2)


@query(f"""WITH {SPOKEN} SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '用户' ELSE '助手' END || ': ' || CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END, chr(10) ORDER BY turn) AS context FROM m WHERE back <= 6 GROUP BY conv_id""")
def recent_context(spark, sf_dir):
    return conversation.recent_context(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, turn > 0 AND (contains(text, 'it') OR contains(text, 'that') OR length(text) < 10) AS rewrite FROM conversations WHERE role = 'user'")
def needs_rewrite(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").filter("role = 'user'").withColumn("history", F.when(F.col("turn") > 0, "x"))
    return said.select("conv_id", "turn", conversation.needs_rewrite("text", "history", ["it", "that"]).alias("rewrite"))


@query(
    f"""WITH m AS (SELECT *, row_number() OVER w AS n, list({{'turn': turn, 'role': role}}) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS kept FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, array_to_string(list_transform(CASE WHEN n > 4 AND kept[1].role = 'assistant' THEN kept[2:] ELSE kept END, lambda x: x.turn || ':' || x.role), ',') AS kept FROM m"""
)
def history_at_turns(spark, sf_dir):
    made = conversation.history_at_turns(table(spark, sf_dir, "conversations"), 2)
    return made.select("conv_id", "turn", F.array_join(F.transform("kept", lambda m: F.concat_ws(":", m["turn"].cast("string"), m["role"])), ",").alias("kept"))


@query(f"SELECT conv_id, turn, turn > 0 AND (len(list_filter({list(REFERRING)!r}, lambda w: contains(q, w))) > 0 OR length(q) < 10) AS rewrite FROM (SELECT conv_id, turn, text || coalesce({list(REFERRING)!r}[(conv_id * 7 + turn) % 17], '') AS q FROM conversations WHERE role = 'user')")
def needs_rewrite_defaults(spark, sf_dir):
    """Each of the words that refer to what was said, at the end of a query, or none."""
    word = F.get(F.array(*map(F.lit, REFERRING)), ((F.col("conv_id") * 7 + F.col("turn")) % 17).cast("int") - 1)
    said = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.concat("text", F.coalesce(word, F.lit(""))).alias("q"), F.when(F.col("turn") > 0, "x").alias("history"))
    return said.select("conv_id", "turn", conversation.needs_rewrite("q", "history").alias("rewrite"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text WHEN item_id % 3 = 1 THEN 'ok reply' ELSE text END AS query FROM benchmark")
def accept_rewrite(spark, sf_dir):
    k = F.col("item_id") % 3
    b = table(spark, sf_dir, "benchmark").withColumn("reply", F.when(k == 1, " ok reply ").when(k == 2, F.repeat("text", F.lit(6))))
    return b.select("item_id", conversation.accept_rewrite("text", "reply").alias("query"))


# ---- cache: entries keyed by user and event type

ENTRIES = "e AS (SELECT user_id || ':' || event_type AS key, max(ts) AS ts, min(ts) AS seen FROM events GROUP BY ALL)"


def entries(spark, sf_dir):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key")
    return table(spark, sf_dir, "events").groupBy(key).agg(F.max("ts").alias("ts"), F.min("ts").alias("seen"))


@query("SELECT event_id FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT (SELECT count(*) // 2 FROM events)")
def cache_evict_half(spark, sf_dir):
    """Half of a cache with an entry an event."""
    e = table(spark, sf_dir, "events")
    held = e.select("event_id", F.col("event_id").cast("string").alias("key"), F.col("ts").alias("last_accessed"))
    return cache.cache_evict_lru(held, e.count() // 2, take=0).select("event_id")


@query(f"WITH {ENTRIES}, n AS (SELECT max(ts) AS now FROM events) SELECT key FROM e, n WHERE epoch(date_trunc('second', now)) - epoch(date_trunc('second', ts)) <= 86400")
def cache_expire(spark, sf_dir):
    now = table(spark, sf_dir, "events").agg(F.max("ts").alias("now"))
    return cache.cache_expire(entries(spark, sf_dir).crossJoin(F.broadcast(now)), F.col("now")).select("key")


@query(f"WITH {ENTRIES} SELECT key FROM e ORDER BY ts DESC, key LIMIT 100")
def cache_evict_lru(spark, sf_dir):
    return cache.cache_evict_lru(entries(spark, sf_dir).withColumn("last_accessed", F.col("ts")), 100).select("key")


@query(f"WITH {ENTRIES} SELECT count(*) AS n, 1000 AS capacity FROM e")
def cache_stats(spark, sf_dir):
    return entries(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.lit(1000).alias("capacity"))


@query(f"WITH {ENTRIES} SELECT key FROM e WHERE CAST(split_part(key, ':', 1) AS BIGINT) % 3 <> 0")
def cache_invalidate(spark, sf_dir):
    return cache.cache_invalidate(*_sourced(spark, sf_dir)).select("key")


@query(f"WITH {ENTRIES} SELECT count(*) AS invalidated FROM e WHERE CAST(split_part(key, ':', 1) AS BIGINT) % 3 = 0")
def cache_invalidated(spark, sf_dir):
    return cache.cache_invalidated(*_sourced(spark, sf_dir))


def _sourced(spark, sf_dir):
    """Entries whose sources are their user and ``all``; a third of the users are updated."""
    updated = table(spark, sf_dir, "events").filter("user_id % 3 = 0").select(F.col("user_id").cast("string").alias("source")).distinct()
    return entries(spark, sf_dir).withColumn("sources", F.array(F.split("key", ":")[0], F.lit("all"))), updated


@query(f"WITH {ENTRIES} SELECT key, CASE WHEN split_part(key, ':', 2) = 'click' THEN ts ELSE seen END AS last_accessed FROM e")
def cache_touch(spark, sf_dir):
    clicks = table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), F.col("ts").alias("hit_ts"))
    return cache.cache_touch(entries(spark, sf_dir).withColumn("last_accessed", F.col("seen")), clicks).select("key", "last_accessed")


@query(f"WITH {ENTRIES} SELECT key, CASE WHEN split_part(key, ':', 2) = 'click' THEN 'new' ELSE 'old' END AS answer FROM e")
def cache_upsert(spark, sf_dir):
    old = entries(spark, sf_dir).select("key", F.col("seen").alias("ts"), F.lit("old").alias("answer"))
    new = entries(spark, sf_dir).filter("key like '%:click'").select("key", "ts", F.lit("new").alias("answer"))
    return cache.cache_upsert(old, new).select("key", "answer")


@query(f"SELECT q.vec_id AS query_id, CASE WHEN round(s, 4) >= 0.5 THEN 'k' || id END AS key FROM embeddings q LEFT JOIN (SELECT query_id, id, s FROM ({VEC}) WHERE id % 20 <> 0 AND id % 48 <= 24 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, 'k' || id) = 1) ON query_id = q.vec_id WHERE q.vec_id % 20 = 0")
def cache_lookup(spark, sf_dir):
    """Entries of all ages up to two days, a day to live."""
    e = table(spark, sf_dir, "embeddings")
    now = F.lit("2024-06-03 00:00:00").cast("timestamp")
    held = e.filter("vec_id % 20 != 0").select(F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("key"), "embedding", (now - F.make_interval(hours=(F.col("vec_id") % 48).cast("int"))).alias("ts"))
    return cache.cache_lookup(held, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), now, threshold=0.5).select("query_id", "key")


@query("SELECT vec_id, md5(array_to_string(list_transform(embedding[1:10], lambda x: printf('%.6f', CAST(x AS DOUBLE))), ',')) AS key FROM embeddings")
def cache_key(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", cache.cache_key("embedding").alias("key"))


# ---- evaluation: items against the documents that contain them

EXPECTED = "ex AS (SELECT DISTINCT item_id AS query_id, source FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
RANKED = f"rk AS (SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), source) AS rank FROM top JOIN documents ON id = doc_id GROUP BY query_id, source), {EXPECTED}, hit AS (SELECT query_id, min(rank) AS first FROM rk JOIN ex USING (query_id, source) GROUP BY 1), sc AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'even' END AS category, CASE WHEN ex.query_id IS NULL OR first <= 5 THEN 1.0 ELSE 0.0 END AS recall, CASE WHEN ex.query_id IS NULL THEN 1.0 ELSE coalesce(1.0::DOUBLE / first, 0) END AS rr FROM benchmark LEFT JOIN (SELECT DISTINCT query_id FROM ex) ex ON ex.query_id = item_id LEFT JOIN hit ON hit.query_id = item_id)".replace(", sc AS", ", score AS")


def expected(spark, sf_dir):
    """Sources whose texts hold the item, worked out once."""
    docs = spread(table(spark, sf_dir, "documents").select("source", "text"))
    return stage(evaluation.containing(docs, asked(spark, sf_dir).withColumnRenamed("query", "item")).distinct(), "expected")


def ranked(spark, sf_dir):
    hits = bm25_search(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return evaluation.dedup_sources(hits)


def scored(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "even").alias("category"))
    return evaluation.score_queries(items, expected(spark, sf_dir), ranked(spark, sf_dir), 5)


@query(BM25 + f", {RANKED} SELECT query_id, source, CAST(rank AS INT) AS rank FROM rk")
def dedup_sources(spark, sf_dir):
    return ranked(spark, sf_dir)


@query(BM25 + f", {RANKED} SELECT query_id, CAST(recall AS DOUBLE) AS recall, round(rr, 6) AS rr FROM score")
def recall_and_mrr(spark, sf_dir):
    return scored(spark, sf_dir).select("query_id", "recall", F.round("rr", 6).alias("rr"))


@query(BM25 + f", {RANKED} SELECT CASE WHEN grouping(c) = 1 THEN 'overall' ELSE c END AS category, count(*) AS total, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM (SELECT coalesce(category, '其他') AS c, recall, rr FROM score) GROUP BY GROUPING SETS ((), (c))")
def evaluate_retrieval(spark, sf_dir):
    return evaluation.evaluate_retrieval(scored(spark, sf_dir))


LABELLED = f"""WITH {LEGS}, lab AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS source FROM embeddings), e2 AS (SELECT vec_id AS query_id, CAST(label AS VARCHAR) AS source FROM embeddings WHERE vec_id % 20 = 0),
rv AS (SELECT query_id, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY min(rank), source) AS INT) AS rank FROM v JOIN lab USING (id) GROUP BY query_id, source),
rl AS (SELECT query_id, source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY min(rank), source) AS INT) AS rank FROM l JOIN lab USING (id) GROUP BY query_id, source)"""


def _labelled(spark, sf_dir):
    """Queries, the label each expects, and the labels that both legs of a search rank."""
    lab = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("source"))
    wanted = lab.filter("id % 20 = 0").withColumnRenamed("id", "query_id")
    legs = stage(_legs(spark, sf_dir), "legs").join(lab, "id")
    return wanted, *(evaluation.dedup_sources(legs.filter(F.col("leg") == n)) for n in (0, 1))


@query(LABELLED + " SELECT e2.query_id, e2.source AS expected, r.retrieved FROM e2 JOIN (SELECT query_id, string_agg(source, ',' ORDER BY rank) AS retrieved FROM rl WHERE rank <= 3 GROUP BY 1) r USING (query_id) WHERE NOT EXISTS (SELECT 1 FROM rl WHERE rl.query_id = e2.query_id AND rl.source = e2.source AND rank <= 3)")
def retrieval_failures(spark, sf_dir):
    """Searches by distance of ids that miss the label of the query among the first three."""
    wanted, _, far = _labelled(spark, sf_dir)
    found = evaluation.score_queries(wanted.select("query_id"), wanted, far, 3)
    lost = evaluation.retrieval_failures(found, wanted, far, 3)
    return lost.select("query_id", F.array_join("expected", ",").alias("expected"), F.array_join("retrieved", ",").alias("retrieved"))


SWEPT = "round(avg(CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_at_k, round(avg(CASE WHEN first <= {k} THEN 1.0::DOUBLE / first ELSE 0 END), 6) AS mrr, count(*) FILTER (first IS NULL OR first > {k}) AS failures"


@query(LABELLED + f", h AS (SELECT e2.query_id, min(rl.rank) AS first FROM e2 LEFT JOIN rl USING (query_id, source) GROUP BY 1) SELECT k AS value, {SWEPT.format(k='k')} FROM h, (SELECT CAST(unnest([1, 3, 5]) AS INT) AS k) GROUP BY k")
def sweep_top_k(spark, sf_dir):
    wanted, _, far = _labelled(spark, sf_dir)
    return evaluation.cut_sweep(far, wanted, [1, 3, 5])


@query(LABELLED + f", h AS (SELECT false AS value, e2.query_id, rv.rank AS first FROM e2 LEFT JOIN rv USING (query_id, source) UNION ALL SELECT true, e2.query_id, rl.rank FROM e2 LEFT JOIN rl USING (query_id, source)) SELECT value, {SWEPT.format(k='3')} FROM h GROUP BY value")
def sweep_use_rerank(spark, sf_dir):
    """The vector leg against the other, in the place of a reranked list."""
    wanted, near, far = _labelled(spark, sf_dir)
    return evaluation.rerank_sweep(near, far, wanted, 3)


@query("SELECT DISTINCT source, source AS name FROM documents")
def normalize_source(spark, sf_dir):
    named = F.concat(F.lit("　"), "source", F.lit(".html"))
    return table(spark, sf_dir, "documents").select("source").distinct().select("source", evaluation.normalize_source(named).alias("name"))


SWEEP = f"""{LEGS}, lab AS (SELECT vec_id AS id, label AS source FROM embeddings), s AS (SELECT query_id, leg, source, rank FROM legs JOIN lab USING (id)), e2 AS (SELECT vec_id AS query_id, label AS source FROM embeddings WHERE vec_id % 20 = 0),
g AS (SELECT k AS value, query_id, source, round(sum(1.0::DOUBLE / (k + rank)), 9) AS t FROM s, (SELECT unnest([20.0, 60.0, 100.0])::DOUBLE AS k) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY value, query_id ORDER BY t DESC, source) AS rank FROM g),
h AS (SELECT value, query_id, min(rank) AS first FROM r JOIN e2 USING (query_id, source) WHERE rank <= 3 GROUP BY ALL), sweep AS (SELECT k.value, round(avg(CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, count(*) FILTER (first IS NULL) AS failures FROM (SELECT DISTINCT value FROM g) k CROSS JOIN e2 LEFT JOIN h ON h.value = k.value AND h.query_id = e2.query_id GROUP BY 1)"""


def _sweep(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    legs = _legs(spark, sf_dir).join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("source")), "id")
    return evaluation.param_sweep(legs, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("source")), [20, 60, 100], 3)


@query(f"WITH {SWEEP} SELECT * FROM sweep")
def param_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query(f"WITH {SWEEP} SELECT value, recall_at_k FROM sweep ORDER BY recall_at_k DESC, value LIMIT 1")
def best_param(spark, sf_dir):
    return evaluation.best_param(_sweep(spark, sf_dir)).select("value", "recall_at_k")


JUDGED = "j AS (SELECT o_orderkey, o_orderpriority AS category, o_orderkey % 10 = 0 AS bad, CAST(o_orderkey % 5 + 1 AS INT) AS f FROM orders)"


def judged(spark, sf_dir):
    good = F.concat(F.lit('{"faithfulness": '), (F.col("o_orderkey") % 5 + 1).cast("string"), F.lit(', "relevance": 4, "completeness": 3, "correctness": 2, "reason": "fine"}'))
    reply = F.when(F.col("o_orderkey") % 10 == 0, "not json").when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).otherwise(good)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("category"), reply.alias("reply")).select("o_orderkey", "category", *evaluation.judge_reply("reply"))


@query(f"WITH {JUDGED} SELECT o_orderkey, category, CASE WHEN bad THEN 0 ELSE f END AS faithfulness, CASE WHEN bad THEN 0 ELSE 4 END AS relevance, CASE WHEN bad THEN 0 ELSE 3 END AS completeness, CASE WHEN bad THEN 0 ELSE 2 END AS correctness, CASE WHEN bad THEN 'JSON 解析失败: not json' ELSE 'fine' END AS reason FROM j")
def judge_reply(spark, sf_dir):
    return judged(spark, sf_dir)


@query(
    f"""WITH {JUDGED} SELECT CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category, round(avg(CASE WHEN bad THEN 0 ELSE f END), 6) AS faithfulness, round(avg(CASE WHEN bad THEN 0 ELSE 4 END), 6) AS relevance, round(avg(CASE WHEN bad THEN 0 ELSE 3 END), 6) AS completeness, round(avg(CASE WHEN bad THEN 0 ELSE 2 END), 6) AS correctness FROM j GROUP BY GROUPING SETS ((), (category))"""
)
def judge_summary(spark, sf_dir):
    return evaluation.judge_summary(judged(spark, sf_dir))


@query(BM25 + """ SELECT item_id AS query_id, coalesce(c, '（无检索结果）') AS context FROM benchmark LEFT JOIN (SELECT query_id, left(string_agg(text, chr(10) || '---' || chr(10) ORDER BY rank), 2000) AS c FROM top JOIN documents ON id = doc_id WHERE rank <= 5 GROUP BY 1) ON query_id = item_id""")
def judge_input(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    hits = bm25_search(spark, sf_dir).filter("rank <= 5").join(docs, "id").select("query_id", "rank", "text")
    return evaluation.judge_input(asked(spark, sf_dir).select("query_id").join(hits, "query_id", "left"))
