"""Tables of documents as rows, and the chunks that hold them."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tables as T


def process_tables(docs, replies=None, id_col="source", text_col="markdown", tables_col=None):
    """A row a table: ``table_no``, ``page``, ``markdown``, ``natural_language``, ``section``, and from
    ``replies`` (id, table_no, reply) ``questions`` and ``keywords``, empty where none came.

    ``tables_col``: a column of tables that a parser found, array<struct<markdown, page>>; without
    it tables are found in the text, and their page is 0."""
    found = F.transform(T.extract_tables(text_col), lambda m: F.struct(m.alias("markdown"), F.lit(0).alias("page"))) if tables_col is None else F.col(tables_col)
    cut = docs.select(id_col, F.col(text_col).alias("_full"), F.posexplode(found).alias("table_no", "_t"))
    cut = cut.select(id_col, "_full", "table_no", F.coalesce(F.col("_t")["page"].cast("int"), F.lit(0)).alias("page"), F.col("_t")["markdown"].alias("markdown"))
    found = cut.select(id_col, "table_no", "page", "markdown", T.table_to_sentences("markdown").alias("natural_language"), T.table_section("markdown", "_full").alias("section"))
    if replies is None:
        return found
    joined = found.join(replies.select(id_col, "table_no", "reply"), [id_col, "table_no"], "left")
    return joined.withColumn("_r", T.table_qk_reply("reply")).select(*found.columns, "_r.questions", "_r.keywords")


def table_keyword_anchor(tables, chunks, id_col="source", order=("chunk_index",), shown=50):
    """The first child chunk, by ``order``, that holds the beginning of each table with keywords."""
    start = tables.filter(F.size("keywords") > 0).select(id_col, "table_no", "keywords", F.left("markdown", F.lit(shown)).alias("_start"))
    hit = chunks.join(start, id_col).filter(F.contains("text", F.col("_start")))
    w = Window.partitionBy(id_col, "table_no").orderBy(*order)
    return hit.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(id_col, "table_no", F.col("id"), "keywords")
