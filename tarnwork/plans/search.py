"""Registered queries on the vector index and on search under limits."""

from pyspark.sql import functions as F

from ..folders import fresh_dir
from ..operators import hybrid, lexical
from ..operators.vector_index import VectorIndex, recall_at
from .catalogue import BM25, LIMITED, _dated, _near, corpus, limited_items, query, table


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _indexed(spark, sf_dir):
    """Vectors of ids divisible by 20 against an index of all, written and loaded."""
    path, rows = fresh_dir(spark, "vector-index"), _vectors(spark, sf_dir)
    VectorIndex.build(rows, path)
    return VectorIndex.load(spark, path).search(rows.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 20, exclude_self=True)


@query()
def vector_index(spark, sf_dir):
    return _indexed(spark, sf_dir)


@query("SELECT 20 * count(*) FILTER (vec_id % 20 = 0) AS wanted, true AS reached FROM embeddings")
def vector_index_recall(spark, sf_dir):
    """Whether the index finds at least nine tenths of the exact neighbours."""
    return recall_at(_indexed(spark, sf_dir), _near(spark, sf_dir), 20).select("wanted", (F.col("recall") >= 0.9).alias("reached"))


# The tables of the search: documents with a vector of their id, items with one.
PARTS = BM25.replace("FROM documents", "FROM chunk").replace("FROM benchmark", "FROM asked").replace("WITH tok", f"WITH {LIMITED}, chunk AS (SELECT d.*, embedding FROM d JOIN embeddings ON vec_id = doc_id), asked AS (SELECT lq.*, embedding FROM lq JOIN embeddings ON vec_id = item_id), tok")
FUSED = """ {parts},
near AS (SELECT a.item_id AS query_id, c.doc_id AS id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS s FROM asked a JOIN lim ON lim.query_id = a.item_id JOIN chunk c ON c.doc_id = lim.id),
said AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc JOIN lim USING (query_id, id) WHERE score > 0 QUALIFY rank <= 20),
legs AS (SELECT query_id, 0 AS leg, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM near QUALIFY rank <= 20 UNION ALL SELECT query_id, 1, id, rank FROM {lexical}),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS raw, min(leg * 100 + rank) AS seen FROM legs GROUP BY ALL),
fused AS (SELECT query_id, id, round(raw, 6) AS rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, seen, id) AS INT) AS rank FROM f QUALIFY rank <= {top})"""


def _limited(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    chunks = corpus(spark, sf_dir).select("id", "text").join(_dated(spark, sf_dir).withColumnRenamed("doc_id", "id"), "id").join(vectors, "id")
    asked = limited_items(spark, sf_dir).join(vectors.withColumnRenamed("id", "query_id"), "query_id")
    return chunks, asked, lexical.build_index(chunks, path=fresh_dir(spark, "index"))


@query(FUSED.format(parts=PARTS, lexical="said", top=7) + " SELECT * FROM fused")
def hybrid_search_limits(spark, sf_dir):
    """Both legs under the limits of each query."""
    return hybrid.hybrid_search(*_limited(spark, sf_dir), limits=True, filter_legs=("vector", "bm25"))


OVERLAP = r"""list_distinct(list_filter(regexp_extract_all(regexp_replace({t}, '[#*>\-|`]', ' ', 'g'), '[\p{{L}}\p{{N}}]+'), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[0-9.%]+$')))"""


@query(
    FUSED.format(parts=PARTS, lexical="top", top=10)
    + f""", x AS (SELECT query_id, id, rrf_score, {OVERLAP.format(t='a.text')} AS w, {OVERLAP.format(t='c.text')} AS v FROM fused JOIN asked a ON a.item_id = query_id JOIN chunk c ON c.doc_id = id),
y AS (SELECT query_id, id, rrf_score, round(len(list_intersect(w, v)) / greatest(len(w), 1), 6) AS rerank_score FROM x)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_score DESC, id) AS INT) AS rank FROM y QUALIFY rank <= 7"""
)
def rerank_overlap(spark, sf_dir):
    """The vector leg alone under limits, hits reranked by their share of the query's tokens."""
    return hybrid.hybrid_search(*_limited(spark, sf_dir), score=hybrid.overlap_score, limits=True)
