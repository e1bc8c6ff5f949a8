"""Fusion of legs, reranking, parents and presentation."""

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .lexical import bm25_search, tokenize, top_k
from .limited import limited_topk, matching
from .vectors import vector_topk


def rrf_merge(legs, k=60, top=10):
    """``legs``: query_id, leg (0 vector, 1 lexical), id, rank.  Adds 1 / (k + rank) over the
    legs; ties: lower leg, then rank, then id."""
    # Dealt anew by both keys: Spark 4.1 may take a union of legs that are each dealt by query
    # for dealt by query as a whole, and was seen to return a query's rows twice.
    dealt = legs.repartition("query_id", "id")
    fused = dealt.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("raw"), F.min(F.struct("leg", "rank")).alias("seen"))
    ranked = top_k(fused.withColumn("raw", F.round("raw", 9)), top, "query_id", F.desc("raw"), F.col("seen.leg"), F.col("seen.rank"), F.col("id"))
    return ranked.select("query_id", "id", F.round("raw", 6).alias("rrf_score"), "rank")


def rerank(hits, scores, top):
    """Keeps the ``top`` hits of each query by a table of pair scores (query_id, id, rerank_score)."""
    return rerank_scored(hits.join(scores, ["query_id", "id"]), top)


def rerank_scored(hits, top):
    """The same where ``rerank_score`` is a column of the hits, as a pair scorer adds it."""
    return top_k(hits.drop("rank"), top, "query_id", F.desc("rerank_score"), F.desc("rrf_score"), F.col("id"))


def resolve_parents(hits, parents):
    """Children (query_id, id, parent_id, rrf_score, rank) to their parents, each with the score of its
    first child.  Where no child of a query has a parent, its hits are returned as they are."""
    any_parent = F.max(F.col("parent_id").isNotNull()).over(Window.partitionBy("query_id"))
    marked = hits.withColumn("any_parent", any_parent)
    found = marked.filter("any_parent and parent_id is not null").groupBy("query_id", F.col("parent_id").alias("id")).agg(F.min_by("rrf_score", "rank").alias("rrf_score"), F.min("rank").alias("first"))
    found = found.join(parents.select("id"), "id", "left_semi")
    alone = marked.filter("not any_parent").select("query_id", "id", "rrf_score", F.col("rank").alias("first"))
    return top_k(found.unionByName(alone), 2**31 - 1, "query_id", F.desc("rrf_score"), F.col("first")).select("query_id", "id", "rrf_score", "rank")


def hybrid_search(chunks, queries, index, keep=None, score=None, top=7, leg_top=20, k=60, parents=None, limits=False, filter_legs=("vector",)):
    """Vector and lexical legs over ``chunks`` (id, text, embedding, perhaps parent_id), fused.

    ``queries``: query_id, query, embedding.  ``keep``: a predicate on the chunks (see
    ``metadata_filter``); ``limits``: whether the queries carry limits of their own (see
    ``limited``).  Both hold for the legs that ``filter_legs`` names ("vector", "bm25"); a leg
    that is not named may return chunks that they reject, and the index keeps the statistics
    of all its chunks.  ``score``: a function that adds ``rerank_score`` to (query_id, query, id,
    text, rrf_score), as ``overlap_score``; with it ten fused hits are scored."""
    kept = chunks if keep is None else chunks.filter(keep)
    if "vector" not in filter_legs:
        near = vector_topk(chunks, queries, leg_top)
    else:
        near = limited_topk(kept, queries, leg_top) if limits else vector_topk(kept, queries, leg_top)

    def admitted_hits(hits):
        hits = hits.join(kept.select("id"), "id", "left_semi") if keep is not None else hits
        return hits.join(matching(kept, queries), ["query_id", "id"], "left_semi") if limits else hits

    said = bm25_search(index, queries, leg_top, keep=admitted_hits if "bm25" in filter_legs else None)
    legs = near.select("query_id", F.lit(0).alias("leg"), "id", "rank").unionByName(said.select("query_id", F.lit(1).alias("leg"), "id", "rank"))
    hits = rrf_merge(legs, k, top if score is None else 10)
    if score is not None:
        pairs = hits.join(chunks.select("id", "text"), "id").join(queries.select("query_id", "query"), "query_id")
        hits = rerank_scored(score(pairs), top).select("query_id", "id", "rrf_score", "rerank_score", "rank")
    if parents is None:
        return hits
    return resolve_parents(hits.join(chunks.select("id", "parent_id"), "id"), parents)


def overlap_score(pairs):
    """``rerank_score``: the share of the query's different tokens that the text has (0 without
    tokens): the pair scorer where no model is plugged in."""
    asked = F.array_distinct(tokenize("query"))
    share = F.size(F.array_intersect(asked, tokenize("text"))) / F.greatest(F.size(asked), F.lit(1))
    return pairs.withColumn("rerank_score", F.coalesce(F.round(share, 6), F.lit(0.0)))


def shown_score(columns):
    """The score that is shown of a hit: of fusion, else of the reranker, else of the search."""
    return F.coalesce(*(F.col(c).cast("double") for c in ("rrf_score", "rerank_score", "score") if c in columns), F.lit(0.0))


def four_digits(c):
    """Rounded by the exact value, as by C; "%.4f" of Java rounds the shortest decimal, half up."""

    @F.arrow_udf("string")
    def run(scores: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f"{x:.4f}" for x in scores.to_pylist()], pa.string())

    return run(c)


def format_hits(queries, hits, top=5, empty="未找到相关政策"):
    """One text a query: its first ``top`` hits (1 to 10) as numbered blocks in rank order."""
    most = min(max(1, top), 10)
    piece = F.concat(F.lit("[片段 "), F.col("rank").cast("string"), F.lit("]\n来源文件："), F.col("source"), F.lit("\n相关度："), four_digits(shown_score(hits.columns)), F.lit("\n内容："), F.col("text"))
    said = hits.filter(F.col("rank") <= most).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", piece.alias("p")))), lambda x: x["p"]), "\n---\n").alias("answer"))
    return queries.select("query_id").join(said, "query_id", "left").withColumn("answer", F.coalesce("answer", F.lit(empty)))


def hit_sources(answer):
    """Source names of a formatted text, in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(F.col(answer), F.lit(r"(?m)^来源文件：(.*)$"), F.lit(1)))


def metadata_filter(date_from=None, date_to=None, issuing_authority=None, category=None):
    """Predicate of the given limits; empty ones are ignored, null fields never match."""
    out = F.col("role") == "child"
    if date_from:
        out &= F.col("publish_date") >= date_from
    if date_to:
        out &= F.col("publish_date") <= date_to
    if issuing_authority:
        out &= F.col("issuing_authority") == issuing_authority
    if category:
        out &= F.col("category") == category
    return out
