"""Nearest rows inside groups: both sides are dealt to keys, and each key's product is blocked.

Rows and queries that share a key (``deal``) meet in groups of about ROWS rows and QUERIES
queries, whatever the size of the key: a key of many rows is cut into blocks by a hash of the
row, a key of many queries into blocks of queries, and each block of rows meets each block of
queries once.  A group is a matrix product, made SLICE queries at a time; it gives the best ``k``
rows of each query.  The product only picks candidates: their scores are added up anew in order of
the components, so that equal vectors have equal scores wherever they stand."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..folders import stage
from .lexical import top_k

ROWS, QUERIES = 8192, 512
FEW_DEALS = 100_000  # so many sizes of deals may be broadcast
SLICE = 128  # queries whose scores a task holds at once
ROUNDING = 1e-9  # more than a product in another order can differ, for components up to a thousand


def matrix(column, width=None):
    """(row numbers, matrix) of the vectors of an Arrow list column that have ``width``
    components (that of the first if None), none of them null."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths().fill_null(-1))
    if width is None:
        width = next((int(n) for n in sizes if n > 0), 0)
    at = np.flatnonzero(sizes == width) if width else np.zeros(0, np.int64)
    flat = lists.take(pa.array(at, pa.int64())).flatten().cast(pa.float64())
    made = flat.to_numpy(zero_copy_only=False).reshape(-1, width or 1)
    if flat.null_count:
        whole = np.asarray(flat.is_valid()).reshape(-1, width).all(1)
        at, made = at[whole], made[whole]
    return at, made


def in_order(left, right):
    """The dot products of the rows of two matrices, each added up in order of the components."""
    total = np.zeros(len(left))
    for d in range(left.shape[1]):
        total += left[:, d] * right[:, d]
    return total


def best_of(queries, vectors, ids, k, allowed=None):
    """(query number, vector number, score) of the best ``k`` rows of ``vectors`` for each row of
    ``queries``, ties by id, as arrays in order.  ``allowed``: which pairs count (queries x vectors)."""
    scores = queries @ vectors.T
    if allowed is not None:
        scores[~allowed] = -np.inf
    floor = np.full((len(scores), 1), -np.inf)
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
    # Room for rounding, also of large values; what is not finite is no candidate.
    room = ROUNDING * np.maximum(1, np.abs(np.where(np.isfinite(floor), floor, 0)))
    q, v = np.nonzero((scores >= floor - room) & np.isfinite(scores))
    exact = in_order(queries[q], vectors[v])
    order = np.lexsort((ids[v], -exact, q))
    q, v, exact = q[order], v[order], exact[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[best], v[best], exact[best]


def dealt_blocks(rows, asked, row_hash, query_hash, block_rows=ROWS, block_queries=QUERIES):
    """``rows`` and ``asked`` (both with ``deal``) with ``block`` and ``qblock``: every row of a
    deal meets every query of it in exactly one pair.  Deals of one side alone are left out.

    Either side may come of an ``explode``, whose rows Spark does not count in its estimates, so it
    is said here what may be broadcast: the sizes, a row a deal, if they are few; vectors never."""
    sizes = rows.groupBy("deal").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    sizes = sizes.hint("merge").join(asked.groupBy("deal").agg(F.ceil(F.count("*") / F.lit(block_queries)).cast("int").alias("qblocks")), "deal")
    sizes = stage(sizes, "deal-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= FEW_DEALS else sizes.hint("merge")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(sizes, "deal").withColumn("block", F.pmod(row_hash, F.col("blocks")).cast("int")).withColumn("qblock", each("qblocks"))
    right = asked.join(sizes, "deal").withColumn("qblock", F.pmod(query_hash, F.col("qblocks")).cast("int")).withColumn("block", each("blocks"))
    return left.drop("blocks", "qblocks"), right.drop("blocks", "qblocks")


def grouped_topk(rows, asked, k, exclude_self=False, allowed=None, block_rows=ROWS, block_queries=QUERIES):
    """Top ``k`` of ``rows`` (deal, id, embedding) for each query of ``asked`` (deal, query_id,
    embedding) among the rows it shares a deal with: query_id, id, ``exact``, ``rank``.

    ``allowed(rows, queries)`` takes the two sides of a product as Arrow tables and returns which
    pairs count (queries x rows), or None for all.  Of a query in several deals the hits are
    put together; deals of one query must not share rows.  Vectors whose length differs from
    the query's, and vectors that are null or hold nulls, match nothing.  Ids are unique."""
    left, right = dealt_blocks(rows, asked, F.xxhash64("id"), F.xxhash64("query_id"), block_rows, block_queries)
    return block_topk(left, right, k, exclude_self, allowed)


def block_topk(left, right, k, exclude_self=False, allowed=None):
    """The same for sides that are dealt to blocks already (with ``deal``, ``block``, ``qblock``)."""
    from pyspark.sql.pandas.types import to_arrow_type

    query_type, id_type = right.schema["query_id"].dataType, left.schema["id"].dataType
    types = [to_arrow_type(query_type), to_arrow_type(id_type), pa.float64()]

    # Names of their own: both sides may come from one table.
    right = right.select(*(F.col(c).alias(f"q_{c}") for c in right.columns))

    def run(left, right):
        right = right.rename_columns([c.removeprefix("q_") for c in right.column_names])
        out = [pa.table([pa.array([], t) for t in types], ["query_id", "id", "exact"])]
        q_sizes = np.asarray(right["embedding"].combine_chunks().value_lengths().fill_null(0))
        for width in set(q_sizes[q_sizes > 0].tolist()):
            q_at, q = matrix(right["embedding"], width)
            v_at, v = matrix(left["embedding"], width)
            if not len(q_at) or not len(v_at):
                continue
            rows = left.take(pa.array(v_at))
            ids = rows["id"].to_pylist()
            keys, place = np.array(ids), {}
            if exclude_self:
                for n, i in enumerate(ids):
                    place.setdefault(i, []).append(n)
            for a in range(0, len(q), SLICE):
                asked = right.take(pa.array(q_at[a : a + SLICE]))
                ok = None if allowed is None else allowed(rows, asked)
                if exclude_self:
                    ok = np.ones((len(asked), len(ids)), bool) if ok is None else ok
                    for n, name in enumerate(asked["query_id"].to_pylist()):
                        ok[n, place.get(name, [])] = False
                which, at, exact = best_of(q[a : a + SLICE], v, keys, k, ok)
                names, found = asked["query_id"].take(pa.array(which)), rows["id"].take(pa.array(at))
                out.append(pa.table([names.cast(types[0]), found.cast(types[1]), pa.array(exact)], ["query_id", "id", "exact"]))
        return pa.concat_tables(out).combine_chunks()

    keys = ("deal", "block", "qblock")
    schema = f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, exact double"
    hits = left.groupBy(*keys).cogroup(right.groupBy(*(f"q_{k}" for k in keys))).applyInArrow(run, schema)
    return top_k(hits, k, "query_id", F.desc("exact"), F.col("id"))
