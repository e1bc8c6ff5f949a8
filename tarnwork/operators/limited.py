"""Search under limits of each query: an interval of dates and equal fields.

Chunks have ``role``, ``publish_date``, ``issuing_authority`` and ``category``; queries the
nullable columns ``date_from``, ``date_to``, ``issuing_authority`` and ``category``.  Null or
empty limits are ignored, null fields never match, dates compare as strings.

Both sides are dealt by what a query gives: by its authority, else its category, and by month
where it has dates.  A chunk takes one key for each kind of query there is (at most six), so it
meets each query it may match once, by an equi-join, and the exact test is made on those pairs
alone."""

import numpy as np
from pyspark.sql import functions as F

from .nearest import grouped_topk

LIMITS = ("date_from", "date_to", "issuing_authority", "category")
FIELDS = ("publish_date", "issuing_authority", "category")
ODD = -1  # in place of a month, for dates that do not begin like one


def _month(c):
    """A number that does not fall as the date grows; null where it does not begin as YYYY-MM."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}"), F.left(c, F.lit(4)).cast("int") * 13 + F.least(F.substr(c, F.lit(6), F.lit(2)).cast("int"), F.lit(12)))


def _given(name):
    return F.coalesce(F.col(name), F.lit("")) != ""


def dealt(chunks, queries):
    """``chunks`` (children only) and ``queries`` with a row for each ``deal`` they take."""
    dated = _given("date_from") | _given("date_to")
    by = F.when(_given("issuing_authority"), "a").when(_given("category"), "c").otherwise("n")
    asked = queries.withColumns({"_by": by, "_dated": dated})
    kinds = asked.select("_by", "_dated").distinct().collect()  # at most six
    children = chunks.filter("role = 'child'")
    month = _month(F.col("publish_date"))
    first, last, odd = children.agg(F.min(month), F.max(month), F.count_if(F.col("publish_date").isNotNull() & month.isNull())).first()

    value = {"a": F.col("issuing_authority"), "c": F.col("category"), "n": F.lit("")}
    part = F.coalesce(month, F.lit(ODD)).cast("string")
    key = lambda r: F.concat(F.lit(r["_by"]), F.when(F.col("publish_date").isNotNull(), part) if r["_dated"] else F.lit(""), F.lit("|"), value[r["_by"]])
    keys = F.array_compact(F.array(*map(key, kinds))) if kinds else F.array().cast("array<string>")
    left = children.withColumn("deal", F.explode(keys))

    low = F.greatest(F.coalesce(F.when(_given("date_from"), _month(F.col("date_from"))), F.lit(first)), F.lit(first))
    high = F.least(F.coalesce(F.when(_given("date_to"), _month(F.col("date_to"))), F.lit(last)), F.lit(last))
    months = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>")) if first is not None else F.array().cast("array<int>")
    if odd:
        months = F.concat(months, F.array(F.lit(ODD)))
    own = F.when(F.col("_by") == "a", F.col("issuing_authority")).when(F.col("_by") == "c", F.col("category")).otherwise(F.lit(""))
    named = lambda m: F.concat(F.col("_by"), m, F.lit("|"), own)
    deals = F.when(F.col("_dated"), F.transform(months, lambda m: named(m.cast("string")))).otherwise(F.array(named(F.lit(""))))
    right = asked.withColumn("deal", F.explode(deals)).drop("_by", "_dated")
    return left, right


def matching(chunks, queries, id_col="id"):
    """The pairs (``query_id``, id) that the limits admit."""
    left, right = dealt(chunks.select(F.col(id_col).alias("id"), "role", *FIELDS), queries.select("query_id", *LIMITS))
    pairs = left.alias("c").join(right.alias("q"), F.col("c.deal") == F.col("q.deal"))
    return pairs.filter(admitted("c", "q")).select("q.query_id", F.col("c.id").alias(id_col))


def admitted(chunk="c", asked="q"):
    """The exact test of a pair, as a predicate over two aliases."""
    c, q = (lambda name, side=side: F.col(f"{side}.{name}") for side in (chunk, asked))
    free = lambda name: F.coalesce(q(name), F.lit("")) == ""
    pairs = [("date_from", c("publish_date") >= q("date_from")), ("date_to", c("publish_date") <= q("date_to"))]
    pairs += [(name, c(name) == q(name)) for name in ("issuing_authority", "category")]
    out = c("role") == "child"
    for name, met in pairs:
        out &= free(name) | F.coalesce(met, F.lit(False))
    return out


def _ranked(own, *asked):
    """The strings of a chunk column and of query columns as integers in their common order;
    null, and '' of a query, are -1."""
    values = [own.to_pylist()] + [[x or None for x in c.to_pylist()] for c in asked]
    flat = [x for v in values for x in v]
    known = np.array([x is not None for x in flat], bool)
    ranks = np.full(len(flat), -1)
    if known.any():
        ranks[known] = np.unique(np.array([x for x in flat if x is not None], object), return_inverse=True)[1].ravel()
    return np.split(ranks, np.cumsum([len(v) for v in values])[:-1])


def within(rows, queries):
    """The same test for two Arrow tables, as a matrix of queries by rows."""
    date, low, high = _ranked(rows["publish_date"], queries["date_from"], queries["date_to"])
    ok = (low[:, None] < 0) | ((date >= low[:, None]) & (date >= 0))
    ok &= (high[:, None] < 0) | ((date <= high[:, None]) & (date >= 0))
    for name in ("issuing_authority", "category"):
        own, asked = _ranked(rows[name], queries[name])
        ok &= (asked[:, None] < 0) | (own == asked[:, None])
    return ok


def limited_topk(chunks, queries, k=20, exclude_self=False):
    """Top ``k`` of the chunks (id, embedding) that each query's limits admit, by cosine of unit
    vectors: query_id, id, ``score`` (to 4 digits), ``rank``; ties by id."""
    left, right = dealt(chunks.select("id", "embedding", "role", *FIELDS), queries.select("query_id", "embedding", *LIMITS))
    hits = grouped_topk(left, right, k, exclude_self, within)
    return hits.select("query_id", "id", F.round("exact", 4).alias("score"), "rank")
