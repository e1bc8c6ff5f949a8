"""The answer cache as tables: lookup, expiry, eviction, invalidation, touch, upsert."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..folders import stage
from .vectors import vector_topk


def cache_key(embedding, dims=10):
    """md5 of the first dimensions, rounded to 6 digits."""
    return F.md5(F.array_join(F.transform(F.slice(F.col(embedding), 1, dims), lambda x: F.format_string("%.6f", x.cast("double"))), ","))


def cache_expire(cache, now, ttl_seconds=86400):
    return cache.filter(F.unix_timestamp(now) - F.unix_timestamp("ts") <= ttl_seconds)


SKETCH, MARGIN = 10_000, 0.001  # of the quantile sketch: its accuracy, and what is left on both sides


TAKE = 100_000  # entries that one task may sort


def cache_evict_lru(cache, max_size=1000, take=TAKE):
    """The ``max_size`` entries used last (``last_accessed``, a timestamp; null is oldest); ties by key.

    Up to ``take`` entries are taken by a sort with a limit, which each task keeps to.  Beyond
    that, the entry that is just kept is found first: a quantile sketch gives a narrow band of times
    that holds it, a count says how many are above the band, and only the band is dealt by
    ranges, counted, and sorted where the place lies.  Then one filter decides; no task sees
    more than its share, whatever ``max_size`` is."""
    if max_size <= take:
        return cache.orderBy(F.desc_nulls_last("last_accessed"), "key").limit(max(max_size, 0))
    n = cache.count()
    if n <= max_size or max_size <= 0:
        return cache if n <= max_size else cache.limit(0)
    used = F.coalesce(F.col("last_accessed").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    times = cache.select(used.alias("_t"), "key")
    share = 1 - max_size / n
    bounds = [max(0.0, share - MARGIN), min(1.0, share + MARGIN)]
    band = stage(times.agg(F.percentile_approx("_t", bounds, SKETCH).alias("b"), F.min("_t").alias("least"), F.max("_t").alias("most")), "lru-band")
    low, high = band.select(F.col("b")[0]).scalar(), band.select(F.col("b")[1]).scalar()
    above, within = times.agg(F.count_if(F.col("_t") > high), F.count_if((F.col("_t") <= high) & (F.col("_t") >= low))).first()
    if not above < max_size <= above + within:  # the sketch missed: the band is everything
        low, high, above = band.select("least").scalar(), band.select("most").scalar(), 0
    parts = int(cache.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = times.filter((F.col("_t") <= high) & (F.col("_t") >= low)).repartitionByRange(parts, F.desc("_t"), "key").withColumn("_range", F.spark_partition_id())
    dealt = stage(dealt, "lru-ranges")
    left, place = max_size - above, None
    for number, size in sorted((r["_range"], r["n"]) for r in dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a range
        if left <= size:
            place = number
            break
        left -= size
    last = stage(dealt.filter(F.col("_range") == place).orderBy(F.desc("_t"), "key").offset(left - 1).limit(1), "lru-last")
    at, key = last.select("_t").scalar(), last.select("key").scalar()
    return cache.filter((used > at) | ((used == at) & (F.col("key") <= key)))


def cache_upsert(cache, new):
    """New rows replace old ones of their key; the latest of several."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).repartition("key")  # see rrf_merge on unions
    w = Window.partitionBy("key").orderBy(F.desc("_new"), F.desc("ts"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def cache_touch(cache, hits):
    """``last_accessed`` moves to the time of the last hit (key, hit_ts)."""
    last = hits.groupBy("key").agg(F.max("hit_ts").alias("hit_ts"))
    return cache.join(last, "key", "left").withColumn("last_accessed", F.greatest("last_accessed", "hit_ts")).drop("hit_ts")


def cache_invalidate(cache, updated):
    """Entries none of whose sources were updated (``source``)."""
    gone = cache.select("key", F.explode("sources").alias("source")).join(updated.select("source"), "source", "left_semi").select("key").distinct()
    return cache.join(gone, "key", "left_anti")


def cache_lookup(cache, queries, now, ttl_seconds=86400, threshold=0.92):
    """For each query (query_id, embedding) the live entry of highest cosine, if that reaches
    ``threshold``: ``query_id``, ``key`` (null for a miss), ``score``.  Entries older than
    ``ttl_seconds`` at ``now`` (a column or literal) take no part."""
    live = cache_expire(cache, now, ttl_seconds)
    best = vector_topk(live.select("key", "embedding"), queries, 1, id_col="key")
    hit = best.filter((F.col("score") > 0) & (F.col("score") >= threshold)).select("query_id", "key", "score")
    return queries.select("query_id").join(hit, "query_id", "left")


def cache_invalidated(cache, updated):
    """How many entries ``cache_invalidate`` takes away: one row."""
    gone = cache.select("key", F.explode("sources").alias("source")).join(updated.select("source"), "source", "left_semi")
    return gone.agg(F.count_distinct("key").alias("invalidated"))
