"""Hit rate, reciprocal rank, reports, sweeps and judge scores."""

from functools import reduce

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..folders import stage
from ..functions.metadata import unfenced


def normalize_source(c):
    """Without extension, quotes unified, wide blanks plain, ends stripped."""
    bare = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\.[^.\\/]*$", "")
    return F.trim(F.translate(bare, "“”「」‘’　", "\"\"\"\"'' "))


def dedup_sources(hits):
    """First rank of each source of a query, ranked anew."""
    first = hits.groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "source")))


def score_queries(queries, expected, ranked, k):
    """``recall`` (1 where an expected source is among the first ``k``, or none is expected) and ``rr``
    (1 over the rank of the first match in the whole list)."""
    hit = ranked.join(expected, ["query_id", "source"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    wanted = expected.select("query_id").distinct().withColumn("wanted", F.lit(True))
    joined = queries.join(wanted, "query_id", "left").join(hit, "query_id", "left")
    free = F.col("wanted").isNull()
    return joined.withColumn("recall", F.when(free | (F.col("first") <= k), 1.0).otherwise(0.0)).withColumn("rr", F.when(free, 1.0).otherwise(F.coalesce(1 / F.col("first"), F.lit(0.0)))).drop("first", "wanted")


def evaluate_retrieval(scored, other="其他"):
    """Means and totals, overall (category null) and by category."""
    named = scored.withColumn("category", F.coalesce("category", F.lit(other)))
    return (
        named.groupingSets([[], [F.col("category")]], "category")
        .agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.grouping("category").alias("g"))
        .select(F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.col("category")).alias("category"), "total", "recall", "mrr")
    )


def compare_modes(expected, hits, k, repeats=()):
    """Means and totals of several searches (``mode``) over the queries of ``expected``.  ``hits``:
    mode, query_id, source, rank; repeats of a source count once, but in the modes that
    ``repeats`` names each takes a rank."""
    dealt = hits.repartition("mode", "query_id", "source")  # see rrf_merge on unions
    first = dealt.groupBy("mode", "query_id", "source").agg(F.min("rank").alias("rank"))
    once = F.row_number().over(Window.partitionBy("mode", "query_id").orderBy("rank", "source"))
    ranked = first.withColumn("rank", F.when(F.col("mode").isin(*repeats), F.col("rank")).otherwise(once) if repeats else once)
    best = ranked.join(expected, ["query_id", "source"]).groupBy("mode", "query_id").agg(F.min("rank").alias("first"))
    every = expected.select("query_id").distinct().crossJoin(F.broadcast(hits.select("mode").distinct()))
    scored = every.join(best, ["mode", "query_id"], "left").withColumn("recall", F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0)))
    return scored.groupBy("mode").agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def param_sweep(legs, expected, values, top):
    """Hit rate and mean reciprocal rank for each k of the fusion.  The legs (query_id, leg, source,
    rank) are computed once; queries with nothing expected are left out."""
    asked = legs.join(expected.select("query_id").distinct(), "query_id", "left_semi")
    params = F.explode(F.array(*(F.lit(float(v)) for v in values)))
    fused = asked.withColumn("value", params).groupBy("value", "query_id", "source").agg(F.round(F.sum(1 / (F.col("value") + F.col("rank"))), 9).alias("s"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("value", "query_id").orderBy(F.desc("s"), "source")))
    hit = ranked.filter(F.col("rank") <= top).join(expected, ["query_id", "source"]).groupBy("value", "query_id").agg(F.min("rank").alias("first"))
    every = expected.select("query_id").distinct().withColumn("value", params)
    joined = every.join(hit, ["value", "query_id"], "left")
    return joined.groupBy("value").agg(F.round(F.avg(F.col("first").isNotNull().cast("double")), 6).alias("recall_at_k"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count_if(F.col("first").isNull()).alias("failures"))


def cut_sweep(ranked, expected, values):
    """Hit rate and mean reciprocal rank for each number of results ``top_k``.  ``ranked``: query_id,
    source, rank.  Queries with nothing expected are left out."""
    first = ranked.join(expected, ["query_id", "source"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    every = expected.select("query_id").distinct().join(first, "query_id", "left")
    rows = every.withColumn("value", F.explode(F.array(*(F.lit(int(v)) for v in values)))).withColumn("first", F.when(F.col("first") <= F.col("value"), F.col("first")))
    return rows.groupBy("value").agg(*_sweep_row())


def rerank_sweep(plain, reranked, expected, top):
    """The same with and without the reranker (``value``), at ``top`` results of either ranking."""
    sides = [cut_sweep(r, expected, [top]).withColumn("value", F.lit(v)) for v, r in ((False, plain), (True, reranked))]
    return sides[0].unionByName(sides[1])


def _sweep_row():
    miss = F.col("first").isNull()
    return F.round(F.avg((~miss).cast("double")), 6).alias("recall_at_k"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count_if(miss).alias("failures")


def best_param(sweep, order="value"):
    """The row of the highest hit rate; the first by ``order`` of equals."""
    return sweep.orderBy(F.desc("recall_at_k"), order).limit(1)


def retrieval_failures(scored, expected, ranked, k):
    """Queries with something expected and nothing of it found: with the expected sources and the first
    ``k`` retrieved ones in rank order."""
    missed = scored.filter("recall = 0").select("query_id")
    wanted = expected.groupBy("query_id").agg(F.array_sort(F.collect_set("source")).alias("expected"))
    got = ranked.filter(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("retrieved"))
    return missed.join(wanted, "query_id").join(got, "query_id", "left").select("query_id", "expected", F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"))


ITEM_CHARS = 1 << 20  # of the items that one automaton holds


def containing(docs, items, text_col="text", item_col="item", item_chars=ITEM_CHARS):
    """Which documents hold which items (``query_id``, ``item``) as a substring: ``query_id`` and the
    columns of ``docs`` but the text.

    One scan of the texts finds all items of a block at once, with an automaton (Aho-Corasick)
    that the tasks build of them.  A block holds at most ``item_chars`` characters and is all
    that is broadcast; with several blocks each is a scan, staged before the next.  An empty item
    is in every text; null items and texts match nothing."""
    rest = [c for c in docs.columns if c != text_col]
    rows = items.select("query_id", F.col(item_col).alias("item")).filter(F.col("item").isNotNull()).toLocalIterator()
    parts, block, size, kind = [], [], 0, items.schema["query_id"].dataType
    for row in rows:
        if block and size + len(row["item"]) > item_chars:
            parts.append(stage(_holding(docs, block, kind, rest, text_col), "holding"))
            block, size = [], 0
        block.append((row["query_id"], row["item"]))
        size += len(row["item"])
    last = _holding(docs, block, kind, rest, text_col)
    return reduce(lambda a, b: a.unionByName(b), [*parts, last])


def _holding(docs, block, kind, rest, text_col):
    from pyspark.sql.pandas.types import to_arrow_type

    names, lists = {}, pa.list_(to_arrow_type(kind))
    for query, item in block:
        names.setdefault(item, []).append(query)
    shared = docs.sparkSession.sparkContext.broadcast(names)
    made = []

    @F.arrow_udf(ArrayType(kind))
    def found(texts: pa.Array) -> pa.Array:
        import ahocorasick

        if not made:
            automaton = ahocorasick.Automaton()
            for item, queries in shared.value.items():
                if item:
                    automaton.add_word(item, tuple(queries))
            automaton.make_automaton()
            made.append(automaton if len(automaton) else None)
        always = shared.value.get("", [])
        out = []
        for text in texts.to_pylist():
            hits = {q for _, queries in made[0].iter(text) for q in queries} if text and made[0] else set()
            out.append([*always, *hits] if text is not None else [])
        return pa.array(out, lists)

    return docs.select(F.explode(found(F.col(text_col))).alias("query_id"), *rest)


DIMENSIONS = ["faithfulness", "relevance", "completeness", "correctness"]


def judge_reply(reply):
    """Scores of a reply and its reason; zeros and a note on bad JSON."""
    parsed = F.from_json(unfenced(reply), ", ".join(f"{d} int" for d in DIMENSIONS) + ", reason string")
    bad = F.coalesce(*(parsed[d] for d in DIMENSIONS)).isNull()
    return [F.coalesce(parsed[d], F.lit(0)).alias(d) for d in DIMENSIONS] + [F.when(bad, F.concat(F.lit("JSON 解析失败: "), F.left(F.col(reply), F.lit(200)))).otherwise(parsed["reason"]).alias("reason")]


def judge_summary(scores):
    means = [F.round(F.avg(F.coalesce(d, F.lit(0))), 6).alias(d) for d in DIMENSIONS]
    out = scores.groupingSets([[], [F.col("category")]], "category").agg(*means, F.grouping("category").alias("g"))
    return out.select(F.when(F.col("g") == 1, F.lit("overall")).otherwise(F.col("category")).alias("category"), *DIMENSIONS)


def judge_input(contexts, most=2000, empty="（无检索结果）"):
    """Contexts (query_id, rank, text; text null for none) as one text each."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("rank", "text")))), lambda x: x["text"]), "\n---\n")
    return contexts.groupBy("query_id").agg(F.when(F.count("text") == 0, F.lit(empty)).otherwise(F.left(body, F.lit(most))).alias("context"))
