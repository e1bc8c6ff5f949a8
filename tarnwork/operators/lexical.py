"""BM25 over a document-partitioned index: tokens, posting blocks, weighted keywords, search.

The index is dealt by documents, not by terms.  A task reads its chunks once and writes
*shards* of at most SHARD_CHUNKS chunks (or SHARD_POSTINGS postings): one row with the chunks' ids
and lengths (its term is null), then for each term, in order of terms, blocks of at most BLOCK
postings: the chunks' numbers in the shard, the term's counts, and the greatest count and the
least length among them, which bound what the block can add to a score.  Only the document
frequencies are summed up over all shards.

A search sends each block of queries to the shards that have its terms.  There the terms of a
query are taken from the highest bound down; once the ``k``-th best sum exceeds what the terms
left can add, only chunks that can still reach it are looked at, and blocks without such a chunk
are skipped.  Each shard gives the best ``k`` of each query, and these are ranked.  Results are
exact.  Ids are unique; chunks without tokens count in the averages."""

from collections import Counter
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..folders import stage
from .segment import HAN_WORDS, shared, tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
BLOCK = 512
SHARD_CHUNKS, SHARD_POSTINGS = 4096, 1_000_000
QUERY_BLOCK = 512
ROW_GROUP = 8 << 20  # bytes; terms are in order inside a shard, so few row groups hold a term
FEW_TERMS = 200


def tokenize(c, han_words=HAN_WORDS):
    """Runs of letters and digits of two characters or more, numbers left out; case kept.

    Han characters: the longest word of ``han_words`` at each place; between such words,
    every two neighbours.  Another dictionary takes the place of this one by the parameter.
    Texts without Han characters, the common case, take one plain pattern."""
    text = F.col(c) if isinstance(c, str) else c
    known = "|".join(sorted(han_words, key=lambda w: (-len(w), w))) or "(?!)"
    pattern = rf"(?:{known})|(?:(?!{known})\p{{IsHan}})+|(?:(?!\p{{IsHan}})[\p{{L}}\p{{N}}])+"
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cut = F.transform(runs, lambda r: F.when(r.rlike(rf"^(?!(?:{known})$)\p{{IsHan}}{{3,}}$"), F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array(r)))
    plain = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))
    # No Han character stands before U+2E80, and a range is tested much faster than a script.
    words = F.when(text.rlike("[\u2e80-\U0003ffff]"), F.filter(F.flatten(cut), lambda t: F.length(t) >= 2)).otherwise(plain)
    # A token of digits alone is a number; most tokens are told apart by their first character.
    return F.filter(words, lambda t: (F.left(t, F.lit(1)) > "9") | (F.left(t, F.lit(1)) < "0") | ~t.rlike(r"^\d+$"))


class Shard:
    """The chunks that one shard takes, in the order they come."""

    def __init__(self):
        self.ids, self.lengths, self.sizes = [], [], []
        self.codes, self.counts, self.of = [], [], {}

    def add(self, chunk_id, counts):
        of = self.of
        for term in counts:
            if term not in of:
                of[term] = len(of)
        self.codes.extend(map(of.__getitem__, counts))
        self.counts.extend(counts.values())
        self.sizes.append(len(counts))
        self.ids.append(chunk_id)
        self.lengths.append(sum(counts.values()))

    def full(self):
        return len(self.ids) >= SHARD_CHUNKS or len(self.codes) >= SHARD_POSTINGS

    def blocks(self, shard, id_type):
        """The posting blocks as a record batch."""
        terms = sorted(self.of)
        rank = np.empty(len(terms), np.int64)
        rank[[self.of[t] for t in terms]] = np.arange(len(terms))
        rank = rank[np.array(self.codes, np.int64)]
        doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        order = np.argsort(rank, kind="stable")
        rank, doc, tf = rank[order], doc[order], np.array(self.counts, np.int64)[order]
        lengths = np.array(self.lengths, np.int64)
        first = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))  # of each term
        inside = np.arange(len(rank)) - np.repeat(first, np.diff([*first, len(rank)]))
        starts = np.flatnonzero(inside % BLOCK == 0)
        size, n = np.diff([*starts, len(rank)]), len(self.ids)
        ends = np.concatenate([starts, [len(rank)]])
        own = lambda value, each: pa.array(np.concatenate([[value], each]))
        lists = lambda own, each: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], len(own) + ends]), pa.int32()), pa.array(np.concatenate([own, each]), pa.int32()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(starts) + 1, shard)), pa.array([None, *(terms[r] for r in rank[starts])], pa.string()), own(n, size), own(0, np.add.reduceat(tf, starts)),
                own(0, np.maximum.reduceat(tf, starts)), own(0, np.minimum.reduceat(lengths[doc], starts)),
                lists(np.zeros(0, np.int64), doc), lists(lengths, tf), pa.array([self.ids, *[None] * len(starts)], pa.list_(id_type)),
            ],
            BLOCK_COLUMNS,
        )


BLOCK_COLUMNS = ["shard", "term", "n", "total", "most", "shortest", "docs", "tf", "ids"]


def _counted(chunks, id_col, text_col, keywords):
    """Columns id, text and, with ``keywords``, ``extra``: the terms and weights to add."""
    rows = chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if keywords is None:
        return rows
    each = keywords.select(F.col(id_col).alias("id"), F.explode("keywords").alias("term", "weight")).groupBy("id", "term").agg(F.sum("weight").cast("bigint").alias("weight"))
    return rows.join(each.groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("extra")), "id", "left")


def _term_counts(batches, cut):
    """(id, term -> count) of each chunk of Arrow batches that ``_counted`` made."""
    for batch in batches:
        extra = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for chunk_id, text, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), extra):
            counts = Counter(cut(text))
            for e in more or ():
                counts[e["term"]] += e["weight"]
            if counts:
                yield chunk_id, counts


def shard_blocks(chunks, id_col="id", text_col="text", keywords=None, words=None, additions=HAN_WORDS):
    """The shards of ``chunks``, without any shuffle of theirs; see the module."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = chunks.schema[id_col].dataType
    id_type, fixed = to_arrow_type(kind), tuple(sorted((words or {}).items()))

    def run(batches):
        from pyspark import TaskContext

        shard, number = Shard(), TaskContext.get().partitionId() << 32
        for chunk_id, counts in _term_counts(batches, shared(fixed, tuple(additions)).tokens):
            shard.add(chunk_id, counts)
            if shard.full():
                yield shard.blocks(number, id_type)
                shard, number = Shard(), number + 1
        if shard.ids:
            yield shard.blocks(number, id_type)

    schema = f"shard bigint, term string, n bigint, total bigint, most bigint, shortest bigint, docs array<int>, tf array<int>, ids array<{kind.simpleString()}>"
    return _counted(chunks, id_col, text_col, keywords).mapInArrow(run, schema)


def postings(chunks, id_col="id", text_col="text", keywords=None, words=None, additions=HAN_WORDS):
    """``term``, id, ``tf``; ``keywords`` (id, map of word to weight) add their weights.  Tokens are
    counted inside the row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = chunks.schema[id_col].dataType
    id_type, fixed = to_arrow_type(kind), tuple(sorted((words or {}).items()))

    def run(batches):
        for chunk_id, counts in _term_counts(batches, shared(fixed, tuple(additions)).tokens):
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([chunk_id] * len(counts), id_type), pa.array(list(counts.values()), pa.int64())], ["term", id_col, "tf"])

    return _counted(chunks, id_col, text_col, keywords).mapInArrow(run, f"term string, {id_col} {kind.simpleString()}, tf bigint")


def build_index(chunks, id_col="id", text_col="text", keywords=None, path=None, words=None, additions=HAN_WORDS):
    """The index tables: ``blocks``, ``terms`` (df, idf), ``stats`` (one row) and ``words`` (the
    dictionary of Han words, empty without one), written below ``path`` or to the shared folder.

    Okapi idf, where terms in more than half of the chunks get EPSILON times the mean idf.
    ``words`` (word, n) as ``segment.learn_words`` gives it cuts Han runs in chunks and queries."""
    spark, index = chunks.sparkSession, {}

    def made(name, frame):
        if path is None:
            index[name] = stage(frame, f"index-{name}")
        else:
            frame.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/{name}")
            index[name] = spark.read.schema(frame.schema).parquet(f"{path}/{name}")
        return index[name]

    held = made("words", spark.createDataFrame([], "word string, n bigint") if words is None else words)
    blocks = made("blocks", shard_blocks(chunks, id_col, text_col, keywords, dictionary(held), additions))
    total = blocks.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()["total"]
    n = chunks.select(F.count(F.lit(1)).alias("n"))
    made("stats", n.select("n", (F.lit(float(total)) / F.nullif("n", F.lit(0))).alias("avgdl")))
    n = index["stats"].first()["n"]
    raw = blocks.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df")).select("term", "df", (F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean")).scalar()
    made("terms", raw.select("term", "df", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf")))
    return index


def dictionary(words):
    """A dictionary table as word -> count; its size is bounded where it is learnt."""
    return {r["word"]: r["n"] for r in words.collect()}


def asked_terms(index, queries, query_id="query_id", query_text="query", additions=HAN_WORDS):
    """``qblock``, ``term``, ``asked`` (staged): for each block of queries and term the queries that
    have it and their weights (times in the query, by idf); terms the index lacks are left out.
    A row without a term in each block meets the shards' own rows."""
    words = dictionary(index["words"]) if "words" in index else None
    rows = queries.select(F.col(query_id).alias("q"), F.explode(tokens(query_text, words, additions)).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("times"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    weighted = rows.join(index["terms"].select("term", "idf"), "term").select("q", "term", (F.col("times") * F.col("idf")).alias("w"))
    dealt = stage(weighted.groupBy(F.pmod(F.xxhash64("q"), F.lit(blocks)).alias("qblock"), "term").agg(F.collect_list(F.struct("q", "w")).alias("asked")), "asked-terms")
    return dealt.unionByName(dealt.select("qblock").distinct().withColumns({"term": F.lit(None).cast("string"), "asked": F.array().cast(dealt.schema["asked"].dataType)}))


def saturation(tf, dl, mean):
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def best_in_shard(rows, lengths, ids, k, mean):
    """(query, id, score) of the best ``k`` of each query in one shard.  ``rows``: for each block
    (term, bound for weight 1, chunk numbers, counts, [(query, weight)]); ``lengths`` and ``ids`` of
    the shard's chunks by number."""
    size = len(lengths)
    norm = K1 * (1 - B + B * lengths / mean)
    wanted, added = {}, [None] * len(rows)
    for at, row in enumerate(rows):
        for q, w in row[4]:
            wanted.setdefault(q, []).append((w, at))
    for q, parts in wanted.items():
        acc, terms = np.zeros(size), {}
        for w, at in parts:
            terms.setdefault(rows[at][0], []).append((w, at))
        bounds = sorted(((max(w * rows[at][1] for w, at in blocks), t) for t, blocks in terms.items()), key=lambda x: -x[0])
        left = sum(b for b, _ in bounds)
        prune = size > k and all(w >= 0 for w, _ in parts)
        for bound, term in bounds:
            floor = np.partition(acc, size - k)[size - k] if prune else -np.inf
            # Chunks that cannot reach the k-th best any more are passed over (with room for rounding).
            few = np.flatnonzero(acc >= floor - left - 2e-6) if floor > left + 2e-6 else None
            for w, at in terms[term]:
                docs, tf = rows[at][2], rows[at][3]
                if few is None:
                    if added[at] is None:
                        added[at] = tf * (K1 + 1) / (tf + norm[docs])
                    acc[docs] += w * added[at]
                    continue
                near = few[np.searchsorted(few, docs[0]) : np.searchsorted(few, docs[-1], "right")]
                if len(near):
                    pos = np.searchsorted(docs, near)
                    met = docs[pos] == near
                    near, tf = near[met], tf[pos[met]]
                    acc[near] += w * (tf * (K1 + 1) / (tf + norm[near]))
            left -= bound
        score = np.round(acc, 6)
        at = np.flatnonzero(score > 0)
        if len(at) > k:
            at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
        for s, i in sorted(zip((-score[at]).tolist(), (ids[x] for x in at.tolist())))[:k]:
            yield q, i, -s


def tabled(found, types, names, rows=20_000):
    """An Arrow table of an iterator of tuples, of which ``rows`` are held as objects at a time."""
    parts = (pa.table([pa.array(c, t) for c, t in zip(zip(*part), types)], names) for part in batched(found, rows))
    return pa.concat_tables([pa.table([pa.array([], t) for t in types], names), *parts])


def scored(index, queries, k=2**31 - 1, id_col="id", query_id="query_id", query_text="query", additions=HAN_WORDS):
    """The best ``k`` chunks of each query in each shard: query, id, ``score``."""
    from pyspark.sql.pandas.types import to_arrow_type

    mean = index["stats"].first()["avgdl"]
    asked = asked_terms(index, queries, query_id, query_text, additions)
    blocks = index["blocks"]
    few = [r["term"] for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    if len(few) <= FEW_TERMS:  # only the row groups of these terms are read
        blocks = blocks.filter(F.col("term").isNull() | F.col("term").isin([t for t in few if t is not None]))
    hit = blocks.join(asked.withColumnRenamed("term", "asked_term"), F.col("term").eqNullSafe(F.col("asked_term")))
    query_kind, id_kind = queries.schema[query_id].dataType, blocks.schema["ids"].dataType.elementType
    types = [to_arrow_type(query_kind), to_arrow_type(id_kind), pa.float64()]

    def run(group):
        terms = group["term"].to_pylist()
        own = terms.index(None)
        tf = [x.values.to_numpy(zero_copy_only=False) for x in group["tf"]]
        docs = [x.values.to_numpy(zero_copy_only=False) for x in group["docs"]]
        bounds = saturation(group["most"].to_numpy(), group["shortest"].to_numpy(), mean).tolist()
        named = [[(a["q"], a["w"]) for a in x] for x in group["asked"].to_pylist()]
        rows = [r for r in zip(terms, bounds, docs, tf, named) if r[0] is not None]
        return tabled(best_in_shard(rows, tf[own], group["ids"][own].as_py(), k, mean), types, [query_id, id_col, "score"])

    dealt = hit.select("shard", "qblock", "term", "most", "shortest", "docs", "tf", "ids", "asked").groupBy("shard", "qblock")
    return dealt.applyInArrow(run, f"{query_id} {query_kind.simpleString()}, {id_col} {id_kind.simpleString()}, score double")


def bm25_search(index, queries, k=20, id_col="id", query_id="query_id", query_text="query", additions=HAN_WORDS, keep=None):
    """Top ``k`` chunks of each query with ``score`` and ``rank``; ties by id.  Repeated query
    tokens count each time.  ``keep`` takes all scored hits (query, id, score) and gives those
    that may be returned."""
    hits = scored(index, queries, k if keep is None else 2**31 - 1, id_col, query_id, query_text, additions)
    return top_k(hits if keep is None else keep(hits), k, query_id, F.desc("score"), F.col(id_col))


def top_k(hits, k, query_id, *order):
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*order))).filter(F.col("rank") <= k)
