"""A stored inverted-list index for cosine search over unit vectors.

Centroids are fitted on a bounded sample (SAMPLE rows, those of the least hash of their id);
every row is indexed.  A row goes to the list of its nearest centroid, and the table is
partitioned by list, so that a search reads the lists its queries probe and no others.  How
many lists a query probes follows from ``recall``: the least number that finds that share of
the nearest rows of sampled queries among the sample.  A search therefore is approximate; what
it returns are true scores.

Queries are rows.  Lists of near centroids are put together in packs of at most ROWS rows, and a
query is dealt once to each pack that has a list it probes, so that queries and hits are
multiplied by packs and not by probes; inside a pack only the rows of probed lists count.  A
list beyond ROWS is a pack of its own and is cut into blocks (``nearest``).  Vectors that are
null, hold nulls or have another length than the sample's first vector are not indexed, as they
match nothing; queries of such kinds get no hits.  An empty table gives an index without lists.
Ids may have any type and are unique."""

import json
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..folders import stage
from .nearest import ROWS, grouped_topk, matrix

SAMPLE = 65_536
MOST_LISTS = 4096
FILE_ROWS = 1_000_000
ROUNDS, TRIALS, NEIGHBOURS = 10, 256, 20
QUERIES = 4096  # in a block that meets a pack
PACKS, LEAST_ROWS = 32, 1024  # so many packs, for as many tasks, unless they had fewer rows than that


def fit_centroids(sample, lists, rounds=ROUNDS):
    """Unit centroids of a sample of unit vectors: rounds of assigning and averaging, from
    rows evenly spaced in the sample.  A centroid that nothing is nearest to stays."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(sample[a : a + 4096] @ centroids.T).argmax(1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def probes_for(sample, centroids, recall, trials=TRIALS, neighbours=NEIGHBOURS):
    """The least number of lists whose rows hold the share ``recall`` of the nearest
    ``neighbours`` of ``trials`` sampled queries (each without itself)."""
    if len(sample) < 2:
        return 1
    asked = np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int)
    k, near = min(neighbours, len(sample) - 1), []
    for a in range(0, len(asked), 32):
        scores = sample[asked[a : a + 32]] @ sample.T
        scores[np.arange(len(scores)), asked[a : a + 32]] = -np.inf
        near.append(np.argpartition(-scores, k - 1, axis=1)[:, :k])
    near = np.concatenate(near)
    own = np.concatenate([(sample[a : a + 4096] @ centroids.T).argmax(1) for a in range(0, len(sample), 4096)])
    order = np.argsort(-(sample[asked] @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), 1)
    needed = np.sort(np.take_along_axis(place, own[near], 1).ravel()) + 1
    return int(needed[min(len(needed) - 1, ceil(recall * len(needed)) - 1)])


def picked(rows, sample, n):
    """The vectors of ``rows`` (``n`` of them) with the ``sample`` least hashes of their id, in that
    order and in one partition.  Hashes are spread evenly, so only those below a bound go to it."""
    full = rows.filter(F.size("embedding") > 0)
    if n > 4 * sample:
        low = full.filter(F.xxhash64("id") < int(2 * sample / n * 2**64) - 2**63)
        full = low if low.count() >= sample else full
    return full.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").coalesce(1)


def fitter(most, recall):
    """The fitting of at most ``most`` lists, as a step of the one task that has the sample (at
    most SAMPLE rows): a row a centroid, each with the number of probes."""

    def run(batches):
        lists = [b.column(0) for b in batches]
        _, sample = matrix(pa.chunked_array(lists)) if lists else (None, np.zeros((0, 1)))
        if len(sample):
            centroids = fit_centroids(sample, min(most, len(sample)))
            probes = probes_for(sample, centroids, recall)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(centroids)), pa.int32()), pa.array(centroids.tolist(), pa.list_(pa.float64())), pa.array([probes] * len(centroids), pa.int32())], ["list", "centroid", "probes"])

    return run


def _read(fitted):
    """(probes, centroids) of a table of centroids; at most MOST_LISTS rows."""
    found = sorted((r.asDict() for r in fitted.collect()), key=lambda r: r["list"])
    centroids = np.array([r["centroid"] for r in found]) if found else np.zeros((0, 1))
    return found[0].get("probes", 0) if found else 0, centroids


def _listed(rows, centroids, count, out):
    """``rows`` with the ``count`` nearest lists of each vector (array<int>) as ``out``; empty
    for vectors that match nothing."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_LISTS rows
    place, schema = rows.columns.index("embedding"), StructType([*rows.schema.fields, StructField(out, ArrayType(IntegerType()))])

    def run(batches):
        c = shared.value
        for batch in batches:
            lists = [[]] * batch.num_rows
            at, vectors = matrix(batch.column(place), c.shape[1])
            n = min(count, len(c))
            for a in range(0, len(at), 2048):
                order = np.argsort(-(vectors[a : a + 2048] @ c.T), axis=1, kind="stable")[:, :n] if n > 1 else (vectors[a : a + 2048] @ c.T).argmax(1)[:, None]
                for i, found in zip(at[a : a + 2048].tolist(), order.tolist()):
                    lists[i] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int32()))], [*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def packed(sizes, centroids, rows=ROWS):
    """The number of the pack of each list, -1 for lists without rows.  ``sizes``: list to rows."""
    total = sum(sizes.values())
    rows = min(rows, max(LEAST_ROWS, -(-total // PACKS)))
    coarse = fit_centroids(centroids, min(len(centroids), -(-total // rows))) if total else centroids
    near, packs, pack, held = (centroids @ coarse.T).argmax(1), [-1] * len(centroids), -1, 0
    for n in sorted(sizes, key=lambda n: (near[n], n)):
        if pack < 0 or held + sizes[n] > rows:
            pack, held = pack + 1, 0
        packs[n], held = pack, held + sizes[n]
    return packs


def probed(rows, asked):
    """Which rows (with ``list``) are in a list that a query (``lists``) probes, as a matrix of
    queries by rows, for two Arrow tables."""
    known, own = np.unique(np.asarray(rows["list"]), return_inverse=True)
    lists = asked["lists"].combine_chunks()
    query, wanted = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths())), np.asarray(lists.flatten())
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    met = np.zeros((len(lists), len(known)), bool)
    here = known[at] == wanted
    met[query[here], at[here]] = True
    return None if met.all() else met[:, own]


class VectorIndex:
    """A written index; ``search`` gives the hits of a table of queries."""

    def __init__(self, spark, path, centroids, probes):
        self.spark, self.path, self.centroids, self.probes = spark, path, centroids, probes

    @classmethod
    def build(cls, vectors, path, id_col="id", vector_col="embedding", lists=None, recall=0.95, sample=SAMPLE):
        """Writes the index of ``vectors`` below ``path`` and returns it."""
        spark = vectors.sparkSession
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("embedding"))
        n = rows.count()
        most = min(lists or max(1, round(sqrt(n))), MOST_LISTS)
        fitted = stage(picked(rows, sample, n).mapInArrow(fitter(most, recall), "list int, centroid array<double>, probes int"), "fitted-lists")
        probes, centroids = _read(fitted)
        listed = _listed(rows, centroids, 1, "lists").filter(F.size("lists") > 0).select("id", "embedding", F.col("lists")[0].alias("list"))
        dealt = stage(listed, "listed-vectors")
        sizes = dealt.groupBy("list").agg(F.ceil(F.count("*") / F.lit(FILE_ROWS)).cast("int").alias("files"))
        parts = dealt.join(F.broadcast(sizes), "list").withColumn("file", F.pmod(F.xxhash64("id"), F.col("files")))  # a row a list
        parts.repartition("list", "file").drop("file", "files").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
        about = {"probes": probes, "width": int(centroids.shape[1]), "id": dealt.schema["id"].dataType.jsonValue()}
        fitted.select("list", "centroid").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        return cls(spark, path, centroids, probes)

    @classmethod
    def load(cls, spark, path):
        about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
        return cls(spark, path, _read(spark.read.parquet(f"{path}/centroids"))[1], about["probes"])

    def lists_read(self, queries):
        """The lists that these queries (with ``lists``) probe; at most MOST_LISTS."""
        return sorted(r[0] for r in queries.select(F.explode("lists")).distinct().collect())

    def search(self, queries, k=20, query_id="query_id", vector_col="embedding", probes=None, exclude_self=False):
        """Top ``k`` of each query: query id, ``id``, ``score`` (to 4 digits), ``rank``; ties by id."""
        asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
        asked = stage(_listed(asked, self.centroids, probes or self.probes, "lists"), "probing-queries")
        wanted = self.lists_read(asked)
        rows = self.spark.read.parquet(f"{self.path}/vectors") if wanted else None
        if rows is None:
            return asked.filter("false").select(F.col("query_id").alias(query_id), F.lit(None).cast("bigint").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        rows = rows.filter(F.col("list").isin(wanted))
        sizes = {r["list"]: r["count"] for r in rows.groupBy("list").count().collect()}  # at most MOST_LISTS
        packs = F.lit(packed(sizes, self.centroids))
        asked = asked.withColumn("deal", F.explode(F.array_distinct(F.transform("lists", lambda n: packs[n]))))
        asked = asked.withColumn("lists", F.filter("lists", lambda n: packs[n] == F.col("deal")))
        hits = grouped_topk(rows.withColumn("deal", packs[F.col("list")]), asked, k, exclude_self, probed, block_queries=QUERIES)
        return hits.select(F.col("query_id").alias(query_id), "id", F.round("exact", 4).alias("score"), "rank")


def recall_at(found, exact, k):
    """One row: the share of the exact hits (query_id, id, rank up to ``k``) that ``found`` has."""
    wanted = exact.filter(F.col("rank") <= k).select("query_id", "id")
    hit = wanted.join(found.filter(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count("*").alias("wanted"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))
