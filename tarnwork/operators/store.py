"""The chunk table: ids, duplicates, lookups, documents."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..folders import stage


def chunk_id(*parts):
    """md5 of the parts joined by ``::``."""
    return F.md5(F.concat_ws("::", *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts)))


def dedup_ids(batch, order, id_col="id"):
    """The first row of each id by ``order``."""
    w = Window.partitionBy(id_col).orderBy(*order)
    return batch.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def new_chunks_only(batch, stored, id_col="id"):
    return batch.join(stored.select(id_col), id_col, "left_anti")


def get_by_ids(chunks, wanted, id_col="id"):
    return chunks.join(wanted.select(id_col), id_col, "left_semi")


PART_CHARS = 1 << 20


def document_detail(requested, chunks, missing="未找到文档", part_chars=PART_CHARS):
    """Texts of each requested source in chunk order, under its name: ``source``, ``part``, ``detail``.

    A document comes in parts of whole chunks of about ``part_chars`` characters, so that no row
    holds a source of any size; the parts' texts, joined by line feeds, are the document.  Chunks
    are numbered by ranges of (source, chunk), so that one large source is many tasks; chunks of
    one number are in one part, in order of their texts."""
    spark, size = chunks.sparkSession, F.coalesce(F.length("text") + 1, F.lit(0))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = chunks.groupBy("source", "chunk_index").agg(F.sum(size).alias("_size"))  # texts stay where they are
    dealt = stage(sizes.repartitionByRange(ranges, "source", "chunk_index").withColumn("_range", F.spark_partition_id()), "chunk-sizes")
    # A running sum in two steps: what the ranges before hold of the source, and inside the range.
    sums = dealt.groupBy("source", "_range").agg(F.sum("_size").alias("_held"))
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), F.col("_range").alias("_own"), F.coalesce(F.sum("_held").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", "source").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_own")))
    numbered = numbered.select(F.col("source").alias("_source"), F.col("chunk_index").alias("_index"), ((F.col("_before") + F.col("_inside")) / part_chars).cast("int").alias("part"))
    placed = chunks.select("source", "chunk_index", "text").join(numbered, F.col("source").eqNullSafe(F.col("_source")) & F.col("chunk_index").eqNullSafe(F.col("_index")))
    body = placed.groupBy("source", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n").alias("body"))
    head = F.when(F.col("part") == 0, F.concat(F.lit("文件："), F.col("source"), F.lit("\n"))).otherwise("")
    found = requested.join(body, "source", "left")
    return found.select("source", F.coalesce("part", F.lit(0)).alias("part"), F.when(F.col("body").isNull(), F.lit(missing)).otherwise(F.concat(head, F.col("body"))).alias("detail"))


def get_by_source(chunks, sources, source_col="source", order="chunk_index"):
    """All chunks of the named sources, in order."""
    return chunks.filter(F.col(source_col).isin(list(sources))).orderBy(source_col, order)
