"""Contiguous shards of near equal bytes, by prefix sums, in DataFrame operations only.

Rows are dealt into ranges of (id, checksum, row number) and staged, which fixes
the ranges.  The totals of the ranges (one row each) give every range its offset;
a running sum inside each range then gives each row its global byte position.
Shard borders lie at equal targets of the byte total, and a row goes to the shard
that holds its middle byte, so no shard is off its target by more than one row.

Null texts have no bytes (and the checksum of the empty text); a null id sorts
first; repeated rows are rows of their own; an empty table gives an empty result;
other columns are ignored.  Since the law is ``bytes``, ``grown_shard`` is null.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import partitions, stage


def shard_by_bytes(docs, n_shards, id_col="doc_id", text_col="text", overhead=16, ranges=None):
    """One row a document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("bigint").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["doc_id", "text_crc32", "row"]
    ranged = stage(rows.repartitionByRange(ranges or partitions(spark), *order).withColumn("part", F.spark_partition_id()), "shard-ranges")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    offsets = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("bytes").over(everything).alias("total"),
        )
    )  # one row a range
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("number", F.row_number().over(inside))
        .join(F.broadcast(offsets), "part")
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("rows_before") + F.col("number") - 1).alias("position"),
            F.expr(f"cast(((2 * (bytes_before + end) - size) * {int(n_shards)}) div (2 * total) as int)").alias("shard"),
        )
    )
    starts = placed.groupBy("shard").agg(F.min("position").alias("first"))  # n_shards rows at most
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("doc_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("position") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
