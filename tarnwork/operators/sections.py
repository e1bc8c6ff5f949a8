"""Markdown sections and the level to split at."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import lines


def parse_sections(docs, id_col="source", text_col="markdown"):
    """Heading lines cut the text: ``section_no``, ``level``, ``heading``, ``content``.
    Text before the first heading has level 0."""
    cut = docs.select(id_col, F.posexplode(lines(text_col)).alias("pos", "line"))
    head = F.col("line").rlike(r"^#{1,6}\s+.+")
    numbered = cut.withColumn("section_no", F.sum(head.cast("int")).over(Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy(id_col, "section_no").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    top = F.col("l")[0]["line"]
    named = F.col("section_no") > 0
    return whole.select(
        id_col,
        F.col("section_no").cast("int").alias("section_no"),
        F.when(named, F.length(F.regexp_extract(top, "^(#+)", 1))).otherwise(0).alias("level"),
        F.when(named, F.regexp_extract(top, r"^#+\s+(.+)$", 1)).otherwise("").alias("heading"),
        F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content"),
    )


def split_level(sections, id_col="source"):
    """3 with three third-level headings or more, else 4 with two fourth-level ones, else 2 with two
    second-level ones, else the most frequent level (the first seen of equals); 0 without headings."""
    counts = sections.filter("level > 1").groupBy(id_col, "level").agg(F.count(F.lit(1)).alias("n"), F.min("section_no").alias("seen"))
    n = lambda level: F.max(F.when(F.col("level") == level, F.col("n")).otherwise(0))
    most = F.max_by("level", F.struct("n", -F.col("seen")))
    picked = counts.groupBy(id_col).agg(F.when(n(3) >= 3, 3).when(n(4) >= 2, 4).when(n(2) >= 2, 2).otherwise(most).alias("split_level"))
    return sections.select(id_col).distinct().join(picked, id_col, "left").select(id_col, F.coalesce("split_level", F.lit(0)).cast("int").alias("split_level"))
