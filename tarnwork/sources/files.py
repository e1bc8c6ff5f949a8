"""Files in and tables out, by Spark's readers and writers alone."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import strip

# File extensions that are read, and the type each stands for.
TYPES = {"html": "html", "htm": "html", "md": "markdown", "txt": "markdown"}


def scan_corpus(spark, path):
    """One row a text file below ``path``: ``path``, ``source``, ``stem``, ``file_type``, ``text``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(TYPES) + "}").text(path, wholetext=True)
    at = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))
    kinds = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return at.select("path", "source", F.regexp_replace("source", r"\.[^.]*$", "").alias("stem"), F.try_element_at(kinds, F.lower(F.regexp_extract("source", r"\.([^.]*)$", 1))).alias("file_type"), "text")


def split_blank(docs, text_col="text"):
    """(documents with a text, documents without)."""
    full = F.coalesce(strip(text_col) != "", F.lit(False))
    return docs.filter(full), docs.filter(~full)


def write_parsed(docs, path, mode="overwrite"):
    """One row a stem, that of the last path."""
    w = Window.partitionBy("stem").orderBy(F.desc("path"))
    docs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").write.mode(mode).parquet(path)


def write_chunks(chunks, path, clean=False):
    chunks.write.mode("overwrite" if clean else "append").parquet(path)


def save_index(index, path, mode="overwrite"):
    for name, frame in index.items():
        frame.write.mode(mode).parquet(f"{path}/{name}")


def load_index(spark, path, names=("blocks", "terms", "stats", "words")):
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


EVAL_ITEM = "id int, question string, expected_answer string, expected_sources array<string>, category string"


def read_eval_set(spark, path, lines=False):
    """The items of a JSON array, or of JSON lines, one an item."""
    return spark.read.schema(EVAL_ITEM).json(path, multiLine=not lines)


def write_report(report, path, digits=4, best=None):
    """JSON lines, fractions rounded; the row of ``best`` (of a sweep) in a folder of its own."""
    rounded = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in report.dtypes]
    report.select(*rounded).write.mode("overwrite").json(path)
    if best is not None:
        write_report(best, f"{path}-best", digits)


def ingest_report(docs, text_col="text"):
    """One row: ``total_files``, ``processed``, ``failed`` (blank or of an unknown type, where
    ``file_type`` is a column).  The failed ones themselves are rows: see ``failed_docs``."""
    ok = _usable(docs, text_col)
    return docs.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"))


def failed_docs(docs, text_col="text"):
    return docs.filter(~_usable(docs, text_col))


def _usable(docs, text_col):
    full = F.coalesce(strip(text_col) != "", F.lit(False))
    return full & F.col("file_type").isNotNull() if "file_type" in docs.columns else full
