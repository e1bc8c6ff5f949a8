"""A training corpus from raw documents: quality, near copies, repeated passages,
benchmark leaks, packing.  Each stage works on what its predecessor wrote."""

import public_tokenizers
from pyspark.sql import functions as F

from tarnwork.llm import decontamination, jaccard, packing, quality, substrings
from tarnwork.llm.common import fresh_dir


def quality_stage(spark, docs, sf_dir):
    """Documents that pass the quality rules."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies_stage(spark, docs, sf_dir):
    """One row of each component of 5-gram similarity 0.8: that of least id, and of least
    hash of id and text among equals; null ids come last.  Rows without words have no
    component and all stay."""
    return jaccard.first_of_components(docs, k=5, num=80, den=100)


def passages_stage(spark, docs, sf_dir):
    """Texts without the 200-byte strings that occur more than once.  A character cut by a
    removed span goes with it; texts with nothing left but blanks go."""
    done = substrings.cut_texts(docs, as_text=True).filter(r"cut is null or cut.kept rlike '\\S'")
    changed = {"text": F.col("cut.kept"), "n_chars": F.length("cut.kept").cast("bigint")}
    column = lambda c: F.when(F.col("cut").isNotNull(), changed[c]).otherwise(F.col("row")[c]) if c in changed else F.col("row")[c]
    return done.select(*(column(c).alias(c) for c in docs.columns))


def leaks_stage(spark, docs, sf_dir):
    """Rows whose own text has no benchmark passage."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark, docs, sf_dir):
    """Pieces of the documents in sequences of 1024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, cache_size=200_000)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard", near_copies_stage),
    ("suffix_array", passages_stage),
    ("decontamination", leaks_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # the stages are iterative or model-based; tests hold run() against brute force


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        path = fresh_dir(spark, f"pipeline-{name}")
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
