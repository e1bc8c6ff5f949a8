"""Unit vectors and exact cosine neighbours in blocks."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .nearest import ROWS, block_topk

BLOCK = 4096


def l2_normalize(c):
    """Unit vector of an array<float>; the zero vector stays."""
    v = F.transform(F.col(c), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def hashed_words(texts, dim=64):
    """Unit vectors of signed word hashes: the encoder where no model is plugged in."""
    import xxhash

    out = np.zeros((len(texts), dim))
    for row, text in enumerate(texts):
        for word in (text or "").lower().split():
            h = xxhash.xxh3_64_intdigest(word)
            out[row, h % dim] += 1 if h >> 63 else -1
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def embed_column(rows, text_col="text", encode=hashed_words, batch_size=32, name="embedding"):
    """Adds ``name`` (array<float>): ``encode`` takes lists of at most ``batch_size`` texts and
    returns a matrix.  It is called inside tasks, so a model it loads stays in their worker."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            values = part.tolist()
            made = [np.asarray(encode(values[i : i + batch_size]), np.float32) for i in range(0, len(values), batch_size)]
            yield pd.Series([v for m in made for v in m])

    return rows.withColumn(name, run(text_col))


def vector_topk(vectors, queries, k=20, id_col="id", query_id="query_id", vector_col="embedding", exclude_self=False, block=BLOCK):
    """Top ``k`` rows of each query by cosine of unit vectors (``score`` to 4 digits); ties by id.

    Rows and queries are cut into blocks, of at most about ROWS and ``block``, and each block of
    rows meets each block of queries in one group (``nearest``): a task holds one pair of blocks
    and the scores of a few queries, whatever the sizes, and nothing goes through the driver.
    Each group keeps its own top ``k`` of each query, and only those are shuffled on.  Ids may have
    any type.  Vectors match only those of their own length; null vectors, empty ones and those
    that hold nulls match nothing."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding")).filter(F.size("embedding") > 0)
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector_col).alias("embedding")).filter(F.size("embedding") > 0)
    blocks, qblocks = (max(1, -(-side.count() // size)) for side, size in ((rows, ROWS), (asked, block)))
    own, every = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumns({"deal": F.lit(0), "block": own("id", blocks)}).withColumn("qblock", every(qblocks))
    right = asked.withColumns({"deal": F.lit(0), "qblock": own("query_id", qblocks)}).withColumn("block", every(blocks))
    best = block_topk(left, right, k, exclude_self)
    return best.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), F.round("exact", 4).alias("score"), "rank")
