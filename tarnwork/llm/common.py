"""What the operators share: tables in the shared folder, and words of texts.

A *staged* table is a DataFrame written as Parquet below ``spark.checkpoint.dir``
and read back.  It cuts the lineage, fixes values that depend on partitioning,
and survives the loss of any executor.
"""

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np

_OWN_DIRS = {}


def shared_dir(spark):
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.
    A temporary folder stands in for it on one machine only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="tarnwork-")
    return _OWN_DIRS[app]


def fresh_dir(spark, label):
    return f"{shared_dir(spark)}/tarnwork/{label}-{uuid.uuid4().hex}"


BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


@contextmanager
def small_batches(spark, rows=BATCH_ROWS):
    """Arrow batches of at most ``rows`` rows while an action of ours runs: whole texts are
    long, and both the executor and its Python workers hold a batch or two per task."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark):
    """Shuffle files of an action of ours go when it ends: nothing reads them again."""
    before = spark.conf.get(CLEAN_SETTING, "false")
    spark.conf.set(CLEAN_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SETTING, before)


def stage(df, label):
    """Write ``df`` to the shared folder and read it back."""
    path = fresh_dir(df.sparkSession, label)
    with small_batches(df.sparkSession), shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark):
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x):
    """A bijective 64-bit finaliser over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


class WordCodes(dict):
    """word (bytes) -> 64-bit hash, remembered for at most ``limit`` words."""

    def __init__(self, limit=200_000):
        import xxhash

        super().__init__()
        self.limit, self.hash = limit, xxhash.xxh3_64_intdigest

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        self[word] = code = self.hash(word)
        return code

    def of(self, words):
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(codes, k):
    """Hashes of the runs of ``k`` codes; of the whole run if it is shorter (none if empty)."""
    n = len(codes)
    if n == 0:
        return codes
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + codes[j : n - k + 1 + j])
    return h
