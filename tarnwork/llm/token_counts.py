"""Token counts of whole texts for a sentencepiece BPE model.

No vocabulary entry of such a model crosses a line feed or has a blank after
another character, so the text falls into units (blanks and the characters after
them; runs of blanks; line feeds) whose token counts add up exactly.  Lengths of
units are looked up in two tiers inside each task: a table of frequent units,
broadcast, then a cache in the worker that is filled by the library.  Units of texts are
not shuffled.  To choose the frequent ones each task sums up all its texts in one row of
at most ``table_size`` units of fewer than UNIT_LIMIT characters (longer ones are left to the
caches), and such rows are merged in a tree down to one, which the driver reads.

Nulls count as empty texts (0 tokens).  Rows are independent: ties, repeated rows
and other columns change nothing, an empty table gives an empty result.
"""

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from .common import stage

TABLE_SIZE = 32_768
CACHE_SIZE = 500_000
FAN_IN = 64
UNIT_LIMIT = 256
UNIT = re.compile("[ ▁]*[^ ▁\n]+|[ ▁]+|\n")


def check_model(path):
    """Raise unless units of this model add up: identity normaliser, no piece that
    spans a unit boundary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
        raise ValueError("a piece of this model crosses unit boundaries")
    if sp.normalize("ﬁ  a ") != "▁ﬁ▁▁a▁":
        raise ValueError("this model rewrites texts before it splits them")
    return path


def units(text):
    """The units of a text, after the model's own leading blank."""
    return UNIT.findall(" " + text) if text else []


class UnitLengths(dict):
    """unit -> tokens: the broadcast table, then the cache, then the library."""

    def __init__(self, frequent, path, cache_size=CACHE_SIZE):
        import sentencepiece

        super().__init__(frequent)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache, self.cache_size = {}, cache_size

    def encode(self, unit):
        if unit == "\n":
            return len(self.sp.encode("\n", num_threads=1)) - 1
        if unit[0] in " ▁":
            return len(self.sp.encode(unit[1:], num_threads=1)) if len(unit) > 1 else 1
        return len(self.sp.encode("\n" + unit, num_threads=1)) - 2

    def __missing__(self, unit):
        n = self.cache.get(unit)
        if n is None:
            if len(self.cache) >= self.cache_size:
                self.cache.clear()
            self.cache[unit] = n = self.encode(unit)
        return n


def frequent_units(docs, text_col="text", table_size=TABLE_SIZE):
    """The units that occur most, from bounded summaries of every task over all texts."""

    def trim(counts, most):
        return Counter(dict(counts.most_common(most))) if len(counts) > most else counts

    def rows(slot, counts):
        return pa.RecordBatch.from_pydict(
            {"slot": pa.array([slot], pa.int32()), "units": pa.array([list(counts)], pa.list_(pa.string())), "counts": pa.array([list(counts.values())], pa.list_(pa.int64()))}
        )

    def summarise(batches):
        from pyspark import TaskContext

        counts = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(u for u in units(text) if len(u) < UNIT_LIMIT)
                if len(counts) > 8 * table_size:
                    counts = trim(counts, 2 * table_size)
        if counts:
            yield rows(TaskContext.get().partitionId(), trim(counts, table_size))

    def merge(batches):
        counts, slot = Counter(), 0
        for batch in batches:
            for at, u, n in zip(*(batch.column(c).to_pylist() for c in ("slot", "units", "counts"))):
                counts.update(dict(zip(u, n)))
                counts, slot = trim(counts, 4 * table_size), at
        if counts:
            yield rows(slot, trim(counts, table_size))

    schema = "slot int, units array<string>, counts array<bigint>"
    level = docs.select(F.col(text_col)).filter(F.col(text_col).isNotNull()).mapInArrow(summarise, schema)
    size = level.rdd.getNumPartitions()
    level = stage(level, "unit-summaries")
    while size > 1:
        # A tree: FAN_IN neighbours a group, so that no task reads more than FAN_IN summaries.
        size = -(-size // FAN_IN)
        groups = level.withColumn("slot", F.expr(f"slot div {FAN_IN}").cast("int")).repartitionByRange(size, "slot").sortWithinPartitions("slot")
        level = stage(groups.mapInArrow(by_slot(merge), schema), "unit-summaries")
    last = level.collect()  # one row, or none for an empty table
    return [u for row in last for u in row["units"]]


def by_slot(merge):
    """``merge`` for each run of rows with one slot."""

    def run(batches):
        held, last = [], None
        for batch in batches:
            for i, slot in enumerate(batch.column("slot").to_pylist()):
                if held and slot != last:
                    yield from merge(held)
                    held = []
                held.append(batch.slice(i, 1))
                last = slot
        if held:
            yield from merge(held)

    return run


def token_counts(docs, model_path, id_col="doc_id", text_col="text", limit=4096, table_size=TABLE_SIZE):
    """One row a document: its id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``model_path`` is read by every executor.  The broadcast table holds
    ``table_size`` units of fewer than UNIT_LIMIT characters at most, whatever the input.
    """
    spark = docs.sparkSession
    check_model(model_path)
    blank = UnitLengths({}, model_path)
    table = spark.sparkContext.broadcast({u: blank.encode(u) for u in frequent_units(docs, text_col, table_size)})
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        lengths = UnitLengths(table.value, model_path)
        get = lengths.__getitem__
        for batch in batches:
            n = [sum(map(get, units(t))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    text = F.col(text_col)
    return (
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
        .mapInArrow(count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
        .withColumnRenamed("doc_id", id_col)
    )
