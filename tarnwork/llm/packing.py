"""Sequences of bounded length, packed by estimated attention cost.

Documents are encoded once.  Their full-length pieces are sequences by themselves;
what remains of each document is packed in groups (hash of id and row) of bounded
size.  Inside a group there are just enough sequences for its tokens.  Remainders
go, longest first, to the sequence of lowest cost (tokens, plus the squares of
piece lengths, weighted) that has room; when none has room the piece is cut to fill
the emptiest one.  So a group pads less than one sequence in all.

A null text is empty (its end id alone).  Null and repeated ids are rows like
others.  An empty table gives an empty result; other columns are ignored.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .byte_bpe import CACHE_SIZE, encoded_rows
from .byte_bpe import shared as byte_bpe
from .common import partitions, stage

GROUP_BYTES = 4 << 20


def assign(lengths, capacity, linear=1.0, quadratic=1.0 / 1024):
    """Pieces (item, start, length, sequence, offset) of items with these lengths (each
    under ``capacity``), by the rule above."""
    total = int(sum(lengths))
    bins = -(-total // capacity)
    room, cost = np.full(bins, capacity), np.zeros(bins)
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, int(lengths[item])
        while left:
            b = int(np.argmin(np.where(room >= left, cost, np.inf)))
            if room[b] < left:
                b = int(np.argmax(room))
            n = min(left, int(room[b]))
            out.append((item, start, n, b, capacity - int(room[b])))
            room[b] -= n
            cost[b] += linear * n + quadratic * n * n
            start, left = start + n, left - n
    return out


def pack(docs, tokenizer_path, end_id, capacity=1024, id_col="doc_id", text_col="text", linear=1.0, quadratic=1.0 / 1024, group_bytes=GROUP_BYTES, cache_size=CACHE_SIZE):
    """One row a piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``.  Sequence ids are gapless from 0."""
    spark = docs.sparkSession
    text = F.col(text_col)
    size = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 1
    groups = max(1, -(-size // group_bytes))
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.length(text), F.monotonically_increasing_id()), F.lit(groups)).alias("grp"))

    def crc(ids):
        return zlib.crc32(ids.astype("<u4").tobytes())

    def encode(batches):
        bpe = byte_bpe(tokenizer_path, cache_size)
        end = bpe.pack([end_id])
        for batch in batches:
            out = {"i": [], "start": [], "length": [], "ids_crc32": [], "doc_tokens": [], "rest": []}
            for i, raw in enumerate(encoded_rows(batch.column(1), bpe)):
                raw += end
                ids = np.frombuffer(raw, bpe.dtype)
                full = len(ids) - len(ids) % capacity
                for start in range(0, full, capacity):
                    for k, v in zip(out, (i, start, capacity, crc(ids[start : start + capacity]), len(ids), None)):
                        out[k].append(v)
                if full < len(ids):
                    for k, v in zip(out, (i, full, len(ids) - full, None, len(ids), ids[full:].astype("<u4").tobytes() if bpe.dtype.itemsize == 4 else ids[full:].tobytes())):
                        out[k].append(v)
            at = pa.array(out.pop("i"), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), *(pa.array(v, pa.binary() if k == "rest" else pa.int64()) for k, v in out.items())],
                ["doc_id", "grp", *out],
            )

    def place(batches):
        """Rows of a group are adjacent; full pieces (no ``rest``) come first."""
        dtype = byte_bpe(tokenizer_path, cache_size).dtype
        held, name, sequence = [], None, 0

        def flush():
            nonlocal sequence
            if not held:
                return None
            parts = [np.frombuffer(r[4], dtype) for r in held]
            res = []
            for item, start, n, b, offset in assign([len(p) for p in parts], capacity, linear, quadratic):
                doc, first, _, total, _ = held[item]
                res.append((doc, first + start, n, crc(parts[item][start : start + n]), total, name, sequence + b, offset))
            sequence = 0
            held.clear()
            return res

        def batch_of(rows):
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], doc_type), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp", "seq", "offset"])

        for batch in batches:
            doc_type, out = batch.column(0).type, []
            for doc, grp, start, length, check, total, rest in zip(*(c.to_pylist() for c in batch.columns)):
                if grp != name:
                    out += flush() or []
                    name, sequence = grp, 0
                if rest is None:
                    out.append((doc, start, length, check, total, grp, sequence, 0))
                    sequence += 1
                else:
                    held.append((doc, start, length, total, rest))
            if out:
                yield batch_of(out)
        if last := flush():
            yield batch_of(last)

    encoded = rows.mapInArrow(encode, f"doc_id {id_type}, grp bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, rest binary")
    dealt = encoded.repartition(max(partitions(spark), min(groups, 4 * partitions(spark))), "grp").sortWithinPartitions("grp", F.col("rest").isNotNull(), "doc_id", "start")
    pieces = stage(dealt.mapInArrow(place, f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, grp bigint, seq bigint, offset bigint"), "pieces")
    before = Window.partitionBy("block").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    # Offsets of the groups: sums inside blocks of 4096 groups, then over the blocks.
    per = pieces.groupBy("grp").agg((F.max("seq") + 1).alias("n")).withColumn("block", F.expr("grp div 4096"))
    blocks = per.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("blocks_before"))
    first = per.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0))).join(blocks, "block").select("grp", (F.col("inside") + F.col("blocks_before")).alias("first"))
    return pieces.join(first, "grp").select(F.col("doc_id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("seq")).alias("sequence_id"), "offset")
