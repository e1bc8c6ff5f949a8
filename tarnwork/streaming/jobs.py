"""Streams of chunks, messages and cached queries."""

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegerType, StructType

from ..folders import stage
from ..functions.text import clean_markdown
from ..operators.store import new_chunks_only
from ..operators.structure import parent_child


BUCKETS = 64
FILTER_BITS, HASHES = 10, 7  # bits an id, places an id: one id in a hundred is taken for stored in error


def _places(hashes, bits):
    """The places of each id (by its two 64-bit hashes) in a filter of ``bits`` bits."""
    return (hashes[:, :1] + np.arange(HASHES, dtype=np.uint64) * (hashes[:, 1:] | np.uint64(1))) % np.uint64(bits)


def make_filter(hashes):
    bits = max(64, -(-FILTER_BITS * len(hashes) // 8) * 8)
    held = np.zeros(bits, bool)
    held[_places(hashes, bits).ravel()] = True
    return np.packbits(held).tobytes()


def may_hold(made, hashes):
    """Which ids the filter may hold; never false for one it was made of."""
    held = np.unpackbits(np.frombuffer(made, np.uint8))
    return (held[_places(hashes, len(held))] == 1).all(1)


def _hashed(rows, id_col, buckets):
    """``rows`` with ``_h`` (two hashes of the id) and ``_bucket``."""
    h = F.array(F.xxhash64(id_col), F.xxhash64(F.lit("second"), id_col))
    return rows.withColumn("_h", h).withColumn("_bucket", F.pmod(F.col("_h")[0], F.lit(buckets)).cast("int"))


def _uint64(column):
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 2)


def filters_of(rows, id_col, buckets=BUCKETS):
    """``_bucket``, ``made``: a filter of the ids of each bucket of ``rows``."""

    def run(group):
        return pa.table({"_bucket": group["_bucket"].slice(0, 1), "made": pa.array([make_filter(_uint64(group["_h"]))], pa.binary())})

    return _hashed(rows.select(id_col), id_col, buckets).select("_bucket", "_h").groupBy("_bucket").applyInArrow(run, "_bucket int, made binary")


def perhaps_stored(batch, filters, id_col, buckets=BUCKETS):
    """``_bucket`` and id of the rows of ``batch`` that some filter of their bucket may hold."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = batch.schema[id_col].dataType

    def run(rows, filters):
        hashes = _uint64(rows["_h"]) if rows.num_rows else np.zeros((0, 2), np.uint64)
        hit = np.zeros(len(hashes), bool)
        for made in filters["made"].to_pylist():
            hit |= may_hold(made, hashes)
        return rows.select(["_bucket", id_col]).filter(pa.array(hit)) if rows.num_rows else pa.table({"_bucket": pa.array([], pa.int32()), id_col: pa.array([], to_arrow_type(kind))})

    left = _hashed(batch.select(id_col), id_col, buckets).groupBy("_bucket")
    return left.cogroup(filters.groupBy("_bucket")).applyInArrow(run, f"_bucket int, {id_col} {kind.simpleString()}")


def add_new(batch, path, id_col="id", order=None, buckets=BUCKETS):
    """Adds the rows of ``batch`` whose ids the table at ``path`` lacks; returns the buckets of the
    table that were read for it.

    The table is partitioned by a hash of the id (``_bucket``), and ``path``-filters holds a Bloom
    filter for each bucket and batch, some ten bits an id.  Ids that no filter knows are new; only
    the buckets of the others are read, and only their ids.  Filters are written before rows, so
    that a batch that failed between the two is added when it runs again.

    What is stored is found from ids alone.  The other columns are staged once, and those of new
    rows are dealt once, to their buckets, where repeats of an id (the first by ``order`` stays) go too."""
    spark, schema = batch.sparkSession, batch.schema
    staged = stage(_hashed(batch, id_col, buckets).drop("_h"), "ingested", compression="zstd")
    ids, new = staged.select("_bucket", id_col), staged
    known = spark.read.schema("_bucket int, made binary").parquet(f"{path}-filters")
    wanted = []
    if not known.isEmpty():
        perhaps = stage(perhaps_stored(ids, known, id_col, buckets), "perhaps-stored")
        wanted = sorted(r[0] for r in perhaps.select("_bucket").distinct().collect())  # at most ``buckets``
    if wanted:
        stored = spark.read.schema(StructType([schema[id_col]]).add("_bucket", IntegerType())).parquet(path)
        held = stored.filter(F.col("_bucket").isin(wanted)).select(id_col).join(perhaps.select(id_col), id_col, "left_semi")
        held = stage(held, "stored-already")
        ids = stage(new_chunks_only(ids, held, id_col), "new-ids")
        if ids.isEmpty():
            return wanted
        new = new_chunks_only(staged, held, id_col)
    filters_of(ids, id_col, buckets).write.mode("append").parquet(f"{path}-filters")
    # An id has one bucket, so rows that are dealt by it need no other deal to meet their repeats.
    first = F.row_number().over(Window.partitionBy("_bucket", id_col).orderBy(*(order or [id_col])))
    once = new.repartition("_bucket").withColumn("_n", first).filter("_n = 1")
    once.select(*schema.names, "_bucket").write.mode("append").option("compression", "zstd").partitionBy("_bucket").parquet(path)
    return wanted


def stream_ingest(stream, path, checkpoint, id_col="id", order=None, prepare=None, buckets=BUCKETS):
    """Adds the rows of a stream whose ids the table at ``path`` lacks (see ``add_new``).
    ``prepare`` makes the rows of each batch, as ``clean_and_chunk`` does of documents.  A batch
    that is run again after a failure finds its ids there.  Returns a writer; ``.start()`` runs
    it.  A table that was begun with other buckets must keep them."""
    spark = stream.sparkSession
    spark.createDataFrame([], "_bucket int, made binary").write.mode("append").parquet(f"{path}-filters")

    def add(batch, _):
        add_new(batch if prepare is None else prepare(batch), path, id_col, order, buckets)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def clean_and_chunk(docs, source_col="source", text_col="text"):
    """The ingest plan of documents: cleaned Markdown, parents and children with their ids and the
    other columns; blank documents have no chunks."""
    cleaned = docs.withColumn("markdown", clean_markdown(text_col)).filter("markdown <> ''").drop(text_col)
    return parent_child(cleaned, source_col, "markdown")


SLICE = 50_000  # rows of a frame that a stream's step returns
CACHE_BUCKETS = 1024


def last_window(kept, frames, most):
    """The window ``kept`` (turn, role, text) after the messages of ``frames`` in order of turn.

    Of each frame stay its turns and who spoke (9 bytes a message) and the messages of the
    ``most`` last turns so far: whether a leading assistant's message is dropped depends on
    the roles of all messages, but no other text is ever needed."""
    turns, helped, last, seen = [], [], [], 0
    for rows in frames:
        turns.append(rows["turn"].to_numpy(np.int64, copy=True))
        helped.append((rows["role"] == "assistant").to_numpy(bool, copy=True))
        late = np.argsort(turns[-1], kind="stable")[-most:]
        last = sorted(last + [(int(turns[-1][i]), seen + int(i), rows["role"].iloc[i], rows["text"].iloc[i]) for i in late], key=lambda m: m[:2])[-most:]
        seen += len(rows)
    turns = np.concatenate(turns)
    helped = np.concatenate(helped)[np.argsort(turns, kind="stable")]
    roles = np.concatenate([np.array([m[1] == "assistant" for m in kept], bool), helped])
    size, end = len(kept), len(kept)
    for _ in range(len(helped)):
        end += 1
        full = size >= most
        size = min(size + 1, most)
        if full and roles[end - size]:
            size -= 1
    return [*kept, *([turn, role, text] for turn, _, role, text in last)][-size:] if size else []


def walk(stored, at, ttl):
    """(time of the last miss, hits) of times ``at`` in order, after a miss at ``stored``."""
    hits, i = np.ones(len(at), bool), 0
    while True:
        if stored is not None:
            i = int(np.searchsorted(at, stored + ttl, "right"))
        if i >= len(at):
            return stored, hits
        hits[i], stored = False, int(at[i])


def walk_times(stored, frames, ttl_seconds):
    """(stored, times, hits): the times of ``frames`` in order, which of them are hits, and the
    time of the last miss; times in microseconds.  Only the times are held, 8 bytes a row."""
    times = np.sort(np.concatenate([rows["ts"].to_numpy("datetime64[us]", copy=True) for rows in frames]))
    stored, hits = walk(stored, times.view(np.int64), int(ttl_seconds * 1_000_000))
    return stored, times, hits


def walk_keys(held, frames, ttl_seconds):
    """(names, key numbers, times, hits) of the rows of ``frames`` (key, ts), by key and time; times
    in microseconds.  ``held`` (key -> time of the last miss) is brought up to date.

    Of a row its time and the number of its key are held, 12 bytes; each key is held once."""
    place, codes, times = {}, [], []
    for rows in frames:
        own, names = pd.factorize(rows["key"].to_numpy(object))  # -1: null
        names = [*names, None] if (own < 0).any() else names
        codes.append(np.array([place.setdefault(name, len(place)) for name in names], np.int32)[own])
        times.append(rows["ts"].to_numpy("datetime64[us]", copy=True))
    codes, times = np.concatenate(codes), np.concatenate(times)
    order = np.lexsort((times.view(np.int64), codes))
    codes, times = codes[order], times[order]
    ends = np.searchsorted(codes, np.arange(len(place)), "right").tolist()
    hits, at, begin = np.ones(len(times), bool), times.view(np.int64), 0
    for name, end in zip(place, ends):
        held[name], hits[begin:end] = walk(held.get(name), at[begin:end], int(ttl_seconds * 1_000_000))
        begin = end
    return list(place), codes, times, hits


def packed(held):
    """A dict of key -> time as bytes (an Arrow stream)."""
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([pa.array(held, pa.string()), pa.array(held.values(), pa.int64())], ["key", "stored"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(made):
    table = pa.ipc.open_stream(bytes(made)).read_all()
    return dict(zip(table["key"].to_pylist(), table["stored"].to_pylist()))


def stream_history(messages, max_rounds=10):
    """The running window of each conversation, as ``turns``, ``roles``, ``texts``: a row for each
    conversation that got messages (update mode).  The window grows to ``2 * max_rounds``; from
    there each message drops the oldest, and a leading assistant's message with it."""
    most = 2 * max_rounds

    def step(key, frames, state):
        kept = json.loads(state.get[0]) if state.exists else []
        kept = last_window(kept, frames, most)
        state.update((json.dumps(kept),))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [[m[0] for m in kept]], "roles": [[m[1] for m in kept]], "texts": [[m[2] for m in kept]]})

    kind = messages.schema["conv_id"].dataType.simpleString()
    spoken = messages.filter(F.col("role").isin("user", "assistant")).select("conv_id", "turn", "role", "text")
    return spoken.groupBy("conv_id").applyInPandasWithState(step, f"conv_id {kind}, turns array<bigint>, roles array<string>, texts array<string>", "kept string", "update", GroupStateTimeout.NoTimeout)


def stream_cache(asked, ttl_seconds=86400, delay="1 hour", buckets=CACHE_BUCKETS):
    """``key``, ``ts``, ``hit`` for each query of a stream (``key``, ``ts``): a hit within
    ``ttl_seconds`` of the miss that stored the answer.  Entries leave when the watermark has
    passed their end; queries later than the watermark are ignored.

    Keys are dealt to ``buckets`` by a hash, and a bucket's live entries are one state, so that
    a batch calls Python once a bucket and not once a key.  A step holds the entries of a bucket
    and 12 bytes for each of its rows in the batch: with more keys or rows, take more buckets.  A
    checkpoint keeps the number of buckets it was begun with."""
    ttl = int(ttl_seconds * 1_000_000)

    def step(bucket, frames, state):
        held, now = unpacked(state.get[0]) if state.exists else {}, state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            names, codes, times, hits = walk_keys(held, frames, ttl_seconds)
            names = np.array(names, object)
            for a in range(0, len(hits), SLICE):
                part = slice(a, a + SLICE)
                yield pd.DataFrame({"key": names[codes[part]], "ts": times[part].astype("datetime64[ns]"), "hit": hits[part]})
        # Queries of later batches are later than the watermark, so no entry that ends before it can serve one.
        held = {key: at for key, at in held.items() if at + ttl > now * 1000}
        if held:
            state.update((packed(held),))
            state.setTimeoutTimestamp(-(-(min(held.values()) + ttl) // 1000))
        elif state.exists:
            state.remove()

    marked = asked.select("key", "ts").withWatermark("ts", delay)
    dealt = marked.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInPandasWithState(step, "key string, ts timestamp, hit boolean", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
