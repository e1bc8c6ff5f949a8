"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

A shard is two files.  ``ids``: the raw ids, little-endian, two bytes each where
the vocabulary allows it, else four.  ``index``: a header of fixed size, then a minimal
perfect hash function over the keys (levels of bits in blocks with their rank: a key lives
at the first level where its bit has no rival), then slots of fixed size (a fingerprint of
the key, the document's start in the shard, its length), then the ids in order.
A document is found by key with the header, a block or two and one slot, each at a place
that is computed, so the bytes read do not grow with the shard.
Shards cover ascending ranges of keys; a manifest table names them.

Files are written by tasks under names of their own; the manifest (staged) names
only those of the attempts that counted, so lost executors leave orphans, not errors.

Ids are bigint, or cast to it.  A null text is empty (the end id alone).  Null ids come
first.  Repeated ids are told apart by their place among equals.  An empty table gives
empty results.
"""

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .byte_bpe import encoded_rows
from .byte_bpe import shared as byte_bpe
from .common import fresh_dir, mix64, partitions, stage

GAMMA = 2.0
READ_IDS = 1 << 20
CACHE_SIZE = 900_000  # runs that a worker remembers, in each of two generations
MAGIC = b"TKIX0002"
MOST_LEVELS = 60
HEADER = struct.Struct(f"<8sQQQ8sQ{MOST_LEVELS}Q")  # magic, documents, null ids, seed, dtype, levels, their sizes in blocks
BLOCK = np.dtype([("rank", "<u8"), ("bits", "u1", 64)])  # 512 bits, and how many are set before them
SLOT = np.dtype([("print", "<u4"), ("length", "<u4"), ("start", "<u8")])
MANIFEST = "shard int, ids_path string, index_path string, first_id bigint, last_id bigint, n_docs bigint, n_ids bigint"


def _hash(keys, level):
    return mix64(keys ^ mix64(np.full(1, level + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


class PerfectHash:
    """Minimal perfect hash over distinct uint64 keys; each level is an array of BLOCK."""

    def __init__(self, levels):
        self.levels = levels

    @classmethod
    def build(cls, keys, gamma=GAMMA):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("keys repeat")
        levels, seen = [], 0
        while len(keys):
            blocks = max(1, -(-int(gamma * len(keys)) // 512))
            at = (_hash(keys, len(levels)) % np.uint64(512 * blocks)).astype(np.int64)
            alone = np.bincount(at, minlength=512 * blocks) == 1
            level = np.zeros(blocks, BLOCK)
            level["bits"] = np.packbits(alone).reshape(-1, 64)
            counts = alone.reshape(-1, 512).sum(1)
            level["rank"] = seen + np.cumsum(counts) - counts
            seen += int(counts.sum())
            levels.append(level)
            keys = keys[~alone[at]]
        return cls(levels)

    def slots(self, keys):
        """Slot of each key; -1 for keys that no level holds."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for number, level in enumerate(self.levels):
            if not len(left):
                break
            at = (_hash(keys[left], number) % np.uint64(512 * len(level))).astype(np.int64)
            bits = np.unpackbits(level["bits"].ravel())
            inside = np.cumsum(bits, dtype=np.int64) - bits
            hit = bits[at] == 1
            block = at[hit] // 512
            out[left[hit]] = level["rank"][block].astype(np.int64) + inside[at[hit]] - inside[block * 512]
            left = left[~hit]
        return out


def document_keys(ids, valid, occurrence, seed=0):
    """uint64 keys of (id or null, place among equal ids); ids is int64.  First places of ids
    never meet each other; others do with a chance of 2**-64, and then another seed is taken."""
    ids = mix64(np.asarray(ids, np.int64).view(np.uint64) ^ np.uint64(seed))
    ids = np.where(valid, ids, mix64(np.full(1, 0xA5A5F00D + seed, np.uint64)))
    occurrence = np.asarray(occurrence, np.uint64) + ~np.asarray(valid)
    return np.where(occurrence == 0, ids, mix64(ids + occurrence * np.uint64(0x9E3779B97F4A7C15)))


def _occurrences(ids, valid):
    """Place of each entry among equal entries; equal entries are adjacent."""
    n = len(ids)
    new = np.ones(n, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (valid[1:] != valid[:-1])
    at = np.arange(n)
    return at - np.maximum.accumulate(np.where(new, at, 0))


def pack_index(ids, valid, lengths, dtype):
    n, seed = len(ids), 0
    occurrence = _occurrences(ids, valid)
    while True:
        keys = document_keys(ids, valid, occurrence, seed)
        if len(np.unique(keys)) == n:
            break
        seed += 1
    mph = PerfectHash.build(keys)
    slots = np.zeros(n, SLOT)
    at = mph.slots(keys)
    slots["print"][at] = (keys >> np.uint64(32)).astype("<u4")
    slots["start"][at], slots["length"][at] = np.cumsum(lengths) - lengths, lengths
    sizes = [len(level) for level in mph.levels]
    head = HEADER.pack(MAGIC, n, int((~valid).sum()), seed, dtype.str.encode(), len(sizes), *sizes, *[0] * (MOST_LEVELS - len(sizes)))
    return b"".join([head, *(level.tobytes() for level in mph.levels), slots.tobytes(), np.asarray(ids, "<i8").tobytes()])


class ShardReader:
    """Access to one shard, by key or as a whole."""

    def __init__(self, fs, ids_path, index_path):
        self.index, self.file = fs.open_input_file(index_path), fs.open_input_file(ids_path)
        magic, self.n, self.null_ids, self.seed, dtype, levels, *sizes = HEADER.unpack(self.index.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError("not an index file")
        self.dtype, self.sizes = np.dtype(dtype.rstrip(b"\0").decode()), sizes[:levels]
        self.places = HEADER.size + BLOCK.itemsize * np.cumsum([0, *self.sizes])
        self.slots_at = int(self.places[-1])

    def _read(self, file, at, dtype, n):
        file.seek(int(at))
        return np.frombuffer(file.read(n * dtype.itemsize), dtype)

    def ids(self, start, length):
        return self._read(self.file, start * self.dtype.itemsize, self.dtype, int(length))

    def get(self, doc_id, occurrence=0):
        """The ids of one document, or None."""
        key = document_keys([doc_id or 0], np.array([doc_id is not None]), [occurrence], self.seed)
        for number, size in enumerate(self.sizes):
            at = int(_hash(key, number)[0] % np.uint64(512 * size))
            block = self._read(self.index, self.places[number] + BLOCK.itemsize * (at // 512), BLOCK, 1)[0]
            bits = np.unpackbits(block["bits"])
            if bits[at % 512]:
                slot = self._read(self.index, self.slots_at + SLOT.itemsize * (int(block["rank"]) + int(bits[: at % 512].sum())), SLOT, 1)[0]
                return self.ids(int(slot["start"]), slot["length"]) if slot["print"] == key[0] >> np.uint64(32) else None
        return None

    def documents(self):
        """(id, whether it is not null, start, length) arrays of all documents in order, each
        looked up by its key."""
        levels = [self._read(self.index, at, BLOCK, size) for at, size in zip(self.places, self.sizes)]
        slots = self._read(self.index, self.slots_at, SLOT, self.n)
        ids = self._read(self.index, self.slots_at + SLOT.itemsize * self.n, np.dtype("<i8"), self.n)
        valid = np.arange(self.n) >= self.null_ids
        keys = document_keys(ids, valid, _occurrences(ids, valid), self.seed)
        at = PerfectHash(levels).slots(keys)
        if (at < 0).any() or (slots["print"][at] != (keys >> np.uint64(32)).astype("<u4")).any():
            raise ValueError("the index lost a document")
        return ids, valid, slots["start"][at].astype(np.int64), slots["length"][at].astype(np.int64)


def filesystem(uri):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_shards(docs, tokenizer_path, end_id, id_col="doc_id", text_col="text", shards=None, cache_size=CACHE_SIZE):
    """Encode, append ``end_id`` and write; returns the manifest, a row a shard."""
    spark = docs.sparkSession
    root = fresh_dir(spark, "token-shards")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(shards or partitions(spark), "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, path = filesystem(root)
        fs.create_dir(path, recursive=True)
        name = f"{path}/{shard:06d}-{uuid.uuid4().hex}"
        bpe = byte_bpe(tokenizer_path, cache_size)
        end = bpe.pack([end_id])
        ids, valid, lengths = [], [], []
        with fs.open_output_stream(name + ".ids") as out:
            for batch in batches:
                column = batch.column(0)
                valid.append(np.asarray(column.is_valid()))
                ids.append(column.fill_null(0).to_numpy(zero_copy_only=False))
                for payload in encoded_rows(batch.column(1), bpe):
                    out.write(payload + end)
                    lengths.append(len(payload) // bpe.dtype.itemsize + 1)
        if not lengths:
            fs.delete_file(name + ".ids")
            return
        ids, valid = np.concatenate(ids), np.concatenate(valid)
        with fs.open_output_stream(name + ".index") as out:
            out.write(pack_index(ids, valid, np.array(lengths), bpe.dtype))
        known = ids[valid]
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "ids_path": [name.removeprefix(path + "/") + ".ids"],
                "index_path": [name.removeprefix(path + "/") + ".index"],
                "first_id": pa.array([int(known[0]) if len(known) else None], pa.int64()),
                "last_id": pa.array([int(known[-1]) if len(known) else None], pa.int64()),
                "n_docs": pa.array([len(lengths)], pa.int64()),
                "n_ids": pa.array([sum(lengths)], pa.int64()),
            }
        )

    manifest = stage(ranged.mapInArrow(write, MANIFEST), "token-manifest")
    for c in ("ids_path", "index_path"):
        manifest = manifest.withColumn(c, F.concat(F.lit(root + "/"), F.col(c)))
    return manifest


def read_token_shards(manifest):
    """One row a document, looked up by key in its shard: ``doc_id``, ``start`` (ids of
    all documents before it), ``n_tokens``, ``ids_crc32`` (of the ids as 32-bit integers)."""
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # a row a shard
    shards = shards.select("ids_path", "index_path", "start").repartition(partitions(spark))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, ids_path = filesystem(row["ids_path"])
                reader = ShardReader(fs, ids_path, filesystem(row["index_path"])[1])
                doc_ids, valid, start, length = reader.documents()
                ends, a = np.cumsum(length), 0
                while a < reader.n:
                    # Documents follow each other in the file, so that one read serves many.
                    b = min(max(a + 1, int(np.searchsorted(ends, start[a] + READ_IDS, "right"))), a + 8192, reader.n)
                    ids = reader.ids(int(start[a]), int(start[b - 1] + length[b - 1] - start[a])).astype("<u4").data
                    crc = [zlib.crc32(ids[x : x + y]) for x, y in zip((start[a:b] - start[a]).tolist(), length[a:b].tolist())]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(doc_ids[a:b], pa.int64(), mask=~valid[a:b]),
                            "start": pa.array(start[a:b] + row["start"], pa.int64()),
                            "n_tokens": pa.array(length[a:b], pa.int64()),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )
                    a = b

    return shards.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(manifest_rows, doc_id):
    """The ids of one document by key: the shard by its range, the place by its index.
    ``manifest_rows``: the manifest's rows (one a shard), as collected by the caller."""
    for row in manifest_rows:
        if row["first_id"] is not None and row["first_id"] <= doc_id <= row["last_id"]:
            fs, ids_path = filesystem(row["ids_path"])
            found = ShardReader(fs, ids_path, filesystem(row["index_path"])[1]).get(doc_id)
            if found is not None:
                return found
    return None
