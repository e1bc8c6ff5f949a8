"""Benchmark passages in documents: SimHash windows, Hamming blocks, exact similarity.

Items and texts are word sequences (``\\w+``, lower case).  A window is as long as the
item it is held against.  Windows and items get a 64-bit SimHash of their word shingles
with multiplicity.  An index for each item length cuts fingerprints into BLOCKS pieces and
lists, for each value of a piece, the items within ``radius // BLOCKS`` bits of it; so
every item within ``radius`` of a window is found.  What is found is verified by the
weighted Jaccard similarity of the shingles (sum of lesser over sum of greater counts).

Windows without a shingle of any item of their length have similarity 0 to all of them
and get no fingerprint.
Items are held against all documents in blocks of at most ``block_words`` words, so what
is broadcast has a fixed bound.

Null or wordless items and texts match nothing; items shorter than a shingle are one
shingle; texts shorter than an item are one window.  Repeated items and rows are matched
each.  Empty tables give an empty result; other columns are ignored.
"""

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import WordCodes, shingle_hashes

SHINGLE = 5
THRESHOLD = 0.8
RADIUS = 19
BLOCKS = 8
BLOCK_WORDS = 2_000_000
WORD = re.compile(r"\w+")
FILTER_BITS = 22


def words_of(text):
    return [w.encode() for w in WORD.findall(text.lower())] if text else []


def bit_votes(hashes):
    """One row a hash: +1 or -1 for each of its 64 bits."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def to_fingerprints(votes):
    return np.packbits(votes > 0, axis=1, bitorder="little").view("<u8").ravel()


def weighted_similarity(a, b):
    """Weighted Jaccard similarity of two (values, counts) multisets."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    common = np.minimum(a[1][hit], b[1][at[hit]]).sum()
    return float(common) / float(a[1].sum() + b[1].sum() - common)


class HammingIndex:
    """Fingerprints within ``radius`` bits of a query, by pieces that are all but equal."""

    def __init__(self, prints, radius=RADIUS):
        self.prints, self.radius = prints, radius
        pieces = prints.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        values = np.arange(256, dtype=np.uint8)
        self.near = [np.packbits(np.bitwise_count(values[:, None] ^ pieces[None, :, b]) <= radius // BLOCKS, axis=1) for b in range(BLOCKS)]

    def search(self, queries):
        """(query, item) pairs within the radius."""
        pieces = queries.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)
        mask = reduce(np.bitwise_or, (self.near[b][pieces[:, b]] for b in range(BLOCKS)))
        q, item = np.nonzero(np.unpackbits(mask, axis=1, count=len(self.prints)))
        ok = np.bitwise_count(queries[q] ^ self.prints[item]) <= self.radius
        return q[ok], item[ok]


def among(values, known):
    """Which values are in ``known`` (sorted, not empty)."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Items:
    """Benchmark items, by length, ready to be searched for."""

    def __init__(self, rows, radius=RADIUS):
        codes, by = WordCodes(), {}
        for item_id, text in rows:
            c = codes.of(words_of(text))
            if len(c):
                by.setdefault(len(c), []).append((item_id, shingle_hashes(c, SHINGLE)))
        self.groups = []
        for size, members in sorted(by.items()):
            sets = [np.unique(h, return_counts=True) for _, h in members]
            prints = np.concatenate([to_fingerprints(bit_votes(h).sum(0, keepdims=True)) for _, h in members])
            own = np.unique(np.concatenate([s[0] for s in sets]))
            self.groups.append((size, [i for i, _ in members], sets, HammingIndex(prints, radius), own))
        long = [own for size, _, _, _, own in self.groups if size >= SHINGLE]
        self.long = np.unique(np.concatenate(long)) if long else np.zeros(0, np.uint64)
        self.short = any(size < SHINGLE for size, *_ in self.groups)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.long >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, shingles):
        """Places whose shingle is one of an item."""
        if not len(self.long):
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[(shingles >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        return at[among(shingles[at], self.long)]

    def matches(self, codes, threshold):
        """Best window of each item: (item id, first word, words, similarity)."""
        n, out = len(codes), []
        if not n:
            return out
        shingles = shingle_hashes(codes, SHINGLE)
        hits = self.hits(shingles) if n >= SHINGLE else np.zeros(0, np.int64)
        if not len(hits) and not self.short:
            return out
        sums = None
        for size, ids, sets, index, known in self.groups:
            k = min(SHINGLE, size, n)
            if size < SHINGLE:
                own = shingle_hashes(codes, k) if n >= size else np.zeros(0, np.uint64)
                starts, width = np.flatnonzero(among(own, known)), 1
                votes = bit_votes(own[starts])
            else:
                near = hits[among(shingles[hits], known)]
                if not len(near):
                    continue
                own = shingles
                width = min(size, n) - k + 1
                if sums is None:
                    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bit_votes(shingles), axis=0, dtype=np.int32)])
                mark = np.zeros(len(shingles) - width + 2, np.int32)
                np.add.at(mark, np.clip(near - width + 1, 0, len(mark) - 1), 1)
                np.add.at(mark, np.minimum(near + 1, len(mark) - 1), -1)
                starts = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                votes = sums[starts + width] - sums[starts]
            if not len(starts):
                continue
            best = {}
            for q, item in zip(*index.search(to_fingerprints(votes))):
                start = int(starts[q])
                s = weighted_similarity(np.unique(own[start : start + width], return_counts=True), sets[item])
                if s >= threshold and (item not in best or (-s, start) < best[item][:2]):
                    best[item] = (-s, start, min(size, n))
            out += [(ids[i], start, words, -s) for i, (s, start, words) in sorted(best.items())]
        return out


def item_blocks(items, id_col, text_col, block_words=BLOCK_WORDS):
    block, size = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "") // 4 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    yield block


def contaminated(docs, items, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", threshold=THRESHOLD, radius=RADIUS, block_words=BLOCK_WORDS):
    """One row a (document, item) with a window at the threshold: ids, ``start_word``,
    ``n_words``, ``similarity`` of the best window (the first of equals)."""
    spark = docs.sparkSession
    id_type, item_type = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (items, item_id)))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {id_type}, item_id {item_type}, start_word bigint, n_words bigint, similarity double"

    def search(shared):
        def run(batches):
            held, codes = Items(shared.value, radius), WordCodes()
            for batch in batches:
                found = [(i, *m) for i, t in enumerate(batch.column(1).to_pylist()) for m in held.matches(codes.of(words_of(t)), threshold)]
                if found:
                    at, ids, start, words, s = zip(*found)
                    item = pa.array(ids, pa.int64()) if item_type in ("bigint", "int") else pa.array(ids)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at, pa.int64())), item.cast(pa.int32()) if item_type == "int" else item, pa.array(start, pa.int64()), pa.array(words, pa.int64()), pa.array(s, pa.float64())],
                        ["doc_id", "item_id", "start_word", "n_words", "similarity"],
                    )

        return texts.mapInArrow(run, schema)

    parts = [search(spark.sparkContext.broadcast(b)) for b in item_blocks(items, item_id, item_text, block_words)]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumnRenamed("doc_id", id_col)


def without_leaks(docs, items, text_col="text", item_id="item_id", item_text="text", threshold=THRESHOLD, radius=RADIUS, block_words=BLOCK_WORDS):
    """The rows of ``docs``, with all their columns, whose text has no such window.  Each row
    is judged by its own text, so null and repeated ids change nothing; no row is shuffled."""

    def clean(shared):
        @F.arrow_udf("boolean")
        def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            held, codes = Items(shared.value, radius), WordCodes()
            for texts in batches:
                yield pa.array([not held.matches(codes.of(words_of(t.as_py())), threshold) for t in texts], pa.bool_())

        return judge

    for block in item_blocks(items, item_id, item_text, block_words):
        docs = docs.filter(clean(docs.sparkSession.sparkContext.broadcast(block))(F.col(text_col)))
    return docs
