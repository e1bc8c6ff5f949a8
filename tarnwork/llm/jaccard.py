"""Exact Jaccard links between documents' sets of word n-grams, and their components.

The document by n-gram incidence matrix is multiplied with its transpose in blocks,
and only where a pair can still reach the threshold:

1. Documents with equal sets form a class, one row of the matrix.
2. N-grams are put into one order for all, by the count of their rarest word (a
   bounded sketch over all texts), rare first.  A pair above the threshold shares a
   column among the first ``|x| - least overlap + 1`` of both, so only these columns are
   multiplied; pairs whose sizes cannot reach the threshold are dropped, and so are pairs
   whose parity bitmaps differ in too many places.
3. A first product takes, in each column, neighbours in size alone, at most one pair an
   entry.  Its links give first components; the second product skips columns inside one component, and
   pairs within one, so large groups of near copies cost no quadratic work.
   Columns with many entries are cut into square blocks of bounded size.  Each block
   gives partial overlaps, which are added up over all columns; a pair is dropped when its
   overlap and the lesser rest of both rows stay below the least overlap of their sizes.
4. For the pairs left, the overlap of the remaining columns is added, block by block,
   with the same bound.

N-grams and sets are told apart by 64 and 128 bit hashes.

Null texts and texts without words have the empty set, which links with nothing.
Rows with equal ids or texts are rows of their own; a null id takes part, but never
names a component.  Empty tables give empty results; other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import WordCodes, mix64, shingle_hashes, small_batches, stage
from .components import components

SKETCH_BITS = 20
BITMAP_WORDS = 8
BLOCK = 20_000


def words_of(text):
    """Words between ASCII blanks, A-Z in lower case, as bytes."""
    return text.encode().lower().split() if text else []


class Counts:
    """log2 of word counts in 2**SKETCH_BITS buckets: an order for words, the same for all."""

    def __init__(self, logs):
        self.logs = logs

    @staticmethod
    def bucket(codes):
        return (mix64(codes) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)

    @classmethod
    def of(cls, docs, text_col):
        def tally(batches):
            codes, total = WordCodes(), np.zeros(1 << SKETCH_BITS, np.int64)
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    if words := words_of(text):
                        np.add.at(total, cls.bucket(codes.of(words)), 1)
            at = np.flatnonzero(total)
            for i in range(0, len(at), 1 << 16):
                part = at[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], ["bucket", "n"])

        rows = docs.select(F.col(text_col)).mapInArrow(tally, "bucket int, n bigint").groupBy("bucket").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("n"))
        logs = np.zeros(1 << SKETCH_BITS, np.uint8)
        with small_batches(docs.sparkSession):
            found = rows.toArrow()  # at most 2**SKETCH_BITS rows
        logs[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
        return cls(logs)

    def order(self, codes, shingles, k):
        """Sort keys of shingles: the log count of the rarest word, then the hash."""
        logs = self.logs[self.bucket(codes)]
        k = min(k, len(codes))
        low = logs[: len(shingles)].copy()
        for j in range(1, k):
            np.minimum(low, logs[j : j + len(shingles)], out=low)
        return low


def least_overlap(n, num, den):
    """Least integer >= n * num / den."""
    return -(-n * num // den)


def shingle_set(text, k, codes):
    return np.unique(shingle_hashes(codes.of(words_of(text)), k))


def parity_bitmap(values):
    """BITMAP_WORDS 64-bit words; bit i is the parity of the values in bucket i."""
    spread = mix64(values + np.uint64(0x51ED27))
    bits = np.bincount((spread % np.uint64(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def describe(docs, id_col, text_col, k, num, den, counts):
    """A row a document: ``doc_id``, ``rid``, ``n``, ``sig``, ``prefix``, ``bitmap``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(counts.logs)  # 2**SKETCH_BITS bytes

    def run(batches):
        import xxhash

        codes, order = WordCodes(), Counts(shared.value)
        for batch in batches:
            n, sig, prefix, bitmap = [], [], [], []
            for text in batch.column(2).to_pylist():
                c = codes.of(words_of(text))
                s = shingle_hashes(c, k)
                if not len(s):
                    n.append(0), sig.append(None), prefix.append(None), bitmap.append(None)
                    continue
                values, first = np.unique(s, return_index=True)
                low = order.order(c, s, k)[first]
                size = len(values)
                take = size - least_overlap(size, num, den) + 1
                # The key itself carries the order, so that equal n-grams always agree.
                key = (low.astype(np.uint64) << np.uint64(58)) | (values >> np.uint64(6))
                prefix.append(np.sort(key)[:take].view(np.int64))
                n.append(size)
                sig.append(xxhash.xxh3_128_digest(values.tobytes()))
                bitmap.append(parity_bitmap(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bitmap, pa.list_(pa.int64()))],
                ["doc_id", "rid", "n", "sig", "prefix", "bitmap"],
            )

    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), _rid(id_col, text_col).alias("rid"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, rid bigint, n bigint, sig binary, prefix array<bigint>, bitmap array<bigint>")


def _rid(id_col, text_col):
    """A hash of id and text: rows that share it are repeated rows."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def candidates_between(pairs, classes, num, den):
    """Pairs (a, b) whose sizes and bitmaps allow the threshold."""
    cols = [F.col("bitmap")[i].alias(f"w{i}") for i in range(BITMAP_WORDS)]
    side = classes.select("cid", "n", *cols)
    a = side.select(F.col("cid").alias("a"), F.col("n").alias("na"), *(F.col(f"w{i}").alias(f"a{i}") for i in range(BITMAP_WORDS)))
    b = side.select(F.col("cid").alias("b"), F.col("n").alias("nb"), *(F.col(f"w{i}").alias(f"b{i}") for i in range(BITMAP_WORDS)))
    differ = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(1, BITMAP_WORDS)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    both = F.col("na") + F.col("nb")
    return pairs.join(a, "a").join(b, "b").filter(differ <= both - 2 * F.expr(f"((na + nb) * {num} + {den + num - 1}) div {den + num}")).select("a", "b")


def reaches(p, q, num, den, blocks=4):
    """Whether the overlap of two rows of the matrix (sorted columns) reaches the threshold:
    it is added up over blocks of columns, until the rest cannot make up for what is missing."""
    need, overlap = least_overlap(len(p) + len(q), num, den + num), 0
    if min(len(p), len(q)) < need:
        return False
    borders = (np.arange(1, blocks, dtype=np.uint64) << np.uint64(62)).tolist()
    cut_p, cut_q = ([0, *np.searchsorted(v, np.array(borders, np.uint64)).tolist(), len(v)] for v in (p, q))
    for k in range(blocks):
        x, y = p[cut_p[k] : cut_p[k + 1]], q[cut_q[k] : cut_q[k + 1]]
        if len(x) and len(y):
            overlap += int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        if overlap + min(len(p) - cut_p[k + 1], len(q) - cut_q[k + 1]) < need:
            return False
    return True


def verify(pairs, classes, docs, id_col, text_col, k, num, den):
    """Those of the pairs (a, b) whose whole sets reach the threshold."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    owners = stage(classes.select("cid", "rid", "sig").join(needed, "cid", "left_semi"), "jaccard-owners")
    # Staged, so that the planner knows its size: below its threshold no text is shuffled.
    ids = stage(owners.select("rid").distinct(), "jaccard-ids")

    def sets(batches):
        import xxhash

        codes = WordCodes()
        for batch in batches:
            got = [shingle_set(t, k, codes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(g) for g in got], pa.binary()), pa.array(got, pa.binary())], ["rid", "sig", "grams"])

    texts = docs.select(_rid(id_col, text_col).alias("rid"), F.col(text_col).alias("text")).join(ids, "rid", "left_semi")
    found = texts.mapInArrow(sets, "rid bigint, sig binary, grams binary")
    grams = stage(found.join(owners, ["rid", "sig"]).dropDuplicates(["cid"]).select("cid", "grams"), "gram-sets")

    def overlap(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                keep.append(reaches(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den))
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    joined = pairs.select("a", "b").join(grams.select(F.col("cid").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("cid").alias("b"), F.col("grams").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(overlap, "a bigint, b bigint")


def cross_pairs(entries, classes, num, den, block=BLOCK):
    """Pairs (a, b) of the column products, between components only, that can still reach the
    threshold: overlaps add up over the columns; behind the last column that was counted a
    pair can gain no more than the lesser rest of both rows."""
    partial = partial_overlaps(entries, classes, num, den, block)
    total = partial.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("overlap").alias("overlap"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    return total.filter(f"overlap + least(na - 1 - pa, nb - 1 - pb) >= ((na + nb) * {num} + {den + num - 1}) div {den + num}").select("a", "b")


def partial_overlaps(entries, classes, num, den, block):
    """Overlaps of pairs in blocks of columns: ``a``, ``b``, ``na``, ``nb``, ``overlap``, and
    the last places ``pa``, ``pb`` that it counts.  ``entries``: ``key``, ``cid``, ``n``, ``pos``,
    ``comp``.  Columns so far back in either row that the pair could not reach the threshold
    if it were the first shared one are not counted: the bound covers what is behind."""
    w = Window.partitionBy("key")
    busy = (
        entries.withColumn("m", F.count(F.lit(1)).over(w))
        .withColumn("lo", F.min("comp").over(w))
        .withColumn("hi", F.max("comp").over(w))
        .filter("m > 1 and lo != hi")
        .withColumn("s", F.expr(f"cast((m + {block - 1}) div {block} as int)"))
        .withColumn("t", F.pmod(F.xxhash64("cid"), F.col("s")).cast("int"))
        # The square block (i, j), i <= j, multiplies strips i and j of the column.
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
        .select("key", F.least("t", "other").alias("i"), F.greatest("t", "other").alias("j"), "t", "n", "cid", "pos", "comp")
    )
    words = [f"w{i}" for i in range(BITMAP_WORDS)]
    busy = busy.join(classes.select("cid", *(F.col("bitmap")[i].alias(w) for i, w in enumerate(words))), "cid").select("key", "i", "j", "t", "n", "cid", "pos", "comp", *words)
    dealt = busy.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "cid")

    def products(batches):
        held, found = None, []
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            cut = new[-1] if len(new) else 0
            held = [c[cut:] for c in cols]
            if cut:
                yield from multiply([c[:cut] for c in cols], found)
        if held is not None:
            yield from multiply(held, found)
        if found:
            yield batch_of(found)

    def multiply(cols, found):
        """Adds the pairs of these columns to ``found``; gives it away when it is large."""
        key, i, j, t, n, cid, pos, comp, *bits = cols
        size = len(key)
        if size < 2:
            return
        group = np.concatenate([[0], np.cumsum((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))])
        at, step = np.arange(size - 1), 1
        while len(at):
            at = at[at + step < size]
            b = at + step
            ok = (group[at] == group[b]) & (den * n[at] >= num * n[b])  # n grows inside a group
            at, b = at[ok], b[ok]
            need = -(-(n[at] + n[b]) * num // (den + num))
            # A pair of one strip belongs to the diagonal block alone.
            good = (comp[at] != comp[b]) & ((t[at] != t[b]) | (i[at] == j[at])) & (np.minimum(n[at] - pos[at], n[b] - pos[b]) >= need)
            x, y, need = at[good], b[good], need[good]
            x, y = np.where(cid[x] < cid[y], x, y), np.where(cid[x] < cid[y], y, x)
            differ = sum(np.bitwise_count((w[x] ^ w[y]).view(np.uint64)).astype(np.int64) for w in bits)
            close = differ <= n[x] + n[y] - 2 * need
            if close.any():
                x, y = x[close], y[close]
                found.append(np.stack([cid[x], cid[y], n[x], n[y], pos[x], pos[y]]))
            if sum(f.shape[1] for f in found) > 300_000 or len(found) > 1000:
                yield batch_of(found)
                found.clear()
            step += 1

    def batch_of(found):
        """One row a pair, with its partial overlap and the last places it was found at."""
        a, b, na, nb, pa_, pb = np.concatenate(found, axis=1)
        order = np.lexsort((pa_, b, a))
        a, b, na, nb, pa_, pb = (v[order] for v in (a, b, na, nb, pa_, pb))
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        last = np.append(first[1:], len(a)) - 1
        cols = (a[first], b[first], na[first], nb[first], last - first + 1, np.maximum.reduceat(pa_, first), np.maximum.reduceat(pb, first))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b", "na", "nb", "overlap", "pa", "pb"])

    return dealt.mapInArrow(products, "a bigint, b bigint, na bigint, nb bigint, overlap bigint, pa bigint, pb bigint")


def jaccard_groups(docs, k=3, num=90, den=100, id_col="doc_id", text_col="text", block=BLOCK):
    """One row a document: ``doc_id``, ``rid`` (a hash of id and text), ``n``, ``comp`` (a
    number of its component; null without words), ``component_id``."""
    counts = Counts.of(docs, text_col)
    described = stage(describe(docs, id_col, text_col, k, num, den, counts), "jaccard-docs")
    full = described.filter("n > 0")
    classes = full.groupBy("sig").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid"))
    shape = full.select("sig", "rid", "n", "prefix", "bitmap").join(classes, ["sig", "rid"]).dropDuplicates(["sig"])
    classes = stage(shape.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")

    # First product: each entry of a column with the one before it.  Rows of one size are
    # ordered by another hash in each column, so that a row meets other rows in each.
    # Columns of one entry give no pair; the others are staged for both products.
    entries = classes.select("cid", "n", F.posexplode("prefix").alias("pos", "key"))
    shared = entries.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("m > 1")
    shared = stage(shared.select("key", "cid", "n", "pos"), "jaccard-entries")
    near = Window.partitionBy("key").orderBy("n", F.xxhash64("cid", "key"), "cid")
    first = shared.withColumn("a", F.lag("cid").over(near)).withColumn("m", F.lag("n").over(near)).withColumn("q", F.lag("pos").over(near)).filter(f"a is not null and {den} * m >= {num} * n")
    first = first.filter(f"least(n - pos, m - q) >= ((n + m) * {num} + {den + num - 1}) div {den + num}")
    first = first.select(F.least("a", "cid").alias("a"), F.greatest("a", "cid").alias("b")).distinct()
    pairs = stage(candidates_between(first, classes, num, den), "jaccard-pairs")
    links = stage(verify(pairs, classes, docs, id_col, text_col, k, num, den), "jaccard-links")
    labels = components(links).select(F.col("node").alias("cid"), F.col("root").alias("comp"))

    # Second product: all columns that can matter, between first components.
    marked = shared.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    second = stage(cross_pairs(marked, classes, num, den, block), "jaccard-pairs")
    links = links.unionByName(stage(verify(second, classes, docs, id_col, text_col, k, num, den), "jaccard-links"))

    labels = components(links).select(F.col("node").alias("cid"), F.col("root").alias("comp"))
    members = stage(classes.select("sig", "cid", "least").join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "jaccard-members")
    heads = members.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = members.join(heads, "comp").select("sig", "comp", "component_id")
    return described.select("doc_id", "rid", "n", "sig").join(named, "sig", "left").select("doc_id", "rid", "n", "comp", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs, k=3, num=90, den=100, id_col="doc_id", text_col="text", block=BLOCK):
    """One row a document: id, ``n_shingles``, ``component_id`` (the least id that links reach)."""
    found = jaccard_groups(docs, k, num, den, id_col, text_col, block)
    return found.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def first_of_components(docs, k=5, num=80, den=100, id_col="doc_id", text_col="text", block=BLOCK):
    """One row of ``docs``, with all its columns, of each component: the least by id (nulls
    last), then by hash of id and text.  Rows without words have no component and all stay."""
    found = stage(jaccard_groups(docs, k, num, den, id_col, text_col, block).select("doc_id", "rid", "comp"), "jaccard-found")
    first = found.filter("comp is not null").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")).alias("f"))
    keep = first.select("f.doc_id", "f.rid", F.lit(True).alias("one")).unionByName(found.filter("comp is null").select("doc_id", "rid", F.lit(False).alias("one")).distinct())
    keep = stage(keep, "jaccard-keep")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), _rid(id_col, text_col).alias("rid"))
    kept = rows.join(keep.select(F.col("doc_id").alias("d"), "rid", "one"), "rid").filter(F.col("doc_id").eqNullSafe(F.col("d")))
    # Of repeated rows one stays; the join has dealt them by ``rid`` already.
    again = Window.partitionBy("rid", "doc_id").orderBy("one")
    return kept.withColumn("place", F.row_number().over(again)).filter("place = 1 or not one").select("row.*")
