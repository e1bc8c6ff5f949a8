"""Vectors as short codes: a small codebook for each part of them, found by exact rounds.

Components become integers (floor of ``scale`` times the component), vectors are cut into
equal consecutive parts, and each part is coded as the nearest entry of its position's
codebook.  A codebook starts as that part of the vectors of the smallest ids; each round
assigns all parts and moves each entry to the componentwise floor of its parts' mean.

The nearest entry comes from memoised grid cells.  A part's coarse cell (its components
divided by the position's cell width) is the key of a table in the task that remembers
which entries can be nearest anywhere in the cell's box: an entry is dominated, and left
out, if its least distance to the box is greater than some other entry's greatest one.
Only the entries that stay are evaluated, exactly, with ties to the lower index.  The cell
width follows from the codebook; it decides how much is saved, never the result.

A round is one job: tasks add up their parts for each entry, Spark sums these up, and the
driver reads the sums (entries x dimension numbers, whatever the rows).  Sums travel in
limbs of 40 bits, so they are exact for any finite input.  Components whose integer is
2**26 or more in size are worked out with Python's integers.

Rows whose vector is null or holds null, NaN or infinite components are dropped.  The
dimension is that of the first kept vector (by id, nulls last, then by vector) whose length
``parts`` divides; kept rows of another length stay, with null code and error, and belong to
no codebook.  Fewer kept rows than entries make smaller codebooks.  Null, equal and repeated
ids are rows like others.  Errors beyond 64 bits are null.  Null labels are one label, and a
label's error is the sum of its rows' errors, null where one is beyond 64 bits.  An empty
table gives an empty result.  Other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import partitions, stage

SMALL = 1 << 26  # squares of differences of such integers add up in 64 bits (512 components a part)
LIMB = 40
CELLS = 1 << 16  # remembered cells of each position
BROADCAST_LABELS = 100_000


def cell_width(book):
    """A quarter of the median distance between an entry and its nearest other one, as the
    side of a cube with that diagonal."""
    b = np.clip(book.astype(object), -SMALL, SMALL).astype(float)  # wider cells than that are not needed
    gaps = ((b[:, None] - b[None]) ** 2).sum(-1)
    gaps[gaps == 0] = np.inf
    near = np.sqrt(gaps.min(1)) if len(b) else np.array([np.inf])
    near = near[np.isfinite(near)]
    return int(max(1, min(SMALL, np.median(near) / 2 / np.sqrt(b.shape[1])))) if len(near) else SMALL


class Grid:
    """The nearest entries of one position's codebook (entries x components, integers)."""

    def __init__(self, book, width=None, cells=CELLS):
        self.wide = bool(book.size) and max(abs(int(x)) for x in book.ravel()) >= SMALL
        self.book = book.astype(object) if self.wide else book.astype(np.int64)
        self.width, self.cells = width or cell_width(book), cells
        self.rows, self.table = {}, np.zeros((0, len(book)), bool)

    def candidates(self, cell):
        """Which entries can be nearest in the box of each of these cells."""
        low = (cell.astype(object) if self.wide else cell.astype(np.int64))[:, None] * self.width
        high, book = low + (self.width - 1), self.book[None]
        least = np.maximum(np.maximum(low - book, book - high), 0)
        most = np.maximum(abs(book - low), abs(book - high))
        least, most = (least * least).sum(-1), (most * most).sum(-1)
        return (least <= most.min(1, keepdims=True)).astype(bool)

    def masks(self, values):
        """A row of ``candidates`` for each part."""
        cell = np.floor_divide(values, self.width).astype("<i4")
        keys = cell.view(f"V{cell.shape[1] * 4}").ravel().tolist()
        found = [self.rows.get(k, -1) for k in keys]
        new = {}
        for n, (k, at) in enumerate(zip(keys, found)):
            if at < 0:
                new.setdefault(k, n)
        if len(self.rows) + len(new) > self.cells:
            self.rows, self.table = {}, self.table[:0]
            new = {k: n for n, k in reversed(list(enumerate(keys)))}
        if new:
            first = len(self.table)
            self.table = np.concatenate([self.table, self.candidates(cell[list(new.values())])])
            self.rows.update(zip(new, range(first, first + len(new))))
            found = list(map(self.rows.__getitem__, keys))
        return self.table[found]

    def nearest(self, values):
        """(entry, squared distance) of each part; ``values`` is int64 or object."""
        if values.dtype == object:
            mask = np.ones((len(values), len(self.book)), bool)  # no cell
        else:
            mask = self.masks(values)
        part, entry = np.nonzero(mask)
        gap = values[part] - self.book[entry]
        distance = (gap * gap).sum(1)
        starts = np.concatenate([[0], np.cumsum(mask.sum(1))])
        least = np.minimum.reduceat(distance, starts[:-1])
        at = np.flatnonzero(distance == np.repeat(least, np.diff(starts)))  # ascending in part, then entry
        first = at[np.concatenate([[True], part[at][1:] != part[at][:-1]])]
        return entry[first], least


def integers(flat, scale):
    """floor(scale * x) of float64 values: int64, or object if one is too large for that."""
    if len(flat) == 0 or np.abs(flat).max() < SMALL / scale:
        return np.floor(flat * scale).astype(np.int64)
    out = np.empty(len(flat), object)
    for i, x in enumerate(flat.tolist()):
        top, below = x.as_integer_ratio()
        out[i] = top * scale // below
    return out


def _blocks(batch, column, dims, parts, scale):
    """(row numbers, parts as rows x parts x components) of a batch's vectors of length
    ``dims``: those within 64 bits, and the others."""
    lists = batch.column(column)
    fit = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == dims) if dims else []
    if not len(fit):
        return
    flat = lists.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    large = (np.abs(flat) >= (SMALL - 1) / scale).any(1)
    for chosen in (~large, large):
        if chosen.any():
            yield fit[chosen], integers(flat[chosen].ravel(), scale).reshape(-1, parts, dims // parts)


class VectorCodes:
    """The fitted codebooks: ``books`` is a list of integer arrays (entries x components), one
    a part."""

    def __init__(self, rows, dims, books, parts, scale):
        self.rows, self.dims, self.books, self.parts, self.scale = rows, dims, books, parts, scale

    def digest(self):
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()

    def _assigned(self, extra, schema, handle):
        """mapInArrow over the staged rows; ``handle(batch, blocks)`` gives record batches,
        blocks being (row numbers, parts, entries, distances)."""
        dims, parts, scale = self.dims, self.parts, self.scale
        books = self.rows.sparkSession.sparkContext.broadcast(self.books)

        def run(batches):
            grids = [Grid(b) for b in books.value]

            def blocks(batch):
                for at, values in _blocks(batch, batch.num_columns - 1, dims, parts, scale):
                    found = [grid.nearest(values[:, p]) for p, grid in enumerate(grids)]
                    yield at, values, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

            yield from handle(batches, blocks)

        return self.rows.select(*extra, "vector").mapInArrow(run, schema)

    def sums(self):
        """Sums and counts of the parts of each entry: {(part, entry): (count, [sums])}."""
        parts, width = self.parts, self.dims // self.parts
        sizes = [len(b) for b in self.books]

        def handle(batches, blocks):
            total = [np.zeros((n, width + 1), object) for n in sizes]
            for batch in batches:
                for _, values, entry, _ in blocks(batch):
                    for p in range(parts):
                        for e in np.unique(entry[:, p]):
                            chosen = values[entry[:, p] == e, p]
                            total[p][e, :width] += chosen.sum(0).astype(object)
                            total[p][e, width] += len(chosen)
            out = []
            for p in range(parts):
                for (e, at), x in np.ndenumerate(total[p]):
                    x, sign, limb = abs(int(x)), -1 if x < 0 else 1, 0
                    while x:
                        out.append((p, e, at, limb, sign * (x & ((1 << LIMB) - 1))))
                        x, limb = x >> LIMB, limb + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int32()] * 4 + [pa.int64()])], ["part", "entry", "place", "limb", "total"])

        partial = self._assigned([], "part int, entry int, place int, limb int, total bigint", handle)
        out = {}
        for r in partial.groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total")).collect():
            held = out.setdefault((r["part"], r["entry"]), [0] * (width + 1))
            held[r["place"]] += r["total"] << (LIMB * r["limb"])
        return {k: (v[width], v[:width]) for k, v in out.items()}

    def move(self):
        """One round."""
        books = [b.astype(object) for b in self.books]
        for (p, e), (count, sums) in self.sums().items():
            books[p][e] = [s // count for s in sums]
        self.books = books

    def coded(self):
        """The rows with ``code`` (two hex digits a part) and ``error``; other lengths have nulls."""

        def handle(batches, blocks):
            for batch in batches:
                code, error = [None] * batch.num_rows, [None] * batch.num_rows
                for at, _, entry, distance in blocks(batch):
                    shown = entry.astype("u1").tobytes().hex()
                    width = 2 * entry.shape[1]
                    for n, (i, d) in enumerate(zip(at.tolist(), distance.tolist())):
                        d = sum(map(int, d))
                        code[i], error[i] = shown[n * width : (n + 1) * width], d if d < 1 << 63 else None
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

        kinds = {f.name: f.dataType.simpleString() for f in self.rows.schema}
        return self._assigned(["vec_id", "label"], f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint", handle)


def fit(vectors, id_col="vec_id", vector_col="embedding", label_col="label", parts=8, entries=16, rounds=6, scale=4096):
    """Codebooks of all kept vectors after ``rounds`` rounds."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part")
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    kept = vectors.filter(F.col(vector_col).isNotNull()).filter(finite)
    rows = stage(kept.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("vector")), "vectors")
    usable = rows.filter((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector")]
    first = usable.orderBy(*order).limit(1).collect()
    dims = len(first[0]["vector"]) if first else 0
    start = rows.filter(F.size("vector") == dims).orderBy(*order).limit(entries).collect() if dims else []
    width = dims // parts
    whole = np.array([[int(x) for x in integers(np.array(r["vector"]), scale)] for r in start], object).reshape(len(start), parts, width)
    codes = VectorCodes(rows, dims, [whole[:, p] for p in range(parts)], parts, scale)
    for _ in range(rounds if dims else 0):
        codes.move()
    return codes


def compress(vectors, id_col="vec_id", vector_col="embedding", label_col="label", **settings):
    """One row a kept vector: id, ``code``, ``error``, ``label_error`` (of all rows with its
    label) and ``codebooks_sha256``."""
    codes = fit(vectors, id_col, vector_col, label_col, **settings)
    coded = stage(codes.coded(), "vector-codes")
    broken = F.max(F.col("code").isNotNull() & F.col("error").isNull())
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), broken.alias("broken"))
    sums = stage(sums.select(F.col("label").alias("own_label"), F.when(~F.col("broken"), F.expr("try_cast(s as bigint)")).alias("label_error")), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("own_label")))
    else:
        # Each label's sum goes to as many places as its rows are dealt to.
        places = partitions(vectors.sparkSession)
        dealt = coded.withColumn("place", F.pmod(F.xxhash64("vec_id", "code"), F.lit(places)))
        copies = sums.withColumn("own_place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
        joined = dealt.join(copies, F.col("label").eqNullSafe(F.col("own_label")) & (F.col("place") == F.col("own_place")))
    return joined.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))
