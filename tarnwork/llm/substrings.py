"""Removal of long byte strings that occur more than once, with a run-length BWT.

Every window of ``length`` bytes has an anchor: the leftmost GRAM-byte string in it of
least hash.  Equal windows have equal anchors, so the corpus falls apart by anchors, and
windows that follow each other with one anchor form a segment.  Segments of anchors
that occur once are done.  Segments that are equal byte for byte are one row with a
count: they would share every run of the index.

Where an anchor has several different segments, these are indexed: the Burrows-Wheeler
transform is kept as runs (symbol, length) with the text places at both ends of each,
and nothing else of the suffix order.  Matches are measured at these places only, and
matching statistics stream from there through the text (inside a run the match of the
next position is one shorter); a match of ``length`` or more starts a repeated window.

An index holds the groups of about ``block_bytes``.  A group beyond that is dealt anew,
and exactly: windows are told apart by where the anchor stands in them, in classes of half
the width each round, and by a hash of the bytes that all windows of a class share.  Equal
windows stay together, and at the width of one the bytes are the whole window.

A null text is empty.  Texts shorter than ``length`` have no windows.  Rows that repeat
are copies of each other.  An empty table gives an empty result; other columns are ignored.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import mix64, partitions, stage

GRAM = 64
PIECE = 1 << 20
BLOCK_BYTES = 1 << 19


def segments(raw, length):
    """(anchor, start, count, place of the anchor behind start) arrays: runs of window
    starts with one anchor."""
    out = [_segments(raw[a : a + PIECE + length - 1], length, a) for a in range(0, max(1, len(raw) - length + 1), PIECE)] if len(raw) >= length else []
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _segments(raw, length, base):
    n, gram = len(raw), min(GRAM, length)
    load = lambda at: np.ndarray(n - gram + 1, "<u8", raw, at, (1,))
    h = load(0) * np.uint64(0x9E3779B97F4A7C15)
    for at in sorted({*range(8, gram - 7, 8), gram - 8}):
        h = (h ^ (h >> np.uint64(29))) + load(at)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h = mix64(h)
    # The least hash of each window, with its place in the low bits.
    place = np.uint64(23)
    least = (h >> place << place) | np.arange(len(h), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    at = (least & np.uint64((1 << 23) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([first, [len(at)]]))
    return h[at[first]].view(np.int64), first + base, count, at[first] - first


def suffix_array(text, gaps):
    """Order of the suffixes of a byte array; ``gaps`` marks separators, which sort before
    all bytes and among themselves by place, and end the suffixes before them."""
    n, width = len(text), 7
    symbols = np.zeros(n + width, np.uint64)
    symbols[:n] = np.where(gaps, 0, text.astype(np.uint64) + np.uint64(1))
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key = (key << np.uint64(9)) | symbols[j : j + n]
    to_gap = (np.minimum.accumulate(np.where(gaps, np.arange(n), n)[::-1])[::-1] - np.arange(n)).astype(np.int32)
    # Nothing behind a separator may take part in a key.
    drop = np.uint64(9) * (width - np.minimum(to_gap, width)).astype(np.uint64)
    key = key >> drop << drop
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    slots, have = np.flatnonzero(~(head & np.append(head[1:], True))), width
    while len(slots):
        t = order[slots]
        # Suffixes that ended by now are told apart by place.
        behind = np.where(to_gap[t] < have, t, n + rank[np.minimum(t + have, n - 1)].astype(np.int64))
        pair = rank[t].astype(np.int64) * (2 * n) + behind
        o = np.argsort(pair)
        t, pair = t[o], pair[o]
        head = np.concatenate([[True], pair[1:] != pair[:-1]])
        order[slots] = t
        rank[t] = slots[np.maximum.accumulate(np.where(head, np.arange(len(t)), 0))]
        slots = slots[~(head & np.append(head[1:], True))]
        have *= 2
    return order


class RunLengthIndex:
    """Runs of the BWT of some byte strings, with the text places of both ends of each run.

    ``symbols`` (0 stands for a separator, else the byte plus 1), ``lengths``, ``first`` and
    ``last`` have an entry a run.  The suffix above a run's first is the last of the run before."""

    def __init__(self, parts):
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        self.starts, self.n = np.cumsum(sizes) - sizes, int(sizes.sum())
        self.gaps_at = self.starts + sizes - 1
        self.text = np.frombuffer(b"\0".join(parts) + bytes(9), np.uint8)
        gaps = np.zeros(self.n, bool)
        gaps[self.gaps_at] = True
        order = suffix_array(self.text[: self.n], gaps)
        bwt = np.where(gaps[order - 1], 0, self.text[: self.n][order - 1].astype(np.uint16) + 1)
        # Separators differ from each other, so each is a run.
        heads = np.concatenate([[0], np.flatnonzero((bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)) + 1])
        self.symbols, self.lengths = bwt[heads], np.diff(np.append(heads, self.n)).astype(np.int32)
        self.first, self.last = order[heads], order[np.append(heads[1:], self.n) - 1]
        self.n_runs = len(heads)

    def common(self, a, b):
        """Length of the common prefix of the suffixes at a and b, up to a separator; 0 for b < 0."""
        room = lambda x: self.gaps_at[np.searchsorted(self.gaps_at, x)] - x
        limit = np.where(b >= 0, np.minimum(room(a), room(np.maximum(b, 0))), 0)
        words = np.ndarray(self.n + 1, "<u8", self.text, 0, (1,))
        out, live, step = limit.copy(), np.flatnonzero(limit > 0), 0
        while len(live):
            x = words[a[live] + step] ^ words[b[live] + step]
            ends = x != 0
            low = x[ends] & (~x[ends] + np.uint64(1))
            at = live[ends]
            out[at] = np.minimum(limit[at], step + np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
            step += 8
            live = live[~ends]
            live = live[limit[live] > step]
        return out

    def matching_statistics(self):
        """For each position the longest match with another place, streamed from the run ends."""
        best = np.zeros(self.n, np.int64)
        none, every = np.full(1, -1, self.first.dtype), np.arange(self.n)
        for at, other in ((self.first, np.concatenate([none, self.last[:-1]])), (self.last, np.concatenate([self.first[1:], none]))):
            value, since = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
            since[at] = at
            value[at] = self.common(at.astype(np.int64), other.astype(np.int64))
            since = np.maximum.accumulate(since)
            best = np.maximum(best, value[since] - (every - since))
        return best

    def repeated(self, length):
        """For each string a bool array over its positions: a match of ``length`` starts here."""
        hit = self.matching_statistics() >= length
        return [hit[a:b] for a, b in zip(self.starts, self.gaps_at)]

    def restored(self):
        """The strings, read backwards from the runs alone by last-to-first steps."""
        begins = np.cumsum(self.lengths) - self.lengths
        by = np.argsort(self.symbols, kind="stable")
        to = np.empty(self.n_runs, np.int64)
        to[by] = np.cumsum(self.lengths[by]) - self.lengths[by]  # row of a run's first symbol in sorted order
        out = []
        for row in range(len(self.starts)):
            got = bytearray()
            while True:
                run = int(np.searchsorted(begins, row, "right")) - 1
                if not self.symbols[run]:
                    break
                got.append(int(self.symbols[run]) - 1)
                row = int(to[run] + row - begins[run])
            out.append(bytes(got[::-1]))
        return out


def runs_of(flags):
    """[(from, to)] of the true stretches."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


KEY = ["doc_id", "tk"]
RUNS = "array<struct<a:int,b:int>>"
RUNS_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
PIECES = "key bigint, piece bigint, m bigint, off int, bytes binary, anchor bigint, seg bigint, shift int"


def _keys(id_col, text_col):
    return [F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tk")]


def occurrences(docs, length, id_col, text_col):
    """A row a segment: its document, place, anchor and content hash."""
    texts = docs.select(*_keys(id_col, text_col), F.col(text_col).cast("binary").alias("raw")).filter(F.octet_length("raw") >= length)
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            at, found, hashes, held = [], [], [], 0

            def flush():
                take = pa.array(np.repeat(np.array([i for i, _ in at]), [k for _, k in at]), pa.int64())
                anchor, start, count, off = (np.concatenate(x) for x in zip(*found))
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor, pa.int64()), pa.array(np.array(hashes, np.uint64).view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (start, count, off))],
                    ["doc_id", "tk", "anchor", "seg", "start", "n", "off"],
                )

            for i, value in enumerate(batch.column(2)):
                raw = value.as_py()
                got = segments(raw, length)
                at.append((i, len(got[0]))), found.append(got)
                hashes += [digest(raw[x:y]) for x, y in zip(got[1].tolist(), (got[1] + got[2] + (length - 1)).tolist())]
                held += len(got[0])
                if held > 50_000:
                    yield flush()
                    at, found, hashes, held = [], [], [], 0
            if held:
                yield flush()

    return texts.mapInArrow(run, f"doc_id {id_type}, tk bigint, anchor bigint, seg bigint, start int, n int, off int")


def cut_out(docs, distinct, length, id_col, text_col):
    """The bytes of one place of each of these segments, as pieces of one group an anchor."""
    wanted = distinct.groupBy(*(F.col(f"at.{k}").alias(k) for k in KEY)).agg(F.collect_list(F.struct("anchor", "seg", "m", "n", "off", "at.start")).alias("segs"))
    texts = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text"))

    def cut(batches):
        def batch_of(rows):
            anchor, seg, m, off, raw = zip(*rows)
            big = lambda x: pa.array(x, pa.int64())
            return pa.RecordBatch.from_arrays(
                [big(anchor), big(seg), big(m), pa.array(off, pa.int32()), pa.array(raw, pa.binary()), big(anchor), big(seg), pa.array([0] * len(rows), pa.int32())],
                ["key", "piece", "m", "off", "bytes", "anchor", "seg", "shift"],
            )

        for batch in batches:
            rows, held = [], 0
            for text, segs in zip(batch.column(0), batch.column(1)):
                raw = text.as_py().encode()
                for s in segs.as_py():
                    rows.append((s["anchor"], s["seg"], s["m"], s["off"], raw[s["start"] : s["start"] + s["n"] + length - 1]))
                    held += s["n"] + length
                if held > 4 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    same = [texts[k].eqNullSafe(wanted[k]) for k in KEY]
    # Rows with one id and text give the same bytes again; groups drop what repeats.
    return texts.join(wanted, same).select("text", "segs").mapInArrow(cut, PIECES)


def indexed_runs(pieces, length, block_bytes):
    """Repeated window starts by the index: ``anchor``, ``seg``, ``runs``.  Pieces of a ``key``
    are a group; pieces equal in ``key`` and ``piece`` are one string found in several places."""

    def run(batches):
        held, size, last = [], 0, None

        def flush():
            out = []
            for (raw, roots), flags in zip(held, RunLengthIndex([h[0] for h in held]).repeated(length)):
                runs = runs_of(flags) if sum(roots.values()) == 1 else [(0, len(raw) - length + 1)]
                out += [(a, s, [{"a": x + shift, "b": y + shift} for x, y in runs]) for a, s, shift in roots if runs]
            held.clear()
            if out:
                a, s, r = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(r, RUNS_ARROW)], ["anchor", "seg", "runs"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                for key, piece, m, _, raw, *root in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                    if last != (key, piece):
                        if size >= block_bytes and key != last[0]:
                            yield from flush()
                            size = 0
                        held.append((raw, {}))
                        size += len(raw) + 1
                        last = (key, piece)
                    held[-1][1][tuple(root)] = m
        if held:
            yield from flush()

    names = [f.split()[0] for f in PIECES.split(", ")]
    dealt = pieces.select(names).repartition(partitions(pieces.sparkSession), "key").sortWithinPartitions("key", "piece")
    return dealt.mapInArrow(run, f"anchor bigint, seg bigint, runs {RUNS}")


def refined(pieces, length, width):
    """The pieces cut by the place of the anchor in their windows, ``width`` places a class,
    in groups of one class whose windows share the same bytes."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        names = [f.split()[0] for f in PIECES.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            rows, held = [], 0
            for key, _, m, off, raw, anchor, seg, shift in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(raw) - length + 1
                for c in range((off - n + 1) // width, off // width + 1):
                    a, b = max(0, off - (c + 1) * width + 1), min(n - 1, off - c * width)
                    shared = raw[off - c * width : off - (c + 1) * width + 1 + length]
                    own = raw[a : b + length]
                    group = digest(shared, seed=(key * 0x9E3779B97F4A7C15 + c) & (1 << 64) - 1)
                    rows.append((signed(group), signed(digest(own)), m, off - a, own, anchor, seg, shift + a))
                    held += len(own)
                if held > 4 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return pieces.mapInArrow(run, PIECES)


def settled(pieces, length, block_bytes):
    """Repeated window starts of the pieces' segments, whatever the size of their groups.
    ``pieces`` has the ``size`` of each group as a column."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    found, large, width = [indexed_runs(pieces.filter(F.col("size") <= block_bytes), length, block_bytes)], pieces.filter(F.col("size") > block_bytes), length - min(GRAM, length) + 1
    while width > 1 and not large.isEmpty():
        width = -(-width // 2)
        cut = stage(refined(large.select(names), length, width), "segments-refined")
        groups = stage(cut.groupBy("key").agg(F.sum("m").alias("total"), F.sum(F.octet_length("bytes") + 1).alias("size")).filter("total > 1").select("key", "size"), "segments-groups")
        cut = stage(cut.join(groups, "key"), "segments-refined")
        found.append(indexed_runs(cut.filter(F.col("size") <= block_bytes), length, block_bytes))
        large = cut.filter(F.col("size") > block_bytes)
    if width == 1:  # what is left are equal windows
        found.append(large.select("anchor", "seg", F.array(F.struct(F.col("shift").alias("a"), (F.col("shift") + 1).alias("b"))).cast(RUNS).alias("runs")))
    return reduce(lambda a, b: a.unionByName(b), found)


def repeated_spans(docs, length=200, id_col="doc_id", text_col="text", block_bytes=BLOCK_BYTES):
    """A row for each document with repeated windows: ``doc_id``, ``tk`` (a hash of the text),
    ``spans``: [from, to) of window starts, not merged."""
    all_of = stage(occurrences(docs, length, id_col, text_col), "segments-all")
    twice = stage(all_of.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("anchor"), "segments-anchors")
    # Each join on anchors reads two staged tables and is staged itself, so that skewed ones are split.
    kept = stage(all_of.join(twice, "anchor", "left_semi"), "segments")
    at = F.struct(*KEY, "start")
    distinct = stage(kept.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("n"), F.min("off").alias("off"), F.min(at).alias("at")), "segments-distinct")
    groups = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("d"), F.min("m").alias("least"), F.sum(F.col("n") + length).cast("bigint").alias("size"))
    mixed = stage(groups.filter("d > 1 and least = 1").select("anchor", "size"), "segments-mixed")
    several = stage(distinct.join(mixed, "anchor", "left_semi"), "segments-several")
    pieces = stage(cut_out(docs, several, length, id_col, text_col), "segments-cut")
    pieces = pieces.join(mixed, "anchor")
    copies = distinct.filter("m > 1").select("anchor", "seg", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).cast(RUNS).alias("runs"))
    # Segments with copies are repeated as a whole, whatever the index says of them.
    single = settled(stage(pieces, "segments-pieces"), length, block_bytes).join(copies.select("anchor", "seg"), ["anchor", "seg"], "left_anti")
    runs = stage(single.select("anchor", "seg", "runs").unionByName(copies), "segments-runs")
    hits = kept.join(runs, ["anchor", "seg"]).select(*KEY, F.transform("runs", lambda r: F.struct((F.col("start") + r["a"]).alias("a"), (F.col("start") + r["b"]).alias("b"))).alias("r"))
    return hits.groupBy(*KEY).agg(F.flatten(F.collect_list("r")).alias("spans"))


def merged(spans, length):
    """Maximal removed byte runs of window start spans."""
    out = []
    for a, b in sorted((s["a"], s["b"] + length - 1) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


CUT = "n_removed bigint, n_spans bigint, kept_sha256 string, kept "


def cut_texts(docs, length=200, id_col="doc_id", text_col="text", block_bytes=BLOCK_BYTES, as_text=False):
    """The rows of ``docs`` as a struct ``row``, and ``cut``: a struct of CUT for texts with
    repeated strings, else null.  ``kept`` is binary or, with ``as_text``, a string without the
    characters that a cut broke.  Only texts with repeated strings pass through Python."""
    spans = stage(repeated_spans(docs, length, id_col, text_col, block_bytes), "spans")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_keys(id_col, text_col))
    joined = rows.join(spans, [rows[k].eqNullSafe(spans[k]) for k in KEY], "left").select("row", "spans")

    @F.arrow_udf(CUT + ("string" if as_text else "binary"))
    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            rows = []
            for text, s in zip(texts, spans):
                if not s.is_valid:
                    rows.append((0, 0, None, None))
                    continue
                raw, gone = text.as_py().encode(), merged(s.as_py(), length)
                cuts = [0, *(x for g in gone for x in g), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                rows.append((len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if as_text else kept))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary()]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)], [f.split()[0] for f in CUT.split(", ")])

    has = F.col("spans").isNotNull()
    called = joined.withColumn("has", has).withColumn("cut", apply(F.when(has, F.col("row")[text_col]), F.col("spans")))
    return called.select("row", F.when(F.col("has"), F.col("cut")).alias("cut"))


def remove_repeats(docs, length=200, id_col="doc_id", text_col="text", block_bytes=BLOCK_BYTES):
    """One row a document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and
    ``kept`` (the remaining bytes)."""
    done = cut_texts(docs.select(id_col, text_col), length, id_col, text_col, block_bytes)
    raw = F.coalesce(F.col("row")[text_col], F.lit("")).cast("binary")
    number = lambda name: F.coalesce(F.col("cut")[name], F.lit(0).cast("bigint")).alias(name)
    return done.select(
        F.col("row")[id_col].alias(id_col),
        F.octet_length(raw).cast("bigint").alias("n_bytes"),
        number("n_removed"),
        number("n_spans"),
        F.coalesce(F.col("cut.kept_sha256"), F.sha2(raw, 256)).alias("kept_sha256"),
        F.coalesce(F.col("cut.kept"), raw).alias("kept"),
    )
