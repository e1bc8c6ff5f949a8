"""Two tokenizers' tokens of the same texts, aligned by the bytes they cover.

A is a byte-level tokenizers file, applied to a blank and the text; B is a sentencepiece
BPE model with byte fallback, applied to the text (it adds that blank itself).  Offsets at
which tokens of both end cut the tokens into groups, and an A and a B token are linked where
their byte ranges overlap.

Exact copies are aligned once: texts are shuffled by their full text, each distinct text
is tokenised and aligned in one place, what it adds to the corpus-wide pair counts is
weighted by its copies, and its measures are joined back to the ids by the text's SHA-256.
Both tokenizers end a token before a blank or line feed that follows another character, and
between a letter and an ASCII mark or digit, so a text is aligned in units between such
places, and a worker remembers short units.

Counts of id pairs are needed once more for every text.  The most frequent pairs (at most
``FREQUENT``, those whose count has the most binary digits) are broadcast; links of other
pairs, each of them rare, are shuffled to their counts.  Texts with at least 1/1024 of all
rows are at most 1024 and meet their rows by broadcast, all others by a shuffle.

Texts that are null or empty, or whose bytes either side's tokens do not give back, have no
tokens: zeros, and '' for the groups.  Null and repeated ids are rows like others, other
columns are ignored, an empty table gives an empty result.
"""

import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .byte_bpe import WHITE
from .common import stage
from .memo import Memo, slices
from .token_counts import check_model

ENTRIES = 400_000  # units of a generation of the memo
FREQUENT = 1 << 18
HOT = 1024
LINES = 200  # units that go to A's library in one text
W, LETTERS = f"{WHITE}▁", "A-Za-zÀ-ÖØ-öø-ɏ"
# A unit ends where a blank or line feed follows another character, and between a letter
# and an ASCII mark or digit.
UNIT = re.compile(f"[{W}]*+[{LETTERS}]++(?=[!-@[-`{{-~])|[{W}]*+[^{W}]++(?:(?![ \n])[{W}]++[^{W}]++)*+(?:(?![ \n])[{W}]++)?+|[{W}]++")
CROSSES = re.compile(f"[{LETTERS}][!-@[-`{{-~]")
PLAIN = re.compile(f"\n? ?[^{W}]+").fullmatch
NOT_ALIGNED = -(1 << 60)


def align(a, a_sizes, b, b_sizes):
    """(groups, links) of two token lists over the same bytes.  A group is (start in a, end
    in a, start in b, end in b); a link is a pair of places, one for each overlap."""
    groups, links, i, j, first_a, first_b = [], [], 0, 0, 0, 0
    end_a, end_b = a_sizes[0], b_sizes[0]
    while True:
        links.append((i, j))
        if end_a < end_b:
            i += 1
            end_a += a_sizes[i]
        elif end_a > end_b:
            j += 1
            end_b += b_sizes[j]
        else:
            i, j = i + 1, j + 1
            groups.append((first_a, i, first_b, j))
            if i == len(a):
                return groups, links
            first_a, first_b = i, j
            end_a, end_b = end_a + a_sizes[i], end_b + b_sizes[j]


def byte_of_character():
    """The byte that each character of a byte-level vocabulary stands for: printable Latin
    characters for themselves, the other bytes in order from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Aligner:
    """``texts(list)`` gives (A tokens, B tokens, groups, group text, links as packed pair
    codes) of each text, or None where it has no tokens."""

    def __init__(self, a_path, b_path, entries=ENTRIES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of, names = byte_of_character(), self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = dict.fromkeys(names.values(), b"")
        for name, i in names.items():
            if all(c in of for c in name):
                self.a_bytes[i] = bytes(map(of.__getitem__, name))
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any(b and CROSSES.search(b.decode(errors="replace")) for b in self.b_bytes):
            raise ValueError("a piece of this model joins a letter and a mark")
        if self.a.normalizer is not None:
            raise ValueError("this tokenizer rewrites texts before it splits them")
        self.wide = max(len(self.b_bytes), max(self.a_bytes) + 1) > 1 << 16
        self.code, self.shift = ("Q", 32) if self.wide else ("I", 16)
        self.line_feed = self.a.encode("\n", add_special_tokens=False).ids
        self.blank = self.b.piece_to_id("▁")
        self.memo = Memo(self.units, entries)

    def _piece(self, i):
        if self.b.is_control(i) or self.b.is_unknown(i):
            return None
        name = self.b.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()

    @property
    def dtype(self):
        return np.dtype("<u8" if self.wide else "<u4")

    def a_ids(self, units):
        """A's ids of each unit.  Units without inner white space go to the library many to a
        text, with line feeds between them, which are tokens of their own there."""
        out, feed = dict.fromkeys(units), self.line_feed
        together = [u for u in out if PLAIN(u)] if len(feed) == 1 else []
        lines = [together[at : at + LINES] for at in range(0, len(together), LINES)]
        joined = ["\n".join([u[1:] if u[0] == "\n" else u for u in x]) for x in lines]
        for units_of, e in zip(lines, self.a.encode_batch_fast(joined, add_special_tokens=False)):
            ids, at = [*e.ids, *feed], 0
            for u in units_of:
                end = ids.index(feed[0], at)
                out[u] = ids[at:end] if u[0] != "\n" else feed + ids[at:end]
                at = end + 1
        alone = [u for u in units if out[u] is None]
        for u, e in zip(alone, self.a.encode_batch_fast(alone, add_special_tokens=False)):
            out[u] = e.ids
        return out.values()

    def units(self, units):
        b_ids = self.b.encode([u[1:] if u[0] == " " else "\n" + u for u in units], num_threads=1)
        for u, a, b in zip(units, self.a_ids(units), b_ids):
            # B's blank before the text is the unit's own one, or goes with the line feed.
            yield self.unit(u, a, b[2:] if u[0] != " " else b or [self.blank])

    def unit(self, unit, a, b):
        a_parts, b_parts = [self.a_bytes[i] for i in a], [self.b_bytes[i] for i in b]
        if None in b_parts or b"".join(b_parts) != unit.encode() or b"".join(a_parts) != unit.encode():
            return NOT_ALIGNED, 0, 0, "", b""
        groups, links = align(a, list(map(len, a_parts)), b, list(map(len, b_parts)))
        shown = ";".join([f"{a[i]}|{b[k]}" if j - i == 1 == m - k else f"{','.join(map(str, a[i:j]))}|{','.join(map(str, b[k:m]))}" for i, j, k, m in groups])
        shift = self.shift
        packed = array(self.code, [a[i] << shift | b[j] for i, j in links])
        if sys.byteorder == "big":
            packed.byteswap()
        return len(a), len(b), len(groups), shown, packed.tobytes()

    def texts(self, texts):
        for part in slices(texts):
            units = [UNIT.findall(" " + t) if t else () for t in part]
            get = self.memo.getter(set().union(*units))
            for row in units:
                n_a, n_b, n_groups, shown, links = zip(*map(get, row)) if row else ((0,), (), (), (), ())
                n_a = sum(n_a)
                yield (n_a, sum(n_b), sum(n_groups), ";".join(shown), b"".join(links)) if n_a > 0 else None


@lru_cache(maxsize=1)
def shared(a_path, b_path):
    return Aligner(a_path, b_path)


def codes_of(raw, dtype):
    """Pair codes (A's id in the upper 32 bits, B's in the lower) of packed links."""
    codes = np.frombuffer(raw, dtype).astype(np.int64)
    return codes if dtype.itemsize == 8 else (codes >> 16 << 32) | (codes & 0xFFFF)


def align_texts(docs, a_path, b_path, text_col="text", groups="text"):
    """One row for each distinct text that has tokens (staged): ``text_key`` (its SHA-256),
    ``copies``, ``n_a``, ``n_b``, ``n_groups``, ``groups`` (as ``a1,a2|b1;a3|b2,b3``, or the
    SHA-256 of that with ``groups="sha256"``), ``pairs`` and ``times`` (packed: its distinct
    linked id pairs and how many links each has)."""
    check_model(b_path)
    distinct = docs.select(F.col(text_col).alias("text")).filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    keyed = distinct.select("text", "copies", F.unhex(F.sha2("text", 256)).alias("text_key"))

    def run(batches):
        from hashlib import sha256

        aligner = shared(a_path, b_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows, keep = batch.slice(at, 512), [], []
                for n, found in enumerate(aligner.texts(part.column(0).to_pylist())):
                    if found:
                        pairs, times = np.unique(np.frombuffer(found[4], aligner.dtype), return_counts=True)
                        shown = sha256(found[3].encode()).hexdigest() if groups == "sha256" else found[3]
                        rows.append((*found[:3], shown, pairs.tobytes(), times.astype("<u4").tobytes()))
                        keep.append(n)
                if rows:
                    at, columns = pa.array(keep, pa.int32()), list(zip(*rows))
                    types = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(2).take(at), part.column(1).take(at), *(pa.array(c, t) for c, t in zip(columns, types))], ["text_key", "copies", "n_a", "n_b", "n_groups", "groups", "pairs", "times"]
                    )

    schema = "text_key binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, pairs binary, times binary"
    return stage(keyed.mapInArrow(run, schema), "aligned-texts")


def _packed(a_path, b_path):
    return shared(a_path, b_path).dtype


def pair_counts(aligned, a_path, b_path):
    """One row for each linked id pair (staged): ``pair`` (A's id * 2**32 + B's id), ``a_id``,
    ``b_id``, ``n`` (its links in the whole corpus), ``best`` (whether no pair with its B id
    has more)."""

    def add(batches):
        dtype = _packed(a_path, b_path)
        held, size = [], 0

        def total(held):
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.zeros(len(codes), np.int64)
            np.add.at(n, at, np.concatenate([n for _, n in held]))
            return codes, n

        def rows(codes, n):
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["pair", "n"])

        for batch in batches:
            copies = batch.column(0).to_pylist()
            for c, pairs, times in zip(copies, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                held.append((codes_of(pairs, dtype), np.frombuffer(times, "<u4").astype(np.int64) * c))
                size += len(held[-1][0])
                if size > 1 << 21:
                    held = [total(held)]
                    size = len(held[0][0])
                    if size > 1 << 20:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*total(held))

    counts = aligned.select("copies", "pairs", "times").mapInArrow(add, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stage(counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a_id"), F.expr("cast(pair & 4294967295 as int)").alias("b_id"), "n"), "pair-sums")
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))  # at most a row for each id of B's vocabulary
    return stage(counts.join(F.broadcast(most), "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def frequent_from(counts, limit):
    """The least power of two such that at most ``limit`` pairs have that count or more."""
    sizes = counts.groupBy(F.length(F.bin("n")).alias("digits")).agg(F.count("*").alias("pairs")).collect()  # at most 64 rows
    held, least = 0, 64
    for digits, pairs in sorted(((r["digits"], r["pairs"]) for r in sizes), reverse=True):
        held += pairs
        if held > limit:
            break
        least = digits
    return min(1 << (least - 1), (1 << 63) - 1)


def measured_texts(aligned, counts, a_path, b_path, frequent=FREQUENT):
    """``aligned`` (without its pairs) with ``n_links``, ``n_best`` and ``count_sum`` (staged)."""
    spark, floor = aligned.sparkSession, frequent_from(counts, frequent)
    table = counts.filter(F.col("n") >= F.lit(floor)).select("pair", "n", "best").toPandas().sort_values("pair")  # at most ``frequent`` rows
    known = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("pair", "n", "best")))
    kept = ["text_key", "copies", "n_a", "n_b", "n_groups", "groups"]

    def look_up(batches):
        dtype = _packed(a_path, b_path)
        pair, count, best = known.value
        for batch in batches:
            pairs, times = batch.column(6), batch.column(7)
            codes = codes_of(b"".join(pairs.to_pylist()), dtype)
            n = np.frombuffer(b"".join(times.to_pylist()), "<u4").astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), [len(x.as_py()) // dtype.itemsize for x in pairs])
            at = np.minimum(np.searchsorted(pair, codes), max(len(pair) - 1, 0))
            hit = pair[at] == codes if len(pair) else np.zeros(len(codes), bool)
            sums = np.zeros((3, batch.num_rows), np.int64)
            np.add.at(sums[0], row, n)
            np.add.at(sums[1], row[hit], n[hit] * best[at[hit]])
            np.add.at(sums[2], row[hit], n[hit] * count[at[hit]])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))])
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(codes[~hit]), pa.array(n[~hit])], ["pair", "times"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), *(pa.array(s) for s in sums), rest], [*kept, "n_links", "n_best", "count_sum", "rest"])

    schema = "text_key binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, n_links bigint, n_best bigint, count_sum bigint, rest array<struct<pair bigint, times bigint>>"
    looked = stage(aligned.select(*kept, "pairs", "times").mapInArrow(look_up, schema), "measured-texts")
    rare = looked.select("text_key", F.explode("rest").alias("link")).select("text_key", "link.*").join(counts.filter(F.col("n") < F.lit(floor)), "pair")
    more = rare.groupBy("text_key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    added = lambda c, m: (F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c)
    return stage(looked.drop("rest").join(more, "text_key", "left").select(*kept, "n_links", added("n_best", "more_best"), added("count_sum", "more_sum")), "measured-texts")


def by_document(docs, measured, id_col="doc_id", text_col="text"):
    """One row a document: its id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum``, ``groups``."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.when(text != "", F.unhex(F.sha2(text, 256))).alias("text_key"), F.monotonically_increasing_id().alias("row"))
    rows = stage(rows, "text-keys")
    least = max(2, -(-rows.count() // HOT))
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    hot = measured.filter(F.col("copies") >= least).select("text_key", F.struct(*numbers, "groups").alias("hot"))  # at most HOT rows
    cold = measured.filter(F.col("copies") < least).select(F.col("text_key").alias("cold_key"), F.struct(*numbers, "groups").alias("cold"))
    met = rows.join(F.broadcast(hot), "text_key", "left")
    # Rows that are settled go to places of their own; no text's key has so few bytes.
    dealt = met.withColumn("cold_key", F.when(F.col("hot").isNull() & F.col("text_key").isNotNull(), F.col("text_key")).otherwise(F.col("row").cast("string").cast("binary")))
    found = dealt.join(cold, "cold_key", "left").select("doc_id", F.coalesce("hot", "cold").alias("m"))
    return found.select(F.col("doc_id").alias(id_col), *(F.coalesce(F.col("m")[c], F.lit(0)).alias(c) for c in numbers), F.coalesce(F.col("m.groups"), F.lit("")).alias("groups"))


def align_documents(docs, a_path, b_path, id_col="doc_id", text_col="text", groups="text", frequent=FREQUENT):
    """The measures of every document by both tokenizers; see ``by_document``."""
    aligned = align_texts(docs, a_path, b_path, text_col, groups)
    counts = pair_counts(aligned, a_path, b_path)
    return by_document(docs, measured_texts(aligned, counts, a_path, b_path, frequent), id_col, text_col)
