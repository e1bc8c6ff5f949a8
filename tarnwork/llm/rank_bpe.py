"""Byte-level BPE by a file of ranks, with sentencepiece doing the merges.

A sentencepiece BPE model is written straight from the vocabulary, without training: each
byte stands as one character (``BYTES``), each token of the file is a piece of such
characters, its score is its negative rank (sentencepiece merges the pair of the highest
score first, the leftmost among equals, as rank merging does), and the normaliser is the
identity.  The text is cut by the pattern of the rank files, and each match is encoded by
itself; a match that is a token is that token.  Decoding maps ids to the bytes of their
tokens.

A worker remembers the ids of short runs of text (``byte_bpe.RUN``: a run ends where the
pattern's matches end) and passes only new ones through the pattern and the model.
The letters and numbers of the pattern are those of the tiktoken library's own Unicode
tables, which it is asked for once a worker.

A null text has no ids, like an empty one; its decoded bytes are empty.  Rows are
independent: ties, repeated rows and other columns change nothing, an empty table gives an
empty result.  Ids that the vocabulary lacks raise an error when they are decoded.
"""

import base64
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .byte_bpe import RUN, WHITE
from .memo import Memo, slices

ENTRIES = 250_000  # runs of a generation of the memo
BYTES = [chr(0x100 + b) for b in range(256)]
ROWS = 512


def read_ranks(path):
    """token bytes -> rank, from lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number, value):
    """A field of a protocol buffer: bytes, float or int."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def as_characters(token):
    return "".join(map(BYTES.__getitem__, token))


def model_bytes(tokens):
    """A serialised sentencepiece BPE model whose piece i is ``tokens[i]``; the unknown
    piece, which no input meets, is the last one.  ``tokens`` ascend in rank."""
    pieces = [_field(1, as_characters(t).encode()) + _field(2, float(-i)) + _field(3, 1) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, float(-len(tokens))) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


def _class(name):
    """The inside of a character class that holds what the tiktoken library takes as ``name``."""
    import tiktoken

    single = tiktoken.Encoding("bytes", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    found, ranges = [], []
    for at in range(0, 0x110000, 0x800):
        if at != 0xD800:  # surrogates
            found += map(ord, bytes(single.encode_ordinary("".join(map(chr, range(at, at + 0x800))))).decode())
    for c in found:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(maxsize=4)
def splitter(pattern):
    """``pattern`` for ``re``, with the tiktoken library's letters, numbers and white space."""
    for name, inside in ((r"\p{L}", _class(r"\p{L}")), (r"\p{N}", _class(r"\p{N}")), (r"\s", WHITE)):
        pattern = re.sub(r"(?<!\[\^)(?<!\\p\{L\})" + re.escape(name) + r"(?![\\\]])", lambda _: f"[{inside}]", pattern)  # noqa: B023
        pattern = pattern.replace(name, inside)  # inside a class
    return re.compile(pattern.replace(r"\S", f"[^{WHITE}]"))


class RankBpe:
    """``encode(texts)`` gives each text's ids as bytes (little-endian unsigned 32-bit),
    ``decode(ids)`` the bytes that such ids stand for."""

    def __init__(self, path, pattern, entries=ENTRIES):
        import sentencepiece

        ranks = sorted((rank, token) for token, rank in read_ranks(path).items())
        self.tokens = dict(ranks)
        names = [token for _, token in ranks]
        self.ids = np.array([rank for rank, _ in ranks] + [0], "<u4")
        if missing := {bytes([b]) for b in range(256)}.difference(names):
            raise ValueError(f"the vocabulary lacks {len(missing)} of the 256 bytes")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(names))
        self.match = splitter(pattern).findall
        # Tokens that the merges do not lead to are tokens all the same where they stand alone.
        alone = [as_characters(t) for t in names]
        self.unreached = {c: [i] for i, (c, got) in enumerate(zip(alone, self.model.encode(alone, num_threads=1))) if got != [i]}
        self.memo = Memo(self.runs, entries)

    def runs(self, texts):
        """The ids of each text, as bytes."""
        matches = [self.match(t) for t in texts]
        flat = [as_characters(m.encode()) for found in matches for m in found]
        coded = iter(self.model.encode(flat, num_threads=1))
        if self.unreached:
            coded = iter([self.unreached.get(c, ids) for c, ids in zip(flat, coded)])
        for found in matches:
            yield self.ids[[i for _ in found for i in next(coded)]].tobytes()

    def encode(self, texts):
        for part in slices(texts):
            runs = [RUN.findall(t) if t else () for t in part]
            get = self.memo.getter(set().union(*runs))
            yield from [b"".join(map(get, r)) for r in runs]

    def decode(self, ids):
        return decode(self.tokens, ids)


def decode(tokens, ids):
    """The bytes that ids (little-endian unsigned 32-bit) stand for; ``tokens``: id -> bytes."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=1)
def shared(path, pattern):
    """The worker's own encoder for this file."""
    return RankBpe(path, pattern)


@lru_cache(maxsize=1)
def shared_tokens(path):
    return {rank: token for token, rank in read_ranks(path).items()}


def encode_texts(docs, path, pattern, id_col="doc_id", text_col="text", decoded=False):
    """One row a document: its id, ``n_tokens`` and ``ids`` (binary, little-endian unsigned
    32-bit integers); with ``decoded`` also the bytes that these ids stand for, in the same
    pass.  Every executor reads ``path``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * decoded

    def encode(batches):
        bpe = shared(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = list(bpe.encode(part.column(1).to_pylist()))
                columns = [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(map(bpe.decode, ids), pa.binary())] if decoded else []), names)

    schema = f"doc_id {id_type}, n_tokens bigint, ids binary" + ", decoded binary" * decoded
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, schema).withColumnRenamed("doc_id", id_col)


def decode_ids(coded, path, ids_col="ids"):
    """``coded`` with the column ``decoded``: the bytes (binary) that its ids stand for.  Null
    ids give null."""

    @F.pandas_udf("binary")
    def run(ids):
        tokens = shared_tokens(path)
        return ids.map(lambda i: decode(tokens, i), na_action="ignore")

    return coded.withColumn("decoded", run(F.col(ids_col)))
