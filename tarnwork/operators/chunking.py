"""Packing of paragraphs and lines into chunks, in Arrow batches.

A text of units is cut by the offsets behind its units.  A chunk is a stretch of the text:
it takes as many whole units as fit, one new unit at least, and the next chunk starts with
an overlap, that is, at an offset in the chunk before.  So chunks follow from the offsets
by binary searches; nothing is put together piece by piece."""

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F


def stretches(offsets, size, restart):
    """[(from, to)] of the chunks.  ``offsets``: 0, then the place behind each unit's line feed.
    A chunk from ``a`` fits up to offset ``a + size``; ``restart(a, end)`` is the next start."""
    out, a, done = [], 0, 0
    while done < len(offsets) - 1:
        done = max(done + 1, bisect_right(offsets, a + size) - 1)
        out.append((a, offsets[done] - 1))
        a = restart(a, offsets[done])
    return out


def pack_paragraphs(text, size=400, overlap=50):
    """Stripped paragraphs up to ``size`` characters; a chunk starts with the last ``overlap``
    characters of the one before.  No text, no chunk."""
    paragraphs = [p for p in map(str.strip, (text or "").split("\n")) if p]
    body = "\n".join(paragraphs)
    offsets = list(accumulate((len(p) + 1 for p in paragraphs), initial=0))
    # The last line feed is not part of a chunk, so one offset more fits.
    return [body[a:b].strip() for a, b in stretches(offsets, size + 1, lambda a, end: max(a, end - 1 - overlap) if overlap else end)]


def pack_lines(text, size=800, overlap=100):
    """Whole lines up to ``size`` characters, line feeds counted; a chunk starts with the trailing
    lines of the one before that have at most ``overlap`` characters (the last line feed not
    counted).  A short text stays whole, also an empty one; a blank last chunk goes; null gives none."""
    if text is None or len(text) <= size:
        return [] if text is None else [text]
    offsets = list(accumulate((len(line) + 1 for line in text.split("\n")), initial=0))
    parts = [text[a:b] for a, b in stretches(offsets, size, lambda a, end: max(a, offsets[bisect_left(offsets, end - 1 - overlap)]))]
    return (parts if parts[-1].strip() else parts[:-1]) or [text]


def split_column(docs, split, id_col, text_col, **limits):
    """``id``, ``chunk_index``, ``text`` of all chunks that ``split`` makes of each text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = batch.column(0).slice(at, 256), batch.column(1).slice(at, 256).to_pylist()
                made = [split(text, **limits) for text in texts]
                take = pa.array([i for i, parts in enumerate(made) for _ in parts], pa.int32())
                yield pa.RecordBatch.from_arrays([ids.take(take), pa.array([k for parts in made for k in range(len(parts))], pa.int32()), pa.array([p for parts in made for p in parts], pa.string())], [id_col, "chunk_index", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, chunk_index int, text string")


def chunk_paragraphs(docs, id_col="source", text_col="text", size=400, overlap=50):
    return split_column(docs, pack_paragraphs, id_col, text_col, size=size, overlap=overlap)


def split_fixed(docs, id_col="source", text_col="text", size=800, overlap=100):
    return split_column(docs, pack_lines, id_col, text_col, size=size, overlap=overlap)
