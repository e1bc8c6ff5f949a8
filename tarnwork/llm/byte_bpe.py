"""Ids of whole texts under a byte-level BPE file of the tokenizers library.

The library splits a text into pre-tokens that never cross white space, except
for one blank that leads a word, and that end where letters meet a mark.  A text
therefore falls into runs whose ids the library gives one by one and which a worker
remembers, in two generations of about ``cache_size`` runs; texts that hold a special
token's string, where that rule does not hold, are encoded whole.
"""

import re
import sys
from array import array
from functools import lru_cache

import numpy as np

WHITE = "\t-\r \x85\xa0  -     　"
CACHE_SIZE = 450_000  # of a generation; an entry takes about 170 bytes
CHUNK = 1 << 20  # characters whose new runs go to the library together
# A run of letters ends before a mark; the mark begins a run of its own.
RUN = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ɏ]++(?=[.,;:!?|)])| ?[^{WHITE}]++|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


class ByteBpe:
    """``encode(texts)`` gives each text's ids as the bytes of a little-endian array."""

    def __init__(self, path, cache_size=CACHE_SIZE):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
            raise ValueError("not a plain byte-level tokenizer file")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cache, self.old, self.cache_size = {}, {}, cache_size

    def pack(self, ids):
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def encode(self, texts):
        out, at = [], 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and size < CHUNK:
                size += len(texts[stop] or "")
                stop += 1
            out += self._encode(texts[at:stop])
            at = stop
        return out

    def _encode(self, texts):
        whole = [bool(t) and any(s in t for s in self.special) for t in texts]
        runs = [() if w or not t else RUN.findall(t) for t, w in zip(texts, whole)]
        need = set().union(*runs)
        if new := need.difference(self.cache):
            if len(self.cache) + len(new) > self.cache_size:
                self.old, self.cache = self.cache, {}
                new = need
            old = self.old
            self.cache.update((r, old[r]) for r in new if r in old)
            new = [r for r in new if r not in old]
            for r, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
                self.cache[r] = self.pack(e.ids)
        get = self.cache.__getitem__
        return [self.pack(self.tokenizer.encode(t, add_special_tokens=False).ids) if w else b"".join(map(get, r)) for t, w, r in zip(texts, whole, runs)]


@lru_cache(maxsize=1)
def shared(path, cache_size=CACHE_SIZE):
    """The worker's own encoder for this file: its cache serves all tasks of the worker."""
    return ByteBpe(path, cache_size)


def encoded_rows(column, bpe, rows=512):
    """The packed ids of each text of an Arrow column, ``rows`` texts at a time."""
    for at in range(0, len(column), rows):
        yield from bpe.encode(column.slice(at, rows).to_pylist())
