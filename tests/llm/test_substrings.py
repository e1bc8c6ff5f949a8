"""Repeated byte strings against a count of every window."""

import collections
import hashlib
import random

import numpy as np
import pytest

from tarnwork.llm import substrings


def brute(texts, length):
    count = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), len(substrings.runs_of(gone[:-1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_index_statistics(seed):
    r = random.Random(seed)
    parts = [bytes(r.choices(b"ab\x00\xff"[: r.randrange(1, 5)], k=r.randrange(0, 60))) for _ in range(12)]
    parts += [parts[0], b"", parts[3] + b"a"]
    index = substrings.RunLengthIndex(parts)
    got, places = index.matching_statistics(), [(p, i) for p in range(len(parts)) for i in range(len(parts[p]))]
    for p, i in places:
        best = 0
        for q, j in places:
            if (p, i) != (q, j):
                k = 0
                while i + k < len(parts[p]) and j + k < len(parts[q]) and parts[p][i + k] == parts[q][j + k]:
                    k += 1
                best = max(best, k)
        assert got[index.starts[p] + i] == best, (p, i)
    assert index.n_runs <= index.n and index.lengths.sum() == index.n and index.restored() == parts


def test_segments_cover_all_windows():
    r = random.Random(1)
    for n in (63, 64, 65, 500, 5000):
        raw = bytes(r.choices(b"abcd", k=n))
        _, start, count, _ = substrings.segments(raw, 64)
        assert [x for s, c in zip(start, count) for x in range(s, s + c)] == list(range(max(0, n - 63)))


def corpus(seed):
    r = random.Random(seed)
    letter = lambda n: "".join(r.choices("abcdefgh é", k=n))
    shared = [letter(140) for _ in range(4)]
    texts = [None, "", "a" * 300, "ab" * 200, "short", "x" * 100, "x" * 99, shared[0] * 3]
    for _ in range(60):
        texts.append("".join(r.choice([letter(r.randrange(150)), r.choice(shared), r.choice(shared)[r.randrange(40) :]]) for _ in range(r.randrange(1, 6))))
    return texts + texts[20:24] + [texts[30][:50] + "!" + texts[30][50:]]


@pytest.mark.parametrize("block", [1 << 20, 3000, 700, 0])
def test_removal_equals_brute_force(spark, block, monkeypatch):
    texts = corpus(block)
    docs = spark.createDataFrame([(i if i != 15 else None, t, "x", 3) for i, t in enumerate(texts)], "doc_id bigint, text string, kept string, n int").repartition(3)
    docs = docs.union(docs.filter("doc_id = 40"))
    got = substrings.remove_repeats(docs, length=100, block_bytes=block).collect()
    raw = [(-1 if i == 15 else i, (t or "").encode()) for i, t in enumerate(texts)] + [(40, (texts[40] or "").encode())]
    want = [(i, *x) for (i, _), x in zip(raw, brute([t for _, t in raw], 100))]
    assert sorted((-1 if g["doc_id"] is None else g["doc_id"], g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) for g in got) == sorted(want)
    assert substrings.remove_repeats(docs.limit(0), length=64).count() == 0


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 100)
    r = random.Random(9)
    raw = bytes(r.choices(b"abcdefghij", k=1000))
    for t in (raw, raw[400:700]):
        _, start, count, _ = substrings.segments(t, 64)
        assert [x for s, c in zip(start, count) for x in range(s, s + c)] == list(range(len(t) - 63))
