"""Vector codes, alignment and rank BPE against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from test_tokens import ODD, texts
from tokenizers import Tokenizer

from tarnwork.llm import alignment, rank_bpe, vector_codes

A, B, RANKS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken")


def sha(data):
    return hashlib.sha256(data).hexdigest()


# ---- vector codes -------------------------------------------------------------------------


def plain_codes(rows, entries, rounds, parts=8):
    whole = lambda x: (lambda r: r[0] * 4096 // r[1])(float(x).as_integer_ratio())
    kept = [(i, label, [whole(x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    dims = next((len(r[2]) for r in order if r[2] and len(r[2]) % parts == 0), 0)
    cut = lambda v: [v[p * dims // parts : (p + 1) * dims // parts] for p in range(parts)]
    vectors = [cut(r[2]) for r in order if dims and len(r[2]) == dims]
    books = [[v[p] for v in vectors[:entries]] for p in range(parts)]

    def near(x, book):
        d = [sum((s - t) ** 2 for s, t in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        got = [[[] for _ in b] for b in books]
        for v in vectors:
            for p in range(parts):
                got[p][near(v[p], books[p])[0]].append(v[p])
        books = [[[sum(c) // len(g) for c in zip(*g)] if g else e for g, e in zip(gs, b)] for gs, b in zip(got, books)]
    digest = sha(",".join(str(x) for b in books for e in b for x in e).encode())
    out, sums = [], defaultdict(int)
    for i, label, v in kept:
        found = [near(x, b) for x, b in zip(cut(v), books)] if dims and len(v) == dims else None
        error = found and sum(d for _, d in found)
        sums[label] += error or 0
        out.append((i, label, found and "".join(f"{e:02x}" for e, _ in found), error))
    missing = {label for label in sums if all(e is None for _, k, _, e in out if k == label)}
    long = lambda n: n if n is None or n < 1 << 63 else None
    beyond = {label for _, label, _, e in out if long(e) != e}
    return sorted(((i, c, long(e), None if label in missing | beyond else long(sums[label]), digest) for i, label, c, e in out), key=repr)


def odd_vectors():
    r = np.random.default_rng(1)
    rows = [(i % 7 or None, i % 3 or None, [float(x) for x in np.round(r.normal(size=16) * (1e30 if i % 11 == 0 else 2), int(i % 3))]) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    return rows + [(1, 1, None), (2, 1, [1.0, None] * 8), (3, 1, [nan] * 16), (4, 2, [1.0] * 15), (5, 2, []), (6, 2, [1.0] * 24), (7, 7, [0.0] * 16), (7, 7, [0.0] * 16), (8, None, [inf] * 16), (-1, 3, [2.0] * 15), (9, 4, [1e308] * 16)]


@pytest.mark.parametrize("pick", ["all", "small", "one", "unfit", "dropped"])
def test_codes_of_odd_vectors(spark, pick):
    rows = odd_vectors()
    if pick == "small":
        rows = [r for r in rows if not r[2] or all(abs(x or 0) < 1e9 for x in r[2])]
    rows = {"one": rows[:1], "unfit": rows[63:66], "dropped": rows[60:63]}.get(pick, rows)
    made = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, label int, embedding array<double>, code string").repartition(3)
    got = sorted((tuple(r) for r in vector_codes.compress(made, entries=5, rounds=2).collect()), key=repr)
    assert got == plain_codes(rows, 5, 2)


def test_codes_of_the_table(spark):
    made = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id < 150")
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in made.collect()]
    assert sorted((tuple(r) for r in vector_codes.compress(made).collect()), key=repr) == plain_codes(rows, 16, 6)
    assert vector_codes.compress(made.limit(0)).count() == 0


def test_many_labels_take_the_shuffle(spark, monkeypatch):
    rows = [(i, i % 5 or None, [float(i % 3), 1.0] * 4) for i in range(40)]
    made = spark.createDataFrame(rows, "vec_id int, label int, embedding array<float>")
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 1)
    assert sorted((tuple(r) for r in vector_codes.compress(made, entries=2, rounds=1).collect()), key=repr) == plain_codes(rows, 2, 1)


@pytest.mark.parametrize("width", [1, 7, 90, 5000])
def test_cells_do_not_change_the_nearest(width):
    r = np.random.default_rng(width)
    book = r.integers(-100, 100, (9, 3))
    book[4] = book[2]  # a tie goes to the lower index
    values = np.concatenate([r.integers(-120, 120, (500, 3)), book, (book[:4] + book[4:8]) // 2])
    grid = vector_codes.Grid(book, width, cells=40)
    for at in range(0, len(values), 100):
        entry, distance = grid.nearest(values[at : at + 100])
        every = ((values[at : at + 100, None] - book[None]) ** 2).sum(-1)
        assert (entry == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert len(grid.rows) <= 100
    if width == 1:
        assert grid.candidates(values).sum() < 2 * len(values)


# ---- alignment ----------------------------------------------------------------------------


def library():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_of_character()


def plain_alignment(text, a, b, of):
    """(A ids, B ids, group text, links) by offsets of whole texts, or None."""
    raw = (" " + (text or "")).encode()
    ia, ib = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
    pa = [bytes(of[c] for c in a.id_to_token(i)) for i in ia]
    pb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    if not text or b"".join(pa) != raw or b"".join(pb) != raw:
        return None
    ea, eb = (np.cumsum([len(x) for x in p]).tolist() for p in (pa, pb))
    common = sorted({*ea} & {*eb})
    side = lambda ids, ends, low, high: ",".join(str(i) for i, e in zip(ids, ends) if low < e <= high)
    shown = ";".join(side(ia, ea, low, high) + "|" + side(ib, eb, low, high) for low, high in zip([0, *common], common))
    links = [(i, j) for i, s, x in zip(ia, [0, *ea], ea) for j, u, y in zip(ib, [0, *eb], eb) if s < y and u < x]
    return ia, ib, shown, links


def odd_texts():
    r = random.Random(4)
    letters = [" ", " ", "\t", "\n", "\xa0", "　", "a", "b", "ing", "文", "​", " ", "7", "x1", ".", "'s"]
    made = ["".join(r.choices(letters, k=14)) for _ in range(150)]
    return [t for t in ODD if not t or len(t) < 4000] + made + ["a  b ", " ", "\n", "a ", "a\n", "<|endoftext|> <s>"]


def test_units_add_up_to_the_text():
    own, (a, b, of) = alignment.Aligner(A, B, entries=60), library()
    every = odd_texts() + texts(3, 300)[len(ODD) :]
    for t, got in zip(every, own.texts(every)):
        want = plain_alignment(t, a, b, of)
        assert (got is None) == (want is None), repr(t)
        if got:
            codes = alignment.codes_of(got[4], own.dtype).tolist()
            assert got[:2] == (len(want[0]), len(want[1])) and got[3] == want[2] and got[2] == want[2].count("|"), repr(t)
            assert sorted((c >> 32, c & 0xFFFFFFFF) for c in codes) == sorted(want[3])


@pytest.mark.parametrize("frequent", [0, 40, 1 << 18])
def test_measures_of_documents(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "HOT", 8)
    every = odd_texts() + ["a hot text"] * 60 + ["a copy"] * 3
    rows = [(i // 2 if i % 9 else None, t, "x", 1) for i, t in enumerate(every)]
    made = spark.createDataFrame(rows, "doc_id int, text string, copies string, pair int").repartition(5)
    library_of, by_b, counts, found = library(), defaultdict(int), Counter(), []
    for i, t, *_ in rows:
        found.append((i, plain_alignment(t, *library_of)))
        counts.update(found[-1][1][3] if found[-1][1] else ())
    for (_, y), n in counts.items():
        by_b[y] = max(by_b[y], n)
    want = [(i, len(m[0]), len(m[1]), m[2].count("|"), len(m[3]), sum(counts[x] == by_b[x[1]] for x in m[3]), sum(counts[x] for x in m[3]), m[2]) if m else (i, 0, 0, 0, 0, 0, 0, "") for i, m in found]
    got = alignment.align_documents(made, A, B, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    if frequent:
        hashed = alignment.align_documents(made, A, B, groups="sha256", frequent=frequent).select("groups").collect()
        assert Counter(r[0] for r in hashed) == Counter(sha(w[-1].encode()) if w[-1] else "" for w in want)


def test_alignment_of_nothing_and_of_a_very_long_text(spark):
    schema = "doc_id bigint, text string"
    assert alignment.align_documents(spark.createDataFrame([], schema), A, B).count() == 0
    assert [tuple(r) for r in alignment.align_documents(spark.createDataFrame([(1, None), (1, "")], schema), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2
    long = "word " * 60_000 + "x" * 50_000 + "字" * 50_000
    row = alignment.align_documents(spark.createDataFrame([(1, long)], schema), A, B).first()
    assert row["n_a"] == len(library()[0].encode(" " + long, add_special_tokens=False).ids)


# ---- rank BPE -----------------------------------------------------------------------------


def test_rank_bpe_equals_the_library(spark):
    ranks = rank_bpe.read_ranks(RANKS)
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    signs = [chr(c) for c in [*range(0x3000), *range(0x10000, 0x12000), *range(0x1D400, 0x1D800), *range(0xA000, 0xA800)]]
    every = texts(9, 300) + ["".join(r.choices(signs, k=60)) for _ in range(400)] + [None, "", "x" * 20_000 + " " + "字" * 20_000]
    made = spark.createDataFrame([(i // 2 if i % 5 else None, t, "x") for i, t in enumerate(every)], "doc_id int, text string, ids string").repartition(3)
    coded = rank_bpe.encode_texts(made, RANKS, P.PATTERN, decoded=True)
    again = rank_bpe.decode_ids(coded.select("ids", F.col("decoded").alias("before")), RANKS)
    assert again.filter("decoded <> before").count() == 0 and again.count() == made.count()
    coded = coded.collect()
    ids = lambda t: np.array(known.encode_ordinary(t or ""), "<u4").tobytes()
    want = Counter((i, len(ids(t)) // 4, ids(t), (t or "").encode()) for i, t, _ in made.collect())
    assert Counter((x["doc_id"], x["n_tokens"], bytes(x["ids"]), bytes(x["decoded"])) for x in coded) == want
    assert rank_bpe.encode_texts(made.limit(0), RANKS, P.PATTERN).count() == 0


def test_ranks_with_gaps_and_tokens_that_merges_miss(tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"cd": 310, b"abcd": 320, b"bc": 299, b"abx": 400}
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % n for t, n in ranks.items()))
    known = tiktoken.Encoding("small", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = rank_bpe.RankBpe(str(path), P.PATTERN, entries=3)
    for t in ("abcd", "abcdabcd", " abcd bcd abx", "abxcd\x00 é", "bcab" * 50):
        ids = b"".join(own.encode([t]))
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(t), t
        assert own.decode(ids) == t.encode()
    path.write_bytes(base64.b64encode(b"a") + b" 0")
    with pytest.raises(ValueError):
        rank_bpe.RankBpe(str(path), P.PATTERN)


def test_memo_forgets_long_keys():
    from tarnwork.llm.memo import LONGEST, Memo

    memo = Memo(lambda keys: [len(k) for k in keys], 10)
    for n in range(50):
        get = memo.getter({str(n), "x" * (LONGEST + 1 + n)})
        assert get(str(n)) == len(str(n)) and get("x" * (LONGEST + 1 + n)) == LONGEST + 1 + n
        assert len(memo.now) <= 12 and len(memo.old) <= 12
    assert sum(len(k) > LONGEST for k in [*memo.now, *memo.old]) <= 2
