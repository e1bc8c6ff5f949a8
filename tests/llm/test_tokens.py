"""Token counts, shards, token files and packing against plain Python."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tarnwork.llm import byte_bpe, packing, sharding, token_counts, token_files

SP, BPE = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  a", " a  b ", "a\nb\n\n c\td", "<s>x</s> <unk>", "ﬁ ｱ　x y z", "a\x00b", "\r\n x\r", "a▁▁b ▁", "a  <|endoftext|>", "x\x1c \x1d y\x85 z", "don't  we'll 3² Ⅷ __ ''s", "\U0001f600 \U0001f600\n\n\n", "word " * 3000, "x" * 5000]


def texts(seed=1, n=120):
    r = random.Random(seed)
    alphabet = [" ", " ", "  ", "\n", "\t", "a", "the", "ing", "é", "文", "7", "!", "'s", ",", "▁", "​", "\r"]
    return ODD + ["".join(r.choices(alphabet, k=r.randrange(80))) for _ in range(n)] + ["same text"] * 3


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 1009, t, "x", 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + rows[:2], "doc_id bigint, text string, shard string, n_tokens int").repartition(3)


def test_counts_equal_the_library(spark, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    for table in (0, 8, 1000):
        got = token_counts.token_counts(docs, SP, table_size=table).collect()
        want = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        assert len(got) == docs.count()
        for r in got:
            t = want[r["doc_id"]]
            assert (r["n_tokens"], r["n_bytes"]) == (len(sp.encode(t)), len(t.encode())), t[:50]
            assert r["over_limit"] == (r["n_tokens"] > 4096)
    assert token_counts.token_counts(docs.limit(0), SP).count() == 0


def test_byte_bpe_equals_the_library():
    t, own = Tokenizer.from_file(BPE), byte_bpe.ByteBpe(BPE, cache_size=50)
    for x in texts(5, 800):
        got = np.frombuffer(own.encode([x])[0], own.dtype).tolist()
        assert got == t.encode(x or "", add_special_tokens=False).ids, x


def test_shards_are_contiguous_and_even(spark, docs):
    got = sharding.shard_by_bytes(docs, 7, ranges=5).collect()
    assert len(got) == docs.count()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        assert r["size"] == len(text[r["doc_id"]].encode()) + 16
        assert r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
    total, largest = sum(sizes.values()), max(r["size"] for r in got)
    assert all(abs(s - total / 7) <= largest for s in sizes.values())
    last = -1
    for s in sorted(slots):
        own = sorted(slots[s])
        assert [x for x, _ in own] == list(range(len(own)))
        assert [d for _, d in own] == sorted(d for _, d in own) and own[0][1] >= last
        last = own[-1][1]
    assert sharding.shard_by_bytes(docs.limit(0), 7).count() == 0


def test_shards_of_equal_rows(spark):
    same = spark.createDataFrame([(1, "abc")] * 40 + [(None, None)] * 3, "doc_id bigint, text string")
    got = sharding.shard_by_bytes(same, 4).collect()
    assert len({(r["shard"], r["slot"]) for r in got}) == 43 and {r["shard"] for r in got} == {0, 1, 2, 3}


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64))
    mph = token_files.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        token_files.PerfectHash.build(np.array([1, 1], np.uint64))


def test_token_files_round_trip(spark, docs):
    t = Tokenizer.from_file(BPE)
    docs = docs.union(spark.createDataFrame([(None, "null id", "x", 1)], docs.schema))
    manifest = token_files.write_token_shards(docs, BPE, 2, shards=4)
    got = token_files.read_token_shards(manifest).collect()
    want = sorted(((-1 if r["doc_id"] is None else r["doc_id"], t.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in docs.collect()), key=lambda x: x[0])
    got = sorted(got, key=lambda r: r["start"])
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == [d for d, _ in want]
    start = 0
    for r, (_, ids) in zip(got, want):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = manifest.collect()
    for d, ids in want[5:60:9]:
        assert token_files.lookup(rows, d).tolist() == ids
    assert token_files.lookup(rows, 123456) is None
    assert token_files.read_token_shards(token_files.write_token_shards(docs.limit(0), BPE, 2)).count() == 0


def test_keyed_access_reads_a_fixed_number_of_bytes(tmp_path):
    from pyarrow import fs

    class Counted:
        def __init__(self, file):
            self.file, self.read_bytes = file, 0

        def seek(self, at):
            self.file.seek(at)

        def read(self, n):
            got = self.file.read(n)
            self.read_bytes += len(got)
            return got

    most = []
    for n in (100, 20_000):
        ids = np.arange(n, dtype=np.int64) * 7
        (tmp_path / "ids").write_bytes(np.arange(3 * n, dtype="<u2").tobytes())
        (tmp_path / "index").write_bytes(token_files.pack_index(ids, np.ones(n, bool), np.full(n, 3), np.dtype("<u2")))
        reader = token_files.ShardReader(fs.LocalFileSystem(), str(tmp_path / "ids"), str(tmp_path / "index"))
        reader.index, reader.file = Counted(reader.index), Counted(reader.file)
        cost = []
        for i in range(0, n, max(1, n // 50)):
            before = reader.index.read_bytes + reader.file.read_bytes
            assert reader.get(int(ids[i])).tolist() == [x % 65536 for x in range(3 * i, 3 * i + 3)]
            cost.append(reader.index.read_bytes + reader.file.read_bytes - before)
        assert reader.get(3) is None
        most.append(sum(cost) / len(cost))
    assert max(most) < 400  # some blocks of 72 bytes, a slot and the ids, whatever the size


def test_null_ids_have_keys_of_their_own():
    ids = np.array([0, 0, -(2**63), -(2**63) + 1, 0, 5, 5])
    valid = np.array([False, False, True, True, True, True, True])
    assert token_files.pack_index(ids, valid, np.ones(7, int), np.dtype("<u2"))
    keys = token_files.document_keys(ids, valid, token_files._occurrences(ids, valid))
    assert len(set(keys.tolist())) == 7


def test_frequent_units_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "FAN_IN", 3)
    docs = spark.createDataFrame([(i, "the cat " * (i % 5) + f"w{i}") for i in range(200)], "doc_id bigint, text string").repartition(11)
    got = token_counts.frequent_units(docs, table_size=50)
    assert {" the", " cat"} <= set(got[:3]) and len(got) == 50


def check_packing(got, want, capacity, groups):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for d, ids in want.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    assert len(sequences) <= -(-sum(map(len, want.values())) // capacity) + groups


def test_packing(spark, docs):
    t = Tokenizer.from_file(BPE)
    docs = docs.dropDuplicates(["doc_id"])
    want = {r["doc_id"]: t.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    for size in (1 << 30, 3000):
        check_packing(packing.pack(docs, BPE, 0, capacity=64, group_bytes=size).collect(), want, 64, 1 if size > 1 << 20 else 20)
    assert packing.pack(docs.limit(0), BPE, 0).count() == 0


def test_assign_prefers_the_cheapest():
    out = packing.assign([6, 5, 5, 4], 10)
    assert {(i, b) for i, _, _, b, _ in out} == {(0, 0), (1, 1), (2, 1), (3, 0)}


def test_long_units_stay_out_of_the_summaries(spark):
    docs = spark.createDataFrame([(i, "short " + "x" * 5000 + " y" * 3) for i in range(20)], "doc_id bigint, text string").repartition(5)
    got = token_counts.frequent_units(docs, table_size=50)
    assert sorted(got) == [" short", " y"]
    assert token_counts.frequent_units(docs.limit(0), table_size=50) == []
