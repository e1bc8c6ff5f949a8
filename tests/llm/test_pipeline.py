"""The pipeline against brute force on a small corpus."""

import random
import re

import corpus_pipeline
from test_decontamination import brute as leak
from test_jaccard import brute as near
from test_quality_warc import plain
from test_substrings import brute as repeats


def texts(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)] + ["é", "the"]
    pick = lambda n: [r.choice(words) for _ in range(n)]
    items = [" ".join(pick(30)) for _ in range(4)]
    passage, out = pick(70), [None, "", "too few", "again and again " * 20]
    for i in range(30):
        t = pick(r.randrange(30, 120))
        out.append(" ".join(t))
        if i % 4 == 0:
            out.append(" ".join([*t[:-1], "changed"]))
        if i % 5 == 0:
            out.append(" ".join([*pick(20), *passage, *pick(20)]))
        if i % 6 == 0:
            out.append(" ".join([*pick(20), items[i % 4], *pick(20)]))
    out.append(" ".join(passage))
    return out, items


def expected(rows, items):
    rows = [(d, t) for d, t in rows if plain(t)[0] >= 10 and 100 * plain(t)[4] <= 20 * plain(t)[0]]
    keep = {d for d, _, c in near(rows, 5, 80, 100) if d == c}
    rows = [(d, t) for d, t in rows if d in keep]
    raw = [t.encode() for _, t in rows]
    cut = []
    count = {}
    for b in raw:
        for i in range(len(b) - 199):
            count[b[i : i + 200]] = count.get(b[i : i + 200], 0) + 1
    for (d, _), b in zip(rows, raw):
        gone = set()
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone.update(range(i, i + 200))
        t = bytes(x for i, x in enumerate(b) if i not in gone).decode("utf-8", "ignore")
        if not gone or re.search(r"\S", t):
            cut.append((d, t))
    assert [x[0] for x in repeats(raw, 200)] == [len(b) for b in raw]
    return {d: t for d, t in cut if max(leak(t, x) for x in items) < 0.8}


def test_run(spark, tmp_path):
    body, items = texts(3)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(body)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = expected([(r[0], r[1]) for r in rows], items)
    assert {g["doc_id"] for g in got} == set(want) and len(want) > 10
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for g in got:
        assert g["doc_tokens"] == len(t.encode(want[g["doc_id"]], add_special_tokens=False).ids) + 1
