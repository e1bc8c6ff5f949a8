"""Quality rules and WARC against plain Python."""

import collections
import hashlib
import random
import re

import pytest

from tarnwork.llm import quality, warc
from tarnwork.llm.common import WordCodes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n ", "one", "a b c d e f g h i j", "x y z w v " * 30, "é文 #*$ \x85a　b", "l1 a\nl1 a\n\n \nl1 a \nl2", "NO NO NO!! NO", "w" * 9000, "a b " * 4]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = collections.Counter(windows)
    marked = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked))


def test_metrics():
    r = random.Random(3)
    texts = TEXTS + [" ".join(r.choices("ab#\n", k=r.randrange(60))) for _ in range(300)]
    for t in texts:
        assert quality.measure(t, WordCodes())[:5] == plain(t), t


def test_binomial():
    from math import comb

    for k, n, p in [(0, 10, 0.1), (3, 50, 0.02), (7, 9, 0.5)]:
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_binomial_at_scale():
    """The closed form at sizes where a sum over terms would be slow; normal limit."""
    assert quality.binomial_tail(2_000_000, 100_000_000, 0.02) == pytest.approx(0.5, abs=1e-3)
    assert quality.binomial_tail(1_997_200, 100_000_000, 0.02) == pytest.approx(0.0228, abs=1e-3)
    assert quality.binomial_tail(-1, 5, 0.1) == 0 and quality.binomial_tail(5, 5, 0.1) == 1


def test_null_stratum_is_its_own(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, "a b", ""), (3, "a b", "en")], "doc_id bigint, text string, lang string")
    assert len({r["stratum"] for r in quality.with_metrics(docs).collect()}) == 3


def test_rules_keep_good_and_reject_bad(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(6000):
        bad = i % 10 == 0
        words = [r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(10**6)) for _ in range(30)]
        text = " | ".join(words) if bad else " ".join(words) + "."
        rows.append((i, text, "en" if i % 2 else None, 5))
        labels.append((i, int(not bad), 0))
    rows += [(10_000, None, None, None), (10_001, "few words", "xx", 1), (None, "x y " * 50, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_words int")
    labs = spark.createDataFrame(labels + [(77_777, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.quality_rules(docs, labs, risk=0.2).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] == bool(q) for i, q, _ in labels)
    assert got[10_000]["base_failed"] and got[10_001]["base_failed"] and got[None]["base_failed"]
    few = quality.quality_rules(docs, labs.limit(20)).collect()  # too few labels to certify anything
    assert all(x["kept"] != x["base_failed"] for x in few)
    assert quality.quality_rules(docs.limit(0), labs).count() == 0
    assert quality.quality_rules(docs, labs.limit(0)).filter("kept").count() == 6000


def test_sequential_test_stops():
    counts = [("s", "repeats", h, 1, 0, 5000) for h in (0, 1)] + [("s", "repeats", h, 0, 5, 100) for h in (0, 1)] + [("s", "repeats", 0, 1, 3, 400)]
    cut = quality.choose(counts, 0.08, 0.05, 1.0)
    assert ("s", "repeats") not in cut  # the laxest cutoffs already reject good documents too often
    assert quality.choose(counts[:4], 0.08, 0.05, 1.0)["s", "repeats"] == quality.SHARES[0]


FAKE = warc.record(999, "http://fake/", b"x" * 50, "0" * 40, None, "2024-01-01T00:00:00Z").decode()


def test_warc_round_trip(spark):
    long = "<p>" + "y" * 1200
    rows = [(i, f"http://h/{i}", f"<p>{i}" + "z" * (i * 37 % 3000)) for i in range(200)]
    rows += [(300, None, None), (301, "u", ""), (302, "u v", long), (303, "u", long), (304, "u", long), (305, "u", "short"), (306, "u", "short")]
    rows += [(310 + i, "u", FAKE * (i + 1)) for i in range(6)] + [(320, "u", warc.MAGIC.decode() * 99), (None, "u", long), (304, "u", long), (330, "u", "Q" * 30_000 + FAKE)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    files = warc.write_warc(pages)
    for chunk in (700, 4000, 1 << 20):
        got = warc.read_warc(files, chunk=chunk).collect()
        assert len(got) == len(rows)
        by = collections.defaultdict(list)
        for g in got:
            by[g["page_id"]].append(g)
        for i, _, html in rows:
            raw = (html or "").encode()
            for g in by[i]:
                assert (g["payload_bytes"], g["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
                revisit = html == long and i != 304
                assert g["record_type"] == ("revisit" if revisit else "response") and g["refers_to"] == (304 if revisit else None)
                assert g["payload"] == (None if revisit else raw)
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


@pytest.mark.parametrize("size, chunk", [(70_000, 700), (70_000, 4 << 20), (5_000_000, 100_000), (5_000_000, 4 << 20)])
def test_warc_heads_of_any_length(spark, size, chunk):
    rows = [(i, "http://h/" + "u" * (size if i % 3 == 0 else 5), FAKE[: 40 * i] + "p" * i) for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    got = {g["page_id"]: g for g in warc.read_warc(warc.write_warc(pages), chunk=chunk).collect()}
    assert {i: (g["url"], g["payload"]) for i, g in got.items()} == {i: (u, h.encode()) for i, u, h in rows}


def rows_of(stratum, good, level, n, rule="symbols"):
    return [(stratum, rule, h, good, level, n) for h in (0, 1)]


def test_thin_strata_get_rules_and_joint_risk_holds():
    # 250 good labels in the certifying half certify 0.02; a cut of the risk by rules needs 2,582.
    counts = rows_of("de", 1, 0, 250) + rows_of("de", 0, 5, 20) + rows_of("en", 1, 0, 900) + rows_of("en", 0, 5, 90) + rows_of("es", 1, 0, 30)
    cut = quality.choose(counts, 0.02, 0.05, 10.0)
    assert set(cut) == {("de", "symbols"), ("en", "symbols"), ("es", "symbols")}  # es by the pool
    assert quality.least_labels(3) == 217
    # The pool does not reach a stratum whose good labels speak against it.
    assert ("it", "symbols") not in quality.choose(counts + rows_of("it", 1, 5, 8), 0.02, 0.05, 1.0)
    # Two rules that reject 15 of 1,000 good documents each pass alone, jointly they do not.
    two = [("s", r, 0, g, lv, n) for r in ("symbols", "bangs") for g, lv, n in ((1, 0, 2970), (1, 9, 30))] + [("s", r, 1, g, lv, n) for r in ("symbols", "bangs") for g, lv, n in ((1, 0, 3000), (0, 9, 50))]

    def rest(paths):
        out = []
        for s in ("s", None):
            steps = dict(paths.get(s, ()))
            hit = [r for r in ("symbols", "bangs") if steps.get(r, 99) <= 9]
            for r in ("symbols", "bangs"):
                for _, rule, h, g, lv, n in two:
                    if rule == r and not (lv and r in hit):
                        other = next(x for x in ("symbols", "bangs") if x != r)
                        out.append((s, r, h, g, lv, n - (30 if (h, g, lv) == (0, 1, 0) and other in hit else 0)))
        return out

    assert len(quality.choose([], 0.02, 0.05, 1.0, rest)) == 1


def test_few_labels_reject_symbol_junk(spark):
    r = random.Random(5)
    rows, labels = [], []
    for i in range(1400):
        bad = i % 7 == 0
        words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(30)]
        rows.append((i, (" | " if bad else " ").join(words) + ".", "xx" if i % 35 in (0, 1) else "en"))
        labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows + [(5000, rows[0][1], "unlabelled")], "doc_id bigint, text string, lang string")
    got = {x["doc_id"]: x["kept"] for x in quality.quality_rules(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert got.pop(5000)  # no labels, no certificate
    assert got == {i: bool(q) for i, q in labels}


def plain_candidates(raw):
    out, at = {}, raw.find(warc.MAGIC)
    while at >= 0:
        try:
            head = warc.parse_head(raw, at)
        except warc.Incomplete:
            head = None
        if head:
            out[at] = head[2]
        at = raw.find(warc.MAGIC, at + 1)
    return out


def test_candidates_read_each_line_once():
    import random
    import time

    r = random.Random(1)
    parts = [warc.MAGIC, b"WARC-Type: response\r\n", b"Content-Length: 12\r\n", b"Content-Length: x\r\n", b"a:b\r\n", b"no colon\r\n", b"\r\n", b"\r\n\r\n", b"x", b":", b"A:" + warc.MAGIC]
    for _ in range(3000):
        raw = b"".join(r.choices(parts, k=r.randrange(30)))
        for cut in (len(raw), r.randrange(len(raw) + 1)):
            rest = [raw[cut:]] if cut < len(raw) else []
            stop = len(raw) if not rest else max(0, cut - len(warc.MAGIC))  # a range is read to a magic behind its end
            got = warc.candidates(raw[:cut], 0, stop, 0, lambda: rest.pop() if rest else b"")  # noqa: B023
            assert got == {a: b for a, b in plain_candidates(raw).items() if a < stop}, raw
    for line in (b"A:" + warc.MAGIC, warc.MAGIC, b"A:b\r\n" + warc.MAGIC):
        raw, began = line * (1_000_000 // len(line)), time.time()
        for tail in (b"", b"WARC-Type: x\r\nContent-Length: 3\r\n\r\n"):
            warc.candidates(raw + tail, 0, len(raw), 0)
        assert time.time() - began < 5
