"""Quality rules whose cutoffs carry a guarantee on false rejections.

Every text gets its metrics.  Labelled documents are halved by a hash of their text, so that copies share a half.
One half chooses: each stratum gets a path of steps, a step being a rule and a cutoff
of its fixed grid.  Each step is the one that rejects most of the bad documents still
there, good ones counting ``good_weight`` times, until none helps; ties go to the
laxest.  The other half certifies the path from its first step on: a step stands when
the exact binomial probability that all steps so far jointly reject so few good
documents, were the true rate ``risk``, is at most ``confidence / (strata + 1)``
(Bonferroni); testing stops at the first that fails, so a path needs no further
correction.  With probability ``1 - confidence`` every certified path rejects at most a
share ``risk`` of the good documents that it was certified on.

All strata together form one more path, the pool.  A stratum without a step of its own
(it has too few labels, see ``least_labels``) takes the certified steps of the pool, as
many as its own good labels do not contradict (rejected so often with a probability
below ``confidence``, were the rate ``risk``).  The pool's bound holds for the good
documents of all strata together, not for each.  A stratum without labels has no rule.

Nulls: a null text has no words; a null stratum is a stratum of its own; labels that
are null or of unknown documents are ignored, of several labels of a document the
worst counts.  Repeated rows are judged alike; empty tables give empty results.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WordCodes, shingle_hashes, stage

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
UPPER = bytes(range(65, 91))
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

# Rules: value of a row (larger is worse) and its grid of cutoffs, lax to strict.
# A row is rejected when its value exceeds the cutoff.
SHARES = [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05]
RULES = {
    "symbols": ("n_symbols / n_words", [2.0, 1.0, 0.7, *SHARES[4:], 0.02]),
    "bangs": ("n_bangs / n_words", [2.0, 1.5, 1.0, 0.7, *SHARES[4:], 0.02]),
    "capitals": ("n_capitals / word_chars", SHARES),
    "duplicate_lines": ("n_dup_lines / n_lines", SHARES),
    "repeats": ("n_repeat_words / n_words", SHARES),
    "stutter": ("n_stutter / n_words", SHARES),
    "unended_lines": ("n_unended / n_lines", SHARES),
    "word_length": ("word_chars / n_words", [30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0]),
}
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_capitals", "n_lines", "n_stutter", "n_unended"]


def measure(text, codes):
    """The metrics of one text, in the order of METRICS."""
    if not text:
        return (0,) * len(METRICS)
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and x.strip()]
    n = len(words)
    repeated = stutter = 0
    if n:
        c = codes.of(words)
        stutter = int((c[1:] == c[:-1]).sum())
        if n > WINDOW:
            h = shingle_hashes(c, WINDOW)
            order = np.argsort(h, kind="stable")
            s = h[order]
            same = s[1:] == s[:-1]
            if same.any():
                twice = np.zeros(len(h) + 1, np.int64)
                twice[order[1:][same]] = 1
                twice[order[:-1][same]] = 1
                starts = np.flatnonzero(twice)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + WINDOW, -1)
                repeated = int((np.cumsum(edge)[:n] > 0).sum())
    return (
        n,
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        text.count("!"),
        len(raw) - len(raw.translate(None, UPPER)),
        len(lines),
        stutter,
        sum(x.rstrip()[-1:] not in b".!?" for x in lines),
    )


@F.arrow_udf(StructType([StructField(m, LongType()) for m in METRICS]))
def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The metrics of a column of texts, as a struct."""
    codes = WordCodes()
    for texts in batches:
        rows = [measure(t, codes) for t in (x.as_py() for x in texts)]
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(METRICS))], METRICS)


def with_metrics(docs, id_col="doc_id", text_col="text", stratum_col="lang", carry=()):
    """One row a document: ``doc_id``, ``stratum`` (empty for null, else ``=`` and the value),
    ``half``, METRICS and, if ``carry`` names columns, ``carried``: a struct of them.  Only
    the text goes through Python.  Texts that are equal are in the same half."""
    stratum = F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit(""))
    half = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(2)).cast("int")
    carried = [F.struct(*carry).alias("carried")] if carry else []
    picked = docs.select(F.col(id_col).alias("doc_id"), stratum.alias("stratum"), half.alias("half"), measured(F.col(text_col)).alias("metrics"), *carried)
    return picked.select("doc_id", "stratum", "half", "metrics.*", *(["carried"] if carry else []))


def value(rule):
    top, bottom = RULES[rule][0].split(" / ")
    return F.coalesce(F.expr(f"try_divide({top}, {bottom})"), F.lit(0.0))


def beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (Lentz's evaluation)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out, m = d, 1
    while True:
        change = 1.0
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            change = c * d
            out *= change
        if abs(change - 1) < 1e-14:
            return out
        m += 1


def binomial_tail(k, n, p):
    """P(X <= k) of n trials with probability p: the regularised incomplete beta function
    of 1 - p with parameters n - k and k + 1.  Time grows with the root of n at most."""
    if k < 0:
        return 0.0
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    front = math.exp(math.lgamma(n + 1) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * beta_fraction(a, b, x) / a)
    return max(0.0, 1.0 - front * beta_fraction(b, a, 1 - x) / b)


def least_labels(strata, risk=0.02, confidence=0.05):
    """Good labels that certify a path in the certifying half if it rejects none of them."""
    return math.ceil(math.log(confidence / (strata + 1)) / math.log1p(-risk))


def without_overlap(counts):
    """``rest`` of ``choose`` for rows of which each is a group of documents that exceed
    cutoffs of one rule alone."""

    def rest(paths):
        for row in counts:
            for s in (row[0], None):
                if row[4] < dict(paths.get(s, ())).get(row[1], math.inf):
                    yield (s, *row[1:])

    return rest


def choose(counts, risk, confidence, good_weight, rest=None, grids=None):
    """(stratum, rule) -> cutoff, from rows (stratum, rule, half, good, level, n): how many
    labelled documents reach each level, that is, exceed the first ``level`` cutoffs of
    ``grids[rule]`` (the grids of RULES by default) and no other.

    ``rest(paths)`` gives these rows for the documents that no step rejects, ``paths``
    mapping a stratum to its steps (rule, level); the pool's stratum is None."""
    rest = rest or without_overlap(counts)
    grids = grids or {r: RULES[r][1] for r in RULES}

    def tally(paths):
        table = {}
        for stratum, rule, half, good, level, n in rest(paths):
            cell = table.setdefault(stratum, {}).setdefault(rule, np.zeros((2, 2, len(grids[rule]) + 1), np.int64))
            cell[half, good, level] += n
        return table

    def left(cells, half, good):
        return max((int(c[half, good].sum()) for c in cells.values()), default=0)

    first = table = tally({})
    total = {s: np.array([[left(cells, h, g) for g in (0, 1)] for h in (0, 1)]) for s, cells in first.items()}
    named = sorted(s for s in first if s is not None)
    alpha = confidence / (len(named) + 1)
    paths, certified = {s: [] for s in first}, {s: [] for s in first}
    going = sorted(first, key=lambda s: (s is None, s or ""))
    while going:
        stepped = []
        for s in going:
            best = (0.0, None)
            for rule in (r for r in RULES if r in table.get(s, {})):
                cell = table[s][rule][1]
                over = cell[:, ::-1].cumsum(-1)[:, ::-1]  # over[g, j]: exceed the first j cutoffs at least
                for _, j in sorted(((c, j) for j, c in enumerate(grids[rule], 1)), reverse=True):
                    gain = over[0, j] / max(1, total[s][1, 0]) - good_weight * over[1, j] / max(1, total[s][1, 1])
                    if gain > best[0] + 1e-12:
                        best = (gain, (rule, j))
            if best[1] is not None:
                paths[s].append(best[1])
                stepped.append(s)
        going = []
        if stepped:
            table = tally({s: paths[s] for s in first})
            for s in stepped:
                n = int(total[s][0, 1])
                if n and binomial_tail(n - left(table.get(s, {}), 0, 1), n, risk) <= alpha:
                    certified[s] = list(paths[s])
                    going.append(s)
    thin, pool = [s for s in named if not certified[s]], certified.get(None, [])
    for k in range(len(pool), 0, -1):
        table = tally({s: pool[:k] for s in thin}) if thin else {}
        for s in thin:
            n = int(total[s][:, 1].sum())
            k_rejected = n - left(table.get(s, {}), 0, 1) - left(table.get(s, {}), 1, 1)
            if not k_rejected or 1 - binomial_tail(k_rejected - 1, n, risk) >= confidence:
                certified[s] = pool[:k]
        thin = [s for s in thin if not certified[s]]
    # A later step of a rule is stricter, so it replaces the earlier one.
    return {(s, rule): grids[rule][j - 1] for s in named for rule, j in certified[s]}


def calibrate(measured, labels, id_col="doc_id", risk=0.02, confidence=0.05, good_weight=10.0):
    """Cutoffs per stratum and rule.  What reaches the driver are tables of counts by
    stratum, rule, half, label and level, one a step of the longest path; strata are few
    (languages)."""
    label = labels.filter(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min("quality").cast("int").alias("good"))
    levels = [sum(((value(r) > c).cast("int") for c in RULES[r][1]), F.lit(0)) for r in RULES]
    groups = (
        measured.filter(base_passed())
        .join(label.filter(F.col("good").isin(0, 1)), "doc_id")
        .groupBy("stratum", "half", "good", F.array(*levels).alias("levels"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    groups = stage(groups, "quality-levels")
    both = groups.withColumn("stratum", F.explode(F.array("stratum", F.lit(None).cast("string"))))
    names = F.array(*map(F.lit, RULES))

    def rest(paths):
        gone = F.lit(False)
        for s, steps in paths.items():
            for rule, j in dict(steps).items():
                gone = gone | (F.col("stratum").eqNullSafe(F.lit(s)) & (F.col("levels")[list(RULES).index(rule)] >= j))
        found = both.filter(~gone).select("*", F.posexplode("levels").alias("at", "level"))
        found = found.groupBy("stratum", names[F.col("at")].alias("rule"), "half", "good", "level").agg(F.sum("n").alias("n"))
        return [tuple(r) for r in found.toLocalIterator()]

    # A document that exceeds some cutoffs exceeds the strictest ones.
    return choose([], risk, confidence, good_weight, rest, {r: RULES[r][1][::-1] for r in RULES})


def base_passed():
    return (F.col("n_words") >= MIN_WORDS) & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(measured, cutoffs):
    """Adds ``base_failed`` and ``kept``."""
    broken = F.lit(False)
    for (stratum, rule), cutoff in sorted(cutoffs.items()):
        broken = broken | ((F.col("stratum") == stratum) & (value(rule) > F.lit(cutoff)))
    return measured.withColumn("base_failed", ~base_passed()).withColumn("kept", base_passed() & ~broken)


def quality_rules(docs, labels, id_col="doc_id", text_col="text", stratum_col="lang", risk=0.02, confidence=0.05, good_weight=10.0):
    """One row a document: id, METRICS, ``base_failed``, ``kept``."""
    found = stage(with_metrics(docs, id_col, text_col, stratum_col), "quality-metrics")
    cutoffs = calibrate(found, labels.withColumnRenamed(id_col, "doc_id"), "doc_id", risk, confidence, good_weight)
    return judge(found, cutoffs).drop("half").withColumnRenamed("doc_id", id_col)


def keep_good(docs, labels, id_col="doc_id", text_col="text", stratum_col="lang", risk=0.02, confidence=0.05, good_weight=10.0):
    """The documents that the rules keep, with all their columns.  Texts are measured twice
    (for the cutoffs, then to filter): that costs less than to store or shuffle them."""
    found = with_metrics(docs, id_col, text_col, stratum_col)
    cutoffs = calibrate(found, labels.withColumnRenamed(id_col, "doc_id"), "doc_id", risk, confidence, good_weight)
    return judge(with_metrics(docs, id_col, text_col, stratum_col, docs.columns), cutoffs).filter("kept").select("carried.*")
