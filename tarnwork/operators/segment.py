"""Tokens of texts, with Han runs cut by the most probable path through a word lattice.

``Segmenter`` takes a dictionary of words with counts, given or learnt from a corpus
(``learn_words``).  Every dictionary word that occurs at a place of a Han run is an edge, every
single character is one too, and dynamic programming finds the path of highest probability.
Words of ``additions`` get just the count that makes them win against their own cuts.  Without
a dictionary, a run is cut at the longest addition, and into pairs between such words, as
``lexical.tokenize`` does."""

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F

# Words of the field that a run of Han characters is searched for first.
HAN_WORDS = (
    "中小微企业", "中小企业", "专精特新", "小巨人", "贷款贴息", "融资担保", "融资租赁", "政府性融资担保", "设备更新", "技术改造", "产业升级",
    "工业互联网", "人工智能", "新质生产力", "新型工业化", "跨境电商", "跨境电子商务", "企业年金", "社保", "养老保险", "固体废物", "循环利用",
    "科技创新", "知识产权", "增值税", "消费税", "所得税", "进口关税", "工信部", "财政部", "科技部", "发改委", "国务院", "海关总署", "税务总局",
    "金融监管总局",
)

PLAIN = re.compile(r"[^\W_]{2,}").findall
WIDE = re.compile("[⺀-\U0003ffff]").search
RUN_LIMIT = 5000  # characters of a run whose lattice is held at once; longer runs are cut there
MOST_WORDS = 500_000


def best_path(run, edges, cost_of_one):
    """The words of the cheapest path through ``run``.  ``edges(run, start)`` gives (end, cost)
    of the words that start there; a single character costs ``cost_of_one(char)``."""
    n = len(run)
    cost, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for start in range(n):
        here = cost[start]
        total = here + cost_of_one(run[start])
        if total < cost[start + 1]:
            cost[start + 1], back[start + 1] = total, start
        for end, c in edges(run, start):
            if here + c < cost[end]:
                cost[end], back[end] = here + c, start
    out = []
    while n:
        out.append(run[back[n] : n])
        n = back[n]
    return out[::-1]


class Segmenter:
    """``tokens(text)``: letters and digits in runs of two or more, Han runs cut into words,
    numbers left out."""

    def __init__(self, words=None, additions=HAN_WORDS):
        import regex

        known = "|".join(map(re.escape, sorted(additions, key=lambda w: (-len(w), w)))) or "(?!)"
        self.pairs = regex.compile(rf"({known})|((?:(?!{known})\p{{Han}})+)|((?:(?!\p{{Han}})[\p{{L}}\p{{N}}])+)").finditer
        self.mixed = regex.compile(r"(\p{Han}+)|((?:(?!\p{Han})[\p{L}\p{N}])+)").finditer
        self.costs = {}
        if words:
            total = sum(words.values())
            self.costs = {w: math.log(total / n) for w, n in words.items() if n > 0}
            self.one = math.log(total) + 1.0  # of a character that the dictionary lacks
            self.longest = max(map(len, self.costs))
            for word in additions:
                rest = self.price(self.cut(word)) if word not in self.costs else 0
                self.costs[word] = min(self.costs.get(word, math.inf), rest - 1e-9)
                self.longest = max(self.longest, len(word))

    def price(self, words):
        return sum(self.costs.get(w, self.one) for w in words)

    def edges(self, run, start):
        get = self.costs.get
        for end in range(start + 2, min(start + self.longest, len(run)) + 1):
            c = get(run[start:end])
            if c is not None:
                yield end, c

    def cut(self, run):
        return [w for a in range(0, len(run), RUN_LIMIT) for w in best_path(run[a : a + RUN_LIMIT], self.edges, lambda c: self.costs.get(c, self.one))]

    def runs(self, text):
        if self.costs:
            for m in self.mixed(text):
                yield from self.cut(m.group(1)) if m.group(1) else (m.group(),)
            return
        for m in self.pairs(text):
            run = m.group(2)
            yield from [run[i : i + 2] for i in range(len(run) - 1)] if run and len(run) > 2 else (m.group(),)

    def tokens(self, text):
        if not text:
            return []
        found = [w for w in self.runs(text) if len(w) >= 2] if WIDE(text) else PLAIN(text)
        return [w for w in found if not (w[0] <= "9" and w.isascii() and w.isdigit())]


@lru_cache(maxsize=2)
def shared(words, additions):
    """The worker's own segmenter; ``words``: pairs of word and count."""
    return Segmenter(dict(words), additions)


def tokens(c, words=None, additions=HAN_WORDS):
    """A column of tokens (array<string>), cut by ``words`` (word -> count)."""
    fixed = tuple(sorted((words or {}).items()))

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        cut = shared(fixed, tuple(additions)).tokens
        return pa.array([cut(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(F.col(c) if isinstance(c, str) else c)


def gram_counts(docs, text_col="text", longest=4, held=500_000):
    """``gram``, ``n``: how often each run of up to ``longest`` + 1 Han characters occurs, from
    counts inside the tasks that are passed on whenever they grow to ``held`` entries."""

    def count(batches):
        import regex

        runs, counts = regex.compile(r"\p{Han}+").findall, Counter()

        def batch():
            return pa.RecordBatch.from_pydict({"gram": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

        for part in batches:
            for text in part.column(0).to_pylist():
                for run in runs(text or ""):
                    for size in range(1, longest + 2):
                        for at in range(0, len(run) - size + 1, 4096):
                            counts.update(run[i : i + size] for i in range(at, min(at + 4096, len(run) - size + 1)))
                            if len(counts) > held:
                                yield batch()
                                counts.clear()
        if counts:
            yield batch()

    return docs.select(text_col).mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def learn_words(docs, text_col="text", longest=4, least=5, cohesion=8.0, freedom=0.8, most=MOST_WORDS):
    """``word``, ``n``: single characters, and runs of 2 to ``longest`` that occur ``least``
    times, whose count is ``cohesion`` times what each cut into two parts would give by chance,
    and whose neighbours on either side have an entropy of ``freedom`` (the ends of runs count as
    neighbours of their own).  At most ``most`` rows, the most frequent."""
    grams = gram_counts(docs, text_col, longest).filter(F.col("n") >= 1)
    size = F.length("gram")
    total = grams.filter(size == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    words = grams.filter((size >= 2) & (size <= longest) & (F.col("n") >= least)).select(F.col("gram").alias("word"), "n")
    for cut in range(1, longest):
        left = grams.select(F.col("gram").alias("_a"), F.col("n").alias("_na"))
        right = grams.select(F.col("gram").alias("_b"), F.col("n").alias("_nb"))
        split = words.withColumns({"_a": F.left("word", F.lit(cut)), "_b": F.substr("word", F.lit(cut + 1))})
        joined = split.join(left, "_a").join(right, "_b", "left")
        chance = F.col("_na").cast("double") * F.col("_nb") / F.lit(float(max(total, 1)))
        words = joined.filter(F.col("_nb").isNull() | (F.col("n") >= F.lit(cohesion) * chance)).select("word", "n")
    for side in (F.left("gram", size - 1), F.right("gram", size - 1)):
        longer = grams.filter(size >= 3).select(side.alias("word"), F.col("n").alias("m"))
        spread = longer.groupBy("word").agg(F.sum("m").alias("inner"), F.sum(F.col("m") * F.ln("m")).alias("mlm"))
        # Entropy of the neighbours; each occurrence at the end of a run is a neighbour of its own.
        entropy = F.ln("n") - F.coalesce("mlm", F.lit(0.0)) / F.col("n")
        words = words.join(spread, "word", "left").filter(entropy >= freedom).select("word", "n")
    ones = grams.filter(size == 1).select(F.col("gram").alias("word"), "n")
    return words.unionByName(ones).orderBy(F.desc("n"), "word").limit(most)
