"""Metadata by pattern: numbers, dates, authorities, regions, categories."""

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F

from .defaults import AUTHORITIES, CATEGORIES, TITLE_WORDS
from .scan import DATE, FIELDS, NUMBER, REGION, Scanner
from .text import col, first, let, lines, strip


def _found(c, pattern, group=0):
    return let(F.regexp_extract(c, pattern, group), lambda x: F.nullif(x, F.lit("")))


def normalize_date(c):
    """``2024 年 3 月 5 日`` to ``2024-03-05``; no range check."""
    return _iso(_found(col(c), DATE))


def _iso(date):
    """A date as DATE finds it, in ISO form; each pattern runs once."""
    wide = F.regexp_replace(date, DATE, "$1-0$2-0$3")
    return F.regexp_replace(wide, r"-0(\d\d)", "-$1")


def policy_number(c):
    return _found(F.left(col(c), F.lit(500)), NUMBER)


def issuing_authority(c, names=AUTHORITIES):
    """The first known name in the number's prefix, else in the head, else the source line."""
    known = F.array(*map(F.lit, names))
    named = lambda where: let(where, lambda w: first(F.filter(known, lambda a: F.contains(w, a))))
    prefix = F.split(policy_number(c), r"[〔\[]")[0]
    said = let(strip(F.regexp_extract(F.left(col(c), F.lit(300)), r"发布来源[:：][ \t]*(.+)", 1)), lambda x: F.nullif(x, F.lit("")))
    return F.coalesce(named(prefix), named(F.left(col(c), F.lit(500))), said)


def publish_date(c):
    """The last date of the tail, else the first of the head."""
    dates = lambda part: F.regexp_extract_all(part, F.lit(DATE), F.lit(0))
    last = F.try_element_at(dates(F.right(col(c), F.lit(500))), F.lit(-1))
    return _iso(F.coalesce(last, first(dates(F.left(col(c), F.lit(500))))))


def effective_date(c):
    """The date of the first ``自…起`` with the first of three verbs that occurs."""
    said = F.regexp_extract_all(col(c), F.lit(f"自{DATE}起(?:施行|执行|实施)"), F.lit(0))
    ends = lambda found, verb: first(F.filter(found, lambda x: F.endswith(x, F.lit(verb))))
    return _iso(_found(let(said, lambda found: F.coalesce(*(ends(found, verb) for verb in ("施行", "执行", "实施")))), DATE))


def expiry_date(c):
    return _iso(F.coalesce(_found(col(c), f"有效期至({DATE})", 1), _found(col(c), f"执行至({DATE})", 1), _found(col(c), f"有效期.*?({DATE})止", 1)))


def applicable_region(c):
    head = F.left(col(c), F.lit(500))
    place = _found(head, REGION, 1)
    return F.when(head.rlike("各省、自治区|全国|各地区"), F.lit("全国")).otherwise(place)


def guess_title(c, words=TITLE_WORDS, least=5, long=10):
    fits = lambda x: (F.length(x) >= least) & ~x.rlike(r"^\d{4}年") & (x.rlike("|".join(words)) | (F.length(x) >= long))
    return first(F.filter(F.transform(lines(c), strip), fits))


def classify_category(title, c, keywords=CATEGORIES, other="其他"):
    """The category with most distinct keywords in title and head; ties by order."""
    where = F.concat_ws(" ", col(title), F.left(col(c), F.lit(1000)))
    counts = let(where, lambda w: F.array(*(sum((F.contains(w, F.lit(k)).cast("int") for k in ws), F.lit(0)) for ws in keywords.values())))
    most = lambda n: F.when(F.array_max(n) == 0, F.lit(other)).otherwise(F.get(F.array(*map(F.lit, keywords)), F.array_position(n, F.array_max(n)).cast("int") - 1))
    return let(counts, most)


def missing_fields(fields):
    return F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in fields)))


def first_present(*cs):
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cs))


def unfenced(reply):
    """A model's reply without its code fence."""
    inner = F.regexp_extract(col(reply), r"(?s)```(?:json)?\s*(.*?)```", 1)
    return strip(F.when(inner != "", inner).otherwise(col(reply)))


def model_metadata_reply(reply, wanted):
    """The reply's non-null values for the wanted keys; null on bad JSON."""
    parsed = F.from_json(unfenced(reply), "map<string,string>")
    return F.map_filter(parsed, lambda k, v: F.array_contains(col(wanted), k) & v.isNotNull())


def reply_prompt(c, missing, head=1000, tail=500):
    """What is sent to a model for the missing fields: head and tail of the text; null where nothing is missing."""
    said = F.concat(F.lit("缺失字段: "), F.array_join(col(missing), ", "), F.lit("\n\n"), F.left(col(c), F.lit(head)))
    end = F.when(F.length(col(c)) > head, F.concat(F.lit("\n...\n"), F.right(col(c), F.lit(tail)))).otherwise("")
    return F.when(F.size(col(missing)) > 0, F.concat(said, end))


def merge_metadata(parsed, matched, replied, fields, id_col="source"):
    """``fields`` of every document of ``parsed``: its own value first, then that of ``matched`` (by
    pattern), then of ``replied`` (by a model); empty counts as missing.  The tables share
    ``id_col`` and may lack fields."""

    def side(rows, name):
        return rows.select(id_col, *(F.col(f).alias(f"{name}_{f}") for f in fields if f in rows.columns))

    joined = side(parsed, "p").join(side(matched, "m"), id_col, "left").join(side(replied, "r"), id_col, "left")
    values = lambda f: [F.col(f"{n}_{f}").cast("string") for n in "pmr" if f"{n}_{f}" in joined.columns] or [F.lit(None).cast("string")]
    return joined.select(id_col, *(first_present(*values(f)).alias(f) for f in fields))


def extract_metadata(docs, text_col="text", title_words=TITLE_WORDS, names=AUTHORITIES, categories=CATEGORIES, other="其他"):
    """The eight fields of every document, as columns beside those of ``docs``: one pass over each
    text in Arrow batches (``scan.Scanner``); only the texts go to Python.  Null where there is
    none; all null for a null text."""
    struct = ", ".join(f"{f} string" for f in FIELDS)
    settings = tuple(names), tuple((k, tuple(v)) for k, v in categories.items()), tuple(title_words), other

    @F.arrow_udf(f"struct<{struct.replace(' string', ':string')}>")
    def found(texts: pa.Array) -> pa.Array:
        scan = _scanner(*settings).fields
        rows = [scan(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)] or [pa.array([], pa.string())] * len(FIELDS), list(FIELDS))

    rows = docs.drop(*FIELDS).withColumn("_found", found(F.col(text_col)))
    return rows.select(*(c for c in rows.columns if c != "_found"), "_found.*")


@lru_cache(maxsize=4)
def _scanner(names, categories, title_words, other):
    return Scanner(names, dict(categories), title_words, other)
