"""Markdown tables inside texts: column functions, one row in, one row out."""

from pyspark.sql import functions as F

from .metadata import unfenced
from .text import col, join_lines, lines, strip


def extract_tables(c):
    """All runs of three or more lines between pipes, in text order."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(?m)(?:^[ ]*\|.+\|[ ]*(?:\n|\z)){3,}"), F.lit(0))
    return F.transform(runs, strip)


def cells(line):
    """Trimmed cells of a pipe line that are not empty."""
    return F.filter(F.transform(F.split(line, r"\|", -1), strip), lambda x: x != "")


def table_to_sentences(c, verb="为", comma="，", stop="。"):
    """A sentence a row: every cell behind its column's name.  Empty cells go before cells meet
    names.  Block quotes lose their marks; what is no table comes back as it is."""
    found = lines(strip(c))
    quote = join_lines(F.transform(F.filter(found, lambda x: strip(x) != ""), lambda x: strip(F.regexp_replace(x, r"^[> ]+", ""))))
    piped = F.filter(found, lambda x: F.startswith(strip(x), F.lit("|")))
    names = cells(F.try_element_at(piped, F.lit(1)))
    said = lambda row: F.filter(F.zip_with(names, cells(row), lambda n, v: F.concat(n, F.lit(verb), v)), lambda x: x.isNotNull())
    rows = F.filter(F.transform(F.slice(piped, F.lit(3), F.greatest(F.size(piped) - 2, F.lit(0))), said), lambda r: F.size(r) > 0)
    text = join_lines(F.transform(rows, lambda r: F.concat(F.array_join(r, comma), F.lit(stop))))
    return F.when(F.startswith(found[0], F.lit("> ")), quote).when((F.size(piped) < 3) | (text == ""), col(c)).otherwise(text)


def table_section(table, full, shown=50):
    """Nearest heading of level 1 to 4 before the place where the table's beginning first occurs."""
    start = F.replace(strip(F.left(col(table), F.lit(shown))), F.lit("> "), F.lit(""))
    at = F.position(start, col(full))
    heads = F.regexp_extract_all(F.left(col(full), F.greatest(at - 1, F.lit(0))), F.lit(r"(?m)^#{1,4}\s+.+$"), F.lit(0))
    last = strip(F.regexp_replace(F.try_element_at(heads, F.lit(-1)), r"^[# ]+", ""))
    return F.when(at > 0, F.coalesce(last, F.lit(""))).otherwise("")


def table_qk_reply(reply):
    """``questions`` and ``keywords`` of a model's reply; both empty on bad JSON."""
    got = F.from_json(unfenced(reply), "questions array<string>, keywords map<string,int>")
    return F.struct(F.coalesce(got["questions"], F.expr("cast(array() as array<string>)")).alias("questions"), F.coalesce(got["keywords"], F.expr("cast(map() as map<string,int>)")).alias("keywords"))
