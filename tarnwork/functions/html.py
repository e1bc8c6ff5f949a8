"""Web pages to Markdown, their meta tags, and tables of layout.  A null page gives null."""

import pyarrow as pa
from pyspark.sql import functions as F

from .defaults import PAGE_NOISE, any_of
from .markdown import markdown
from .text import col, compress_blank_lines, decode, html_title, noise_lines, strip

# The names of meta tags that are read, and the field each fills.
META = {"publishdate": "publish_date", "publish-date": "publish_date", "date": "publish_date", "author": "author", "source": "author", "keywords": "keywords", "description": "description"}


def plain(c):
    """Text of a fragment: tags to blanks, references decoded, white space compressed."""
    return strip(F.regexp_replace(decode(F.regexp_replace(c, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def html_meta(c):
    """Map of the fields that ``META`` names; the last tag of a field wins, empty ones are skipped."""
    tags = F.regexp_extract_all(col(c), F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))

    def attribute(tag, name):
        return F.coalesce(*(F.nullif(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*{q}(.*?){q}", 1), F.lit("")) for q in "\"'"), F.lit(""))

    names = F.create_map(*(F.lit(x) for pair in META.items() for x in pair))
    found = F.transform(tags, lambda t: F.struct(F.try_element_at(names, F.lower(attribute(t, "name"))).alias("key"), strip(decode(attribute(t, "content"))).alias("value")))
    found = F.filter(found, lambda e: e["key"].isNotNull() & (e["value"] != ""))
    last = F.filter(found, lambda e, i: ~F.exists(F.slice(found, i + 2, F.greatest(F.size(found) - i - 1, F.lit(0))), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def table_cells(c):
    """The cells of a table's rows as array<array<string>>."""
    rows = F.regexp_extract_all(c, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr\s*>|<tr\b|</table\s*>)"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]\s*>|<t[dh]\b|$)"), F.lit(1)), plain))


def is_layout_table(c, longest=200):
    """True for tables without header cells that have no row, or none of more than two cells
    and a cell longer than ``longest`` characters."""
    rows = table_cells(col(c))
    wide = F.exists(rows, lambda r: F.size(r) > 2)
    long = F.exists(rows, lambda r: F.exists(r, lambda x: F.length(x) > longest))
    return ~col(c).rlike(r"(?i)<th\b") & ((F.size(rows) == 0) | (~wide & long))


def html_markdown(c, stem, noise=any_of(PAGE_NOISE)):
    """Markdown of a page (``markdown.markdown``); lines that begin like ``noise`` go; the title
    leads.  Null for a null page."""

    @F.arrow_udf("string")
    def body(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else markdown(p) for p in pages.to_pylist()], pa.string())

    text = strip(compress_blank_lines(noise_lines(body(col(c)), noise)))
    title = html_title(c, stem)
    return F.when(F.startswith(text, F.concat(F.lit("# "), title)), text).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), text))
