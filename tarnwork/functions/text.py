"""Cleaning and normalising of texts: column functions, one row in, one row out."""

from pyspark.sql import functions as F

from .defaults import TEXT_NOISE, any_of


def col(c):
    return F.col(c) if isinstance(c, str) else c


def let(c, use):
    """``use`` of a column that is computed once per row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(col(c)), use), F.lit(0))


def strip(c):
    """Without white space at both ends."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def lines(c):
    return F.split(F.regexp_replace(col(c), r"\r\n?", "\n"), "\n", -1)


def join_lines(a):
    return F.array_join(a, "\n")


def first(a):
    return F.try_element_at(a, F.lit(1))


def compress_blank_lines(c):
    return F.regexp_replace(col(c), r"\n{3,}", "\n\n")


def clean_markdown(c):
    """Wide blanks made plain, line ends trimmed, blank lines compressed, ends stripped."""
    plain = F.replace(col(c), F.lit("　"), F.lit(" "))
    return strip(compress_blank_lines(F.regexp_replace(plain, r"(?m)[ \t]+$", "")))


def txt_normalize(c):
    """Stripped lines that are not blank."""
    return join_lines(F.filter(F.transform(lines(c), strip), lambda x: x != ""))


def txt_title(c, stem):
    return F.coalesce(first(F.filter(F.transform(lines(c), strip), lambda x: x != "")), col(stem))


def noise_lines(c, pattern=any_of(TEXT_NOISE)):
    """Without the lines that begin like ``pattern``; blank lines stay, leading ones go."""
    kept = F.filter(lines(c), lambda x: ~strip(x).rlike(f"^(?:{pattern})"))
    return F.regexp_replace(join_lines(kept), r"^(?:[ \t]*\n)+", "")


def publish_source(c, label="发布来源"):
    return F.nullif(strip(F.regexp_extract(col(c), rf"{label}[:：][ \t]*(.+)", 1)), F.lit(""))


def md_standardize(c, label="发布来源", most=50):
    """Bold lines to headings, the source line dropped, blank lines compressed."""
    bold = r"^\*\*(.+)\*\*$"

    def line(x):
        s = strip(x)
        inner = F.regexp_extract(s, bold, 1)
        numbered = s.rlike(r"^\*\*[一二三四五六七八九十]+、.*\*\*$")
        short = (inner != "") & (F.length(inner) < most) & ~F.contains(inner, F.lit("。"))
        return F.when(numbered, F.concat(F.lit("\n#### "), inner)).when(short, F.concat(F.lit("\n### "), inner)).otherwise(x)

    kept = F.filter(lines(c), lambda x: ~strip(x).rlike(f"^{label}[:：]"))
    return compress_blank_lines(join_lines(F.transform(kept, line)))


def md_title(c, stem, noise, label="发布来源"):
    """Text of the first line that is not noise, if it is a heading or no source line."""
    said = F.filter(F.transform(lines(c), strip), lambda x: (x != "") & ~x.rlike(f"^(?:{noise})"))
    heading = first(F.filter(said, lambda x: x.rlike("^# ")))
    plain = first(F.filter(said, lambda x: ~x.rlike(f"^{label}")))
    return F.coalesce(F.when(first(said) == heading, strip(F.regexp_replace(heading, "^[# ]+", ""))), plain, col(stem))


OUTLINE = [
    (r"^第[一二三四五六七八九十百]+章\s", "\n## "),
    (r"^第[一二三四五六七八九十百]+条\s", "\n### "),
    (r"^[一二三四五六七八九十]+、", "\n#### "),
    (r"^（[一二三四五六七八九十]+）", "\n- "),
    (r"^\d+[.、]", "- "),
]


def outline_to_markdown(c):
    """Chapters, articles and items of plain text as headings and lists; the first rule wins."""

    def line(x):
        s = strip(x)
        out = F
        for pattern, mark in OUTLINE:
            out = out.when(s.rlike(pattern), F.concat(F.lit(mark), s))
        return out.otherwise(s)

    kept = F.filter(lines(c), lambda x: ~strip(x).rlike(r"^\d{1,3}$"))
    return join_lines(F.transform(kept, line))


def cells_to_table(rows):
    """Markdown table of array<array<string>>: short rows padded, nulls empty, line feeds blanked;
    a single column becomes a block quote."""
    rows = col(rows)
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" "))
    full = F.transform(rows, lambda r: F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    body = F.transform(F.slice(full, F.lit(2), F.greatest(F.size(full) - 1, F.lit(0))), line)
    table = F.concat(line(first(full)), F.lit("\n"), rule, F.when(F.size(full) > 1, F.concat(F.lit("\n"), F.array_join(body, "\n"))).otherwise(""))
    quote = F.array_join(F.transform(full, lambda r: F.concat(F.lit("> "), first(r))), "\n>\n")
    return F.when(width == 1, quote).when(F.size(rows) > 0, table).otherwise("")


FIELDS = ["title", "source", "file_type", "policy_number", "issuing_authority", "publish_date", "effective_date", "expiry_date", "applicable_region", "category"]


def frontmatter(fields=FIELDS):
    """YAML header of the fields in order; nulls left out, values quoted where needed."""

    def entry(f):
        v = F.col(f)
        quoted = F.contains(v, F.lit(": ")) | F.contains(v, F.lit('"')) | F.contains(v, F.lit("'"))
        return F.when(v.isNotNull(), F.concat(F.lit(f"{f}: "), F.when(quoted, F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)))

    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*map(entry, fields))), "\n"), F.lit("\n---"))


def final_document(body, fields=FIELDS):
    return F.concat(frontmatter(fields), F.lit("\n\n"), clean_markdown(body), F.lit("\n"))


# References decoded in texts, the ampersand last.
REFERENCES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def decode(c):
    for name, char in REFERENCES.items():
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def html_text(c):
    """Text nodes of a page without scripts, styles and navigation; a line each."""
    bare = F.regexp_replace(col(c), r"(?is)<(script|style|nav|footer|header)\b.*?</\1>", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", "\n")
    return txt_normalize(decode(bare))


def html_title(c, stem):
    inner = lambda tag: F.nullif(strip(F.regexp_extract(col(c), rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)), F.lit(""))
    return F.coalesce(decode(inner("title")), decode(inner("h1")), col(stem))
