"""Sections by heading level, and parent and child chunks made of them."""

import re
from collections import Counter
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import functions as F

from .chunking import pack_lines
from .store import chunk_id

# Where the items of a section begin, in the order they are tried.
ITEMS = [
    r"(?=\n\s*[-•]\s*（[一二三四五六七八九十]+）)",
    r"(?=\n\s*（[一二三四五六七八九十]+）)",
    r"(?=\n\s*[-•]\s*\d+[、.．])",
    r"(?=\n\s*\d+[、.．]\s*\S)",
]


HEADING = re.compile(r"#{1,6}\s+.+")


def without_front_matter(text):
    end = text.find("---", 3) if text.startswith("---") else -1
    return text[end + 3 :].strip() if end >= 0 else text


def headed(text):
    """[(level, heading, lines)]: heading lines cut the text; level 0 before the first of them."""
    out = []
    for line in re.split(r"\r\n?|\n", text):
        if HEADING.match(line):
            marks = line[: len(line) - len(line.lstrip("#"))]
            out.append((len(marks), line[len(marks) :].lstrip(), [line]))
        elif out:
            out[-1][2].append(line)
        else:
            out.append((0, "", [line]))
    return out


def level_to_split(levels):
    """3 with three third-level headings or more, else 4 with two fourth-level ones, else 2 with two
    second-level ones, else the most frequent level (the first seen of equals); 0 without headings."""
    counts = Counter(n for n in levels if n > 1)
    if not counts:
        return 0
    return next((n for n, least in ((3, 3), (4, 2), (2, 2)) if counts[n] >= least), max(counts, key=counts.get))


def sections_of(text):
    """[(heading, text, level)] of one document; see ``split_structure``."""
    body = without_front_matter(text or "")
    found = headed(body)
    level = level_to_split([n for n, _, _ in found])
    out, above, name = [], "", ""
    for depth, heading, lines in found if level else ():
        if depth == 1:
            continue
        inside = bool("".join(lines[1:]).strip())
        starts = 0 < depth <= level
        if 0 < depth < level:
            above, name = heading, heading if inside else name
        elif depth == level:
            name = f"{above} > {heading}" if above else heading
        if starts or not out:
            out.append((name if starts or out else "", []))
        if not 0 < depth < level or inside:
            out[-1][1].extend(lines)
    made = [(heading, "\n".join(lines).strip(), level) for heading, lines in out]
    return [m for m in made if m[1]] or [(found[0][1] if not level else "", body, 0)]


def split_structure(docs, id_col="source", text_col="markdown"):
    """Sections that begin at headings of the split level: ``p_idx``, ``heading``, ``text``, ``level``.

    Front matter and first-level sections go.  A higher heading closes the section before it;
    with a body it is a section of its own, without one it only names those that follow.  Lower
    headings stay inside.  Texts without sub-headings, or with nothing left, are one section.
    One pass over each text; nothing is shuffled."""

    @F.arrow_udf("array<struct<heading:string,text:string,level:int>>")
    def cut(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string()), ("level", pa.int32())]))
        return pa.array([[dict(zip(("heading", "text", "level"), s)) for s in sections_of(t)] for t in texts.to_pylist()], kind)

    return docs.select(id_col, F.posexplode(cut(F.col(text_col))).alias("p_idx", "s")).select(id_col, "p_idx", "s.*")


def items_of(text, pattern):
    """The stripped stretches between the places where items begin; blank ones go."""
    places = sorted({0, len(text), *(m.start() for m in re.finditer(pattern, text))})
    return [part for part in (text[a:b].strip() for a, b in pairwise(places)) if part]


def sub_sections(text, size=300, overlap=50):
    """A text of at most ``size`` characters whole.  Else its items, by the first kind of item that
    gives two or more of at most half as much again; else packed lines."""
    if len(text) <= size:
        return [text]
    kinds = (items_of(text, pattern) for pattern in ITEMS)
    return next((items for items in kinds if len(items) > 1 and all(2 * len(i) <= 3 * size for i in items)), None) or pack_lines(text, size, overlap)


def family(text, parent_size, child_size):
    """(p_idx, heading, pp_idx, c_idx or None, text) of the parents and children of one document."""
    for p, (heading, section, _) in enumerate(sections_of(text)):
        for pp, parent in enumerate(pack_lines(section, parent_size, 100) if 2 * len(section) > 3 * parent_size else [section]):
            yield p, heading, pp, None, parent
            for c, child in enumerate(sub_sections(parent, child_size)):
                yield p, heading, pp, c, child


def parent_child(docs, id_col="source", text_col="markdown", parent_size=1000, child_size=300):
    """Parents and children of every document's sections, with the other columns of ``docs``:
    ``id``, ``role``, ``parent_id`` (children), ``section_path``, ``p_idx``, ``pp_idx``, ``c_idx``, ``text``.
    One pass over each text; nothing is shuffled."""
    names = ("p_idx", "section_path", "pp_idx", "c_idx", "text")

    @F.arrow_udf("array<struct<p_idx:int,section_path:string,pp_idx:int,c_idx:int,text:string>>")
    def cut(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct(list(zip(names, (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())))))
        return pa.array([[dict(zip(names, f)) for f in family(t, parent_size, child_size)] for t in texts.to_pylist()], kind)

    rest = [c for c in docs.columns if c not in (id_col, text_col, "id", "role", "parent_id", *names)]
    rows = docs.select(id_col, *rest, F.explode(cut(F.col(text_col))).alias("f")).select(id_col, "f.*", *rest)
    parent, child = chunk_id(id_col, F.lit("parent"), "p_idx", "pp_idx"), chunk_id(id_col, F.lit("child"), "p_idx", "pp_idx", "c_idx")
    is_child = F.col("c_idx").isNotNull()
    return rows.select(F.when(is_child, child).otherwise(parent).alias("id"), F.when(is_child, "child").otherwise("parent").alias("role"), F.when(is_child, parent).alias("parent_id"), *rows.columns)
