"""A page's Markdown, by one pass over its tags with a stack of open elements.

The pass is linear in the page whatever its markup: text goes out as soon as a block ends, and
nothing is copied when an element closes.  End tags close what is still open inside their
element, up to the table cell they stand in; end tags without a start are passed over.  List
items and cells end where the next begins, paragraphs where any block begins.

Headings, paragraphs, nested lists and quotes (their marks are shown to a depth of DEPTH), bold,
italic and code, preformatted blocks with their white space, rules and data tables become
Markdown.  Links keep their text, images go, layout tables become lines, a table that holds
another counts as layout.  Scripts, styles, navigation, headers, footers and asides are dropped;
what a page has before its body tag is dropped too."""

import re
from html import unescape

SILENT = {"script", "style", "nav", "footer", "header", "aside", "iframe", "head", "title", "noscript", "template"}
RAW = {"script", "style", "title", "iframe", "template", "noscript"}
BLOCKS = {"p", "div", "section", "article", "main", "form", "figure", "figcaption", "address", "fieldset", "details", "summary", "center", "caption"}
FLOW = {"dl", "dt", "dd", "hr", "html", "body"}
HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`"}
TABLE_PARTS = {"table", "tr", "td", "th", "thead", "tbody", "tfoot"}
DEPTH, LONGEST_CELL = 32, 200
INLINE = {*MARKS, "br"}
OPENERS = {*BLOCKS, *FLOW, *HEADINGS, "ul", "ol", "li", "blockquote", "pre"}
KNOWN = SILENT | INLINE | TABLE_PARTS | OPENERS  # tags of any other name change nothing
PIECE = re.compile(r"([^<]*+)(?:<(/?)([a-zA-Z][a-zA-Z0-9]*+)[^>]*+>)?")
CLOSES = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}


def squeezed(text):
    return " ".join(text.split())


def pieces(page):
    """(text, mark of an end tag or "", name of a known tag or None) of a page, in linear time: the
    text before each tag, and the tag."""
    at, absent, match = 0, set(), PIECE.match

    while at < len(page):
        found = match(page, at)
        text, slash, name = found.groups()
        at = found.end()
        if name is not None:
            if name not in KNOWN:
                name = name.lower()
            if name in KNOWN:
                yield text, slash, name
            elif text:
                yield text, "", None
            if name in RAW and not slash and name not in absent:
                close = CLOSES[name].search(page, at)
                if close:
                    at = close.start()
                else:  # what was once not found is not looked for again
                    absent.add(name)
            continue
        if text:
            yield text, "", None
        if at == len(page):
            return
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
        elif page[at + 1 : at + 2] in ("!", "?", "/") or page[at + 1 : at + 2].isascii() and page[at + 1 : at + 2].isalpha():
            end = page.find(">", at)
            if end < 0:
                yield page[at:], "", None
                return
            at = end + 1
        else:
            yield "<", "", None
            at += 1


class Table:
    def __init__(self, height):
        self.rows, self.cell, self.headed, self.flow, self.height = [], None, False, False, height

    def end_cell(self):
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(squeezed("".join(self.cell)))
            self.cell = None

    def lines(self):
        """Its Markdown as lines; the texts of its cells where it is layout."""
        rows = [r for r in self.rows if r]
        layout = not self.headed and (not rows or (all(len(r) <= 2 for r in rows) and any(len(c) > LONGEST_CELL for r in rows for c in r)))
        if layout or self.flow:
            return [c for r in rows for c in r if c]
        width = max(map(len, rows), default=0)
        if width <= 1:
            return [x for r in rows for x in (">", f"> {r[0]}")][1:]
        full = [r + [""] * (width - len(r)) for r in rows]
        shown = ["| " + " | ".join(r) + " |" for r in full]
        return [shown[0], "| " + " | ".join(["---"] * width) + " |", *shown[1:]]


class Page:
    """The state of one pass."""

    def __init__(self):
        self.stack, self.counts, self.silent = [], [{}], 0
        self.begin()

    def begin(self):
        self.out, self.around, self.shown, self.root = [], [], [], None
        self.segments, self.marks, self.head = [[]], {}, ""
        self.tables, self.lists, self.pre = [], [], None
        self.loose = {"name": "ul", "item": 0}  # of items outside any list

    # -- output

    def block(self, lines):
        """Adds a block; the open quotes and items lead its lines, an item's mark its first line."""
        if not lines:
            return
        out, around = self.out, self.around[:DEPTH]
        if not around:
            if out:
                out.append("")
            out.extend(line.rstrip() for line in lines)
            self.shown, self.root = around, None
            return
        root = next((id(e["list"]) for e in around if not e["quote"]), None)
        fresh = any(not e["quote"] and not e["used"] for e in around)
        first = "".join(e["blank"] if e["used"] else e["mark"] for e in around)
        rest = "".join(e["blank"] for e in around)
        if out and not (fresh and root is not None and root == self.root):
            common = []
            for a, b in zip(self.shown, around):
                if a is not b:
                    break
                common.append(a["blank"])
            out.append("".join(common).rstrip())
        out.append((first + lines[0]).rstrip())
        out.extend((rest + line).rstrip() for line in lines[1:])
        for entry in around:
            entry["used"] = True
        self.shown, self.root = around, root

    def flush(self):
        """Ends the block of inline text."""
        segments = self.segments
        if len(segments) == 1 and not segments[0]:
            self.marks, self.head = {}, ""
            return
        for name in reversed(list(self.marks)):
            self.mark_ends(name)
        lines = [x for s in segments if (x := squeezed("".join(s)))]
        head, self.segments, self.head = self.head, [[]], ""
        if lines:
            self.block([head + " ".join(lines)] if head else lines)

    # -- text and inline marks

    def text(self, value):
        if "&" in value:
            value = unescape(value)
        if self.pre is not None:
            self.pre.append(value)
        elif self.tables and self.tables[-1].cell is not None:
            self.tables[-1].cell.append(value)
        else:
            self.segments[-1].append(value)

    def mark_starts(self, sign):
        if sign not in self.marks:
            self.marks[sign] = (len(self.segments), len(self.segments[-1]))

    def mark_ends(self, sign):
        line, place = self.marks.pop(sign)
        for number in range(line, len(self.segments) + 1):
            segment = self.segments[number - 1]
            start = place if number == line else 0
            inner = "".join(segment[start:])
            core = inner.strip()
            if core:
                segment[start:] = [" " if inner[0].isspace() else "", sign + core + sign, " " if inner[-1].isspace() else ""]

    def inline(self, kind, name):
        if self.pre is not None or (self.tables and self.tables[-1].cell is not None):
            if name == "br":
                self.text("\n")
        elif name == "br":
            if kind == "start":
                self.segments.append([])
        elif kind == "start":
            self.mark_starts(MARKS[name])
        elif MARKS[name] in self.marks:
            for sign in reversed(list(self.marks)):  # what began inside it ends with it
                self.mark_ends(sign)
                if sign == MARKS[name]:
                    break

    # -- elements

    def push(self, name, **more):
        more["name"] = name
        self.stack.append(more)
        counts = self.counts[-1]
        counts[name] = counts.get(name, 0) + 1

    def pop(self):
        top = self.stack.pop()
        name = top["name"]
        if name in ("td", "th"):
            self.counts.pop()
        self.counts[-1][name] -= 1
        if name in SILENT:
            self.silent -= 1
        if name in SILENT or top.get("quiet"):
            return
        if name == "pre":
            self.end_pre()
        elif name == "table":
            self.end_table()
        elif name in ("td", "th"):
            self.end_cell()
        else:
            self.break_block()
        if name in ("ul", "ol") and self.lists:
            self.lists.pop()
        if name == "li":
            top["owner"]["open"] = None
        if name in ("li", "blockquote") and self.around and self.around[-1] is top:
            self.around.pop()

    def pop_to(self, name):
        while self.stack and self.stack[-1]["name"] != name:
            self.pop()
        if self.stack:
            self.pop()

    def break_block(self):
        if self.tables and self.tables[-1].cell is not None:
            self.tables[-1].cell.append(" ")
        else:
            self.flush()

    def end_pre(self):
        text, self.pre = "".join(self.pre), None
        lines = text.strip("\n").replace("\r\n", "\n").split("\n")
        if not text.strip():
            return
        if self.tables and self.tables[-1].cell is not None:
            self.tables[-1].cell.append(" " + text)
            return
        fence = "```" + "`" * max((len(m) - 2 for m in re.findall("`{3,}", text)), default=0)
        self.block([fence, *(x.rstrip() for x in lines), fence])

    def end_cell(self):
        table = self.tables[-1] if self.tables else None
        if table and table.cell is not None:
            table.end_cell()
        else:
            self.flush()

    def end_table(self):
        table = self.tables.pop()
        table.end_cell()
        self.flush()
        if self.tables and self.tables[-1].cell is not None:
            self.tables[-1].cell.append(" ")
        self.block(table.lines())

    def in_scope(self, name):
        return self.counts[-1].get(name, 0) > 0

    def start(self, name):
        if name in INLINE:
            if not self.silent:
                self.inline("start", name)
            return
        if name == "body":
            while self.stack:
                self.pop()
            self.counts, self.silent = [{}], 0
            self.begin()
            return
        if self.silent and self.stack[-1]["name"] == "head" and (name in BLOCKS or name in HEADINGS or name in ("ul", "ol", "table", "blockquote", "pre")):
            self.pop()
        if name in SILENT:
            if not self.silent:
                if name not in RAW and self.in_scope("p"):
                    self.pop_to("p")
                self.break_block()
            self.push(name)
            self.silent += 1
            return
        if self.silent:
            if name in BLOCKS or name in ("ul", "ol", "li", "blockquote", "table"):
                self.push(name, quiet=True)
            return
        if self.pre is not None:
            return
        if name in TABLE_PARTS:
            self.table_start(name)
            return
        if self.in_scope("p"):
            self.pop_to("p")
        self.break_block()
        inside = self.tables and self.tables[-1].cell is not None
        if name in HEADINGS:
            self.head = "" if inside else HEADINGS[name]
            self.push(name)
        elif name == "hr":
            if not inside:
                self.block(["---"])
        elif name == "pre":
            self.pre = []
            self.push(name)
        elif name in ("ul", "ol"):
            entry = {"name": name, "item": 0}
            self.lists.append(entry)
            self.push(name)
        elif name == "li":
            self.item_start(inside)
        elif name == "blockquote":
            self.push(name, quote=True, used=False, mark="> ", blank="> ")
            if not inside:
                self.around.append(self.stack[-1])
        elif name in BLOCKS:
            self.push(name)

    def item_start(self, inside):
        owner = self.lists[-1] if self.lists else self.loose
        if owner.get("open"):
            entry = owner["open"]
            while self.stack and self.stack[-1] is not entry:
                self.pop()
            if self.stack:
                self.pop()
        mark = "- "
        if owner["name"] == "ol":
            owner["item"] += 1
            mark = f"{owner['item']}. "
        self.push("li", quote=False, used=False, mark=mark, blank=" " * len(mark), owner=owner, list=self.lists[0] if self.lists else self.loose)
        owner["open"] = self.stack[-1]
        if not inside:
            self.around.append(self.stack[-1])

    def table_start(self, name):
        if name == "table":
            if self.in_scope("p"):
                self.pop_to("p")
            if self.tables and not self.tables[-1].flow:
                outer = self.tables[-1]
                outer.end_cell()
                self.block([c for r in outer.rows for c in r if c])
                outer.rows, outer.flow = [], True
            self.flush()
            self.push("table")
            self.tables.append(Table(len(self.stack)))
        elif self.tables and name in ("tr", "td", "th"):
            table = self.tables[-1]
            while len(self.stack) > table.height:
                self.pop()
            if name == "tr":
                if not table.flow:
                    table.rows.append([])
                return
            table.headed = table.headed or name == "th"
            self.push(name)
            self.counts.append({})
            if not table.flow:
                self.flush()
                table.cell = []
            else:
                self.flush()

    def end(self, name):
        if name in MARKS:
            if not self.silent:
                self.inline("end", name)
            return
        if name == "tr" or name in ("thead", "tbody", "tfoot"):
            name = None
            if self.tables and not self.silent:
                while len(self.stack) > self.tables[-1].height:
                    self.pop()
            return
        if name in ("td", "th"):
            if self.tables and len(self.stack) > self.tables[-1].height and not self.silent:
                while len(self.stack) > self.tables[-1].height:
                    self.pop()
            return
        if name == "table":
            if self.tables and not self.silent:
                inner = self.tables[-1]
                while self.tables and self.tables[-1] is inner:
                    self.pop()
                return
        if self.pre is not None and name != "pre":
            return
        if name in FLOW:
            if not self.silent:
                self.break_block()
        elif self.in_scope(name):
            self.pop_to(name)


def markdown(page):
    """The Markdown of a page's body."""
    state = Page()
    for text, slash, name in pieces(page):
        if text and not state.silent:
            state.text(text)
        if name is not None:
            if slash:
                state.end(name)
            else:
                state.start(name)
    while state.stack:
        state.pop()
    if not state.silent:
        state.flush()
    return "\n".join(state.out)
