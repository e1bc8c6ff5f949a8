"""All metadata fields of a text in one pass, with one automaton for every name and keyword.

The automaton (Aho-Corasick) holds the authorities, the categories' keywords and the words for
the whole country; it reads the head of a text once, whatever their number.  Patterns run only
where a word that they need occurs."""

import re

from .defaults import AUTHORITIES, CATEGORIES, TITLE_WORDS

# Patterns of the document formats.
DATE = r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
NUMBER = r"[^\s,，。；\n〔\[]{2,20}[〔\[]\d{4}[〕\]]\d+号"
REGION = r"(?:^|\s)([一-鿿]{2,6}(?:省|自治区|直辖市))"
EVERYWHERE, COUNTRY = ("各省、自治区", "全国", "各地区"), "全国"
VERBS = ("施行", "执行", "实施")
SOURCE = r"发布来源[:：][ \t]*(.+)"

FIELDS = ("title", "policy_number", "issuing_authority", "publish_date", "effective_date", "expiry_date", "applicable_region", "category")
HEAD, TAIL, WIDE, SAID = 500, 500, 1000, 300


def iso(match, first=1):
    year, month, day = match.group(first), match.group(first + 1), match.group(first + 2)
    return f"{year}-{month.zfill(2)}-{day.zfill(2)}"


class Scanner:
    """``fields(text)``: the values of FIELDS, None where there is none."""

    def __init__(self, names=AUTHORITIES, categories=CATEGORIES, title_words=TITLE_WORDS, other="其他"):
        import ahocorasick

        self.names, self.categories, self.other = tuple(names), tuple(categories), other
        uses = {}
        for n, name in enumerate(self.names):
            uses.setdefault(name, []).append(("name", n))
        for n, words in enumerate(categories.values()):
            for word in set(words):
                uses.setdefault(word, []).append(("category", n))
        for word in EVERYWHERE:
            uses.setdefault(word, []).append(("country", 0))
        self.automaton = ahocorasick.Automaton()
        for word, found in uses.items():
            self.automaton.add_word(word, (word, tuple(found)))
        self.automaton.make_automaton()
        self.date, self.number, self.region, self.said = (re.compile(p) for p in (DATE, NUMBER, REGION, SOURCE))
        self.effective = re.compile(f"自{DATE}起({'|'.join(VERBS)})")
        self.until = [re.compile(mark + DATE) for mark in ("有效期至", "执行至")]
        self.ended = re.compile(DATE + "止")
        self.title_word = re.compile("|".join(map(re.escape, title_words)) or r"(?!)").search
        self.dated_line = re.compile(r"\d{4}年").match

    def fields(self, text):
        if text is None:
            return (None,) * len(FIELDS)
        head, wide = text[:HEAD], text[:WIDE]
        number = self.number.search(head)
        bracket = re.search(r"[〔\[]", number.group()).start() + number.start() if number else 0
        in_prefix = in_head = len(self.names)
        everywhere, counts = False, {}
        for end, (word, uses) in self.automaton.iter(wide):
            for kind, n in uses:
                if kind == "category":
                    counts.setdefault(n, set()).add(word)
                elif end < HEAD:
                    if kind == "country":
                        everywhere = True
                    else:
                        in_head = min(in_head, n)
                        if number and end - len(word) + 1 >= number.start() and end < bracket:
                            in_prefix = min(in_prefix, n)
        named = in_prefix if in_prefix < len(self.names) else in_head
        authority = self.names[named] if named < len(self.names) else self.source(head[:SAID])
        region = None if everywhere else self.region.search(head)
        most = max(map(len, counts.values()), default=0)
        category = self.categories[min(n for n, found in counts.items() if len(found) == most)] if most else self.other
        return (
            self.title(text), number and number.group(), authority, self.published(text, head), self.effect(text), self.expiry(text),
            COUNTRY if everywhere else region and region.group(1), category,
        )

    def source(self, head):
        said = self.said.search(head)
        return (said.group(1).strip() or None) if said else None

    def title(self, text, least=5, long=10):
        for line in _lines(text):
            line = line.strip()
            if len(line) >= least and not self.dated_line(line) and (len(line) >= long or self.title_word(line)):
                return line
        return None

    def published(self, text, head):
        last = None
        for last in self.date.finditer(text[-TAIL:]):
            pass
        found = last or self.date.search(head)
        return iso(found) if found else None

    def effect(self, text):
        if "起" not in text or "自" not in text:
            return None
        first = {}
        for m in self.effective.finditer(text):
            first.setdefault(m.group(4), m)
        return next((iso(first[v]) for v in VERBS if v in first), None)

    def expiry(self, text):
        for mark, pattern in zip(("有效期至", "执行至"), self.until):
            if mark in text and (m := pattern.search(text)):
                return iso(m)
        at = text.find("有效期")
        while at >= 0:  # of a line only the first mark matters: what follows a later one follows it too
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            if m := self.ended.search(text, at + len("有效期"), end):
                return iso(m)
            at = text.find("有效期", end)
        return None


def _lines(text):
    """The lines of a text one by one; a carriage return ends a line too."""
    at = 0
    for m in re.finditer(r"\r\n?|\n", text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]
