"""Main text of web pages, by a recurrent labeller of blocks.

A page becomes a sequence of leaf blocks (text between block-level tags), each with
hashed vectors of its tag path (names, classes, ids, roles) and of its words, and a
few numbers.  A bidirectional LSTM in numpy reads the whole sequence and labels each
block as content or not; content blocks are joined in page order by two line feeds.

There are no labelled pages, so the labeller is trained on layouts drawn from the lists
below (menus, banners, notices, adverts, forms, sidebars, footers, comments around an
article), filled with at most ``SENTENCES`` sentences each of a sample of ``TRAINING_PAGES`` pages.
All pages are extracted whole; scripts, styles and form controls are never text.

A null or empty page gives an empty text.  Repeated ids are pages of their own; a null
id or url is passed on.  An empty table gives an empty result; other columns are ignored.
"""

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import WordCodes

TRAINING_PAGES = 60
SENTENCES = 40
TRAINING_LAYOUTS = 700
PATH_DIM, WORD_DIM, NUMBERS = 128, 32, 8
DIM = PATH_DIM + WORD_DIM + NUMBERS
HIDDEN = 16
DIGITS = "0123456789"

# Fixed sets of HTML: elements that break blocks, have no end tag, or hold no text.
BREAKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template iframe svg textarea select button object canvas audio video".split())
# Silent elements whose contents are no markup, and those that cannot hold their like.
RAW = set("script style noscript iframe textarea".split())
ALONE = {"select", "button"}
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = set("ul ol dl table nav article section div body main aside footer header form td th".split())

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
PLAIN = re.compile("[^>\"']*+")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
TAGS = {name: re.compile(rf"<(/?){name}(?=[\s/>])[^<>]*+>?", re.I) for name in SILENT - RAW}
ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^<>]*+>?", re.I) for name in RAW | {"title"}}


def ends_of(page, name):
    """Offset of each start tag of ``name`` -> that of its end tag; unclosed ones are absent."""
    out, opened = {}, []
    for m in TAGS[name].finditer(page):
        if m[1]:
            if opened:
                out[opened.pop()] = m.start()
        elif not m[0].endswith("/>"):
            if name in ALONE:
                opened.clear()
            opened.append(m.start())
    return out


class Path:
    """The open elements of a place in the page: the tokens of the last, and the path to it."""

    __slots__ = ("parent", "tokens", "key")

    def __init__(self, parent, tokens):
        self.parent, self.tokens = parent, tokens
        self.key = hash((parent.key if parent else 0, tokens))


class OpenElements:
    """Stack of open elements that finds names and barriers without walking it."""

    def __init__(self):
        self.names, self.paths, self.places, self.barriers = [], [], {}, [-1]

    def push(self, name, tokens):
        self.places.setdefault(name, []).append(len(self.names))
        if name in HOLDS:
            self.barriers.append(len(self.names))
        self.names.append(name)
        self.paths.append(Path(self.paths[-1] if self.paths else None, tokens))

    def cut(self, size):
        while len(self.names) > size:
            self.places[self.names.pop()].pop()
            self.paths.pop()
        while self.barriers[-1] >= size:
            self.barriers.pop()

    def last(self, name):
        places = self.places.get(name)
        return places[-1] if places else -1

    def end(self, name):
        if (at := self.last(name)) >= 0:
            self.cut(at)

    def start_block(self, name):
        """Closes what a new block of this name ends, up to the nearest element that holds blocks."""
        at = max(map(self.last, CLOSES.get(name, ()) or ("p",)))
        at = max(at, self.last("p"))
        if at >= 0 and at >= self.barriers[-1]:
            self.cut(at)


class Markup:
    """Finds the ends of tags, comments and declarations of one page in linear time."""

    def __init__(self, page):
        self.page, self.missing = page, set()

    def find(self, what, at, limit):
        """As ``str.find``; what is missing once up to the page's end is not sought again."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at, limit)
        if found < 0 and limit >= len(self.page):
            self.missing.add(what)
        return found

    def tag_end(self, at, limit):
        """Offset behind the ``>`` of the tag, -1 without one.  A quote without its like is
        an ordinary character."""
        while True:
            at = PLAIN.match(self.page, at, limit).end()
            if at >= limit:
                return -1
            mark = self.page[at]
            if mark == ">":
                return at + 1
            at = max(at, self.find(mark, at + 1, limit)) + 1

    def declaration_end(self, at, limit):
        for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if self.page.startswith(opening, at):
                end = self.find(closing, at + len(opening), limit)
                if end >= 0:
                    return end + len(closing)
                if opening == "<!--":
                    return limit
        return (self.find(">", at, limit) + 1) or limit


def blocks_of(page):
    """[(text, path, characters in links, depth)] of a page, in order, in linear time.

    The contents of script, style and other raw-text elements end at the next end tag of
    their name, whatever stands before it; without one, script and style reach to the end
    of the page, as in browsers, and so does a tag without its end.  Other silent elements
    end at their end tag or where a block around them closes; without an end tag, at the
    next tag of a block."""
    page = page or ""
    size, markup, opened = len(page), Markup(page), OpenElements()
    out, parts, linked, at = [], [], 0, 0
    skip, until, inner, ends, unclosed = None, None, {}, {}, set()

    def close():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, opened.paths[-1] if opened.paths else None, linked, len(opened.names)))
            parts.clear()
            linked = 0

    def say(text):
        nonlocal linked
        if skip is None and text:
            parts.append(text)
            if opened.last("a") >= 0:
                linked += len(text)

    while at < size:
        here = page.find("<", at)
        if here < 0:
            here = size
        if skip is not None and until is not None and here >= until:
            skip, here = None, until
            at = until
            tag = TAG.match(page, at)
            at = markup.tag_end(tag.end(), size)
            if at < 0:
                break
            continue
        say(page[at:here])
        at = here
        if at >= size:
            break
        # A stray quote or comment inside a silent element must not swallow its end tag.
        limit = size if skip is None or until is None else until
        tag = TAG.match(page, at)
        if not tag:
            if page.startswith(("<!", "<?"), at):
                at = markup.declaration_end(at, limit)
            else:
                say("<")
                at += 1
            continue
        start, closing, name = at, tag[1], tag[2].lower()
        at = markup.tag_end(tag.end(), limit)
        if at < 0:
            at = limit
            continue
        attributes = page[tag.end() : at - 1]
        if skip is not None:
            if name in RAW and not closing and name not in unclosed:
                if end := ENDS[name].search(page, at, limit):
                    at = end.end()
                elif limit == size:
                    unclosed.add(name)
            if name not in BREAKS:
                continue
            if until is not None:
                if not closing:
                    inner[name] = inner.get(name, 0) + 1
                    continue
                if inner.get(name):
                    inner[name] -= 1
                    continue
                if opened.last(name) < 0:
                    continue
            skip = None
        if closing:
            if name in BREAKS:
                close()
            opened.end(name)
            continue
        if name in SILENT:
            if attributes.endswith("/"):
                continue
            if name in RAW and name not in unclosed:
                end = ENDS[name].search(page, at)
                if end:
                    at = end.end()
                    continue
                if name in ("script", "style"):
                    break
                unclosed.add(name)
            if name not in RAW and name not in ends:
                ends[name] = ends_of(page, name)
            skip, until, inner = name, ends.get(name, {}).get(start), {}
            continue
        if name == "br":
            parts.append(" ")
        if name in BREAKS:
            close()
            opened.start_block(name)
        if name not in VOID and not attributes.endswith("/"):
            tokens = [name]
            for kind, *values in ATTRIBUTE.findall(attributes):
                tokens += [f"{'r' if kind.lower() == 'role' else 'c'}:{w.lower()}" for w in NAME.findall("".join(values))]
            opened.push(name, tuple(tokens))
            if name == "title" and "title" not in unclosed:
                end = ENDS[name].search(page, at)
                if end:
                    parts.append(page[at : end.start()])
                    at = end.start()
                else:
                    unclosed.add(name)
    close()
    return out


class Features:
    """Vectors of blocks: hashed tag path, hashed words, numbers."""

    def __init__(self):
        self.codes, self.paths = WordCodes(), {}

    def path(self, path):
        """How often the path's tokens fall into each place, kept for the path and for some above it."""
        below, node = [], path
        while node is not None and node.key not in self.paths:
            below.append(node)
            node = node.parent
        counts = self.paths[node.key] if node is not None else np.zeros(PATH_DIM, np.int32)
        if len(self.paths) >= 20_000:
            self.paths.clear()
        for i, node in enumerate(reversed(below), 1):
            counts = counts + np.bincount([self.codes[p.encode()] % PATH_DIM for p in node.tokens], minlength=PATH_DIM).astype(np.int32)
            if i == len(below) or i % 64 == 0:
                self.paths[node.key] = counts
        return np.minimum(counts, 3)

    def __call__(self, blocks):
        out = np.zeros((len(blocks), DIM), np.float32)
        for row, (i, (text, path, linked, depth)) in zip(out, enumerate(blocks)):
            row[:PATH_DIM] = self.path(path)
            words = text.lower().encode().split()
            row[PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount((self.codes.of(words) & np.uint64(WORD_DIM - 1)).view(np.int64), minlength=WORD_DIM) / len(words)
            n = len(text)
            row[-NUMBERS:] = (np.log1p(len(words)) / 3, min(1.0, linked / n), text[-1] in ".!?", i / len(blocks), depth / 10, sum(map(text.count, DIGITS)) / n, text[0].isupper(), 1)
        return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(p, u):
    """Hidden states of one direction; p: inputs times weights, (batch, time, 4 * HIDDEN)."""
    size, steps = p.shape[:2]
    h = c = np.zeros((size, HIDDEN), p.dtype)
    hs, saved = np.zeros((size, steps, HIDDEN), p.dtype), []
    for t in range(steps):
        z = p[:, t] + h @ u
        gate, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
        last, before = c, h
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[:, t] = h
        saved.append((i, f, o, g, last, tc, before))
    return hs, saved


def _back(dhs, saved, u):
    """Gradients of p and u, given those of the hidden states."""
    dp, du = np.zeros((*dhs.shape[:2], 4 * HIDDEN), dhs.dtype), np.zeros_like(u)
    dh = dc = np.zeros_like(dhs[:, 0])
    for t in range(dhs.shape[1] - 1, -1, -1):
        i, f, o, g, last, tc, before = saved[t]
        dh = dh + dhs[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * last * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
        dp[:, t] = dz
        du += before.T @ dz
        dh, dc = dz @ u.T, dc * f
    return dp, du


def _reversed(x, lengths):
    """Each sequence turned around in place; padding stays at the end."""
    at = np.arange(x.shape[1])[None, :]
    at = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, at[:, :, None], 1)


class BlockLabeller:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, weights=None, seed=0):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = weights or {"wf": draw(DIM, 4 * HIDDEN), "wb": draw(DIM, 4 * HIDDEN), "uf": draw(HIDDEN, 4 * HIDDEN), "ub": draw(HIDDEN, 4 * HIDDEN), "v": draw(2 * HIDDEN, 1), "b": np.zeros(1, np.float32)}

    def project(self, x):
        return np.concatenate([x @ self.w["wf"], x @ self.w["wb"]], 1)

    def scores(self, projected, lengths):
        """projected: (batch, time, 8 * HIDDEN), padded; returns logits (batch, time)."""
        f, _ = _run(projected[:, :, : 4 * HIDDEN], self.w["uf"])
        b, _ = _run(_reversed(projected[:, :, 4 * HIDDEN :], lengths), self.w["ub"])
        return (np.concatenate([f, _reversed(b, lengths)], 2) @ self.w["v"])[:, :, 0] + self.w["b"]

    def train(self, pages, epochs=8, batch=24, rate=0.01, seed=0):
        """pages: [(features, labels)]."""
        r, w = np.random.default_rng(seed), self.w
        m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        groups = [order[a : a + batch] for a in range(0, len(order), batch)]
        for _ in range(epochs):
            for g in r.permutation(len(groups)):
                chosen = [pages[i] for i in groups[g]]
                lengths = np.array([len(y) for _, y in chosen])
                x, y = np.zeros((len(chosen), lengths.max(), DIM), np.float32), np.zeros((len(chosen), lengths.max()), np.float32)
                for k, (a, b) in enumerate(chosen):
                    x[k, : len(b)], y[k, : len(b)] = a, b
                x *= r.random((1, 1, DIM)) > 0.05
                mask = np.arange(lengths.max())[None, :] < lengths[:, None]
                back = _reversed(x, lengths)
                hf, sf = _run(x @ w["wf"], w["uf"])
                hb, sb = _run(back @ w["wb"], w["ub"])
                both = np.concatenate([hf, _reversed(hb, lengths)], 2)
                d = (_sigmoid((both @ w["v"])[:, :, 0] + w["b"]) - y) * mask / mask.sum()
                dh = d[:, :, None] * w["v"][:, 0]
                dpf, duf = _back(dh[:, :, :HIDDEN], sf, w["uf"])
                dpb, dub = _back(_reversed(dh[:, :, HIDDEN:], lengths), sb, w["ub"])
                grads = {"wf": np.einsum("bti,btj->ij", x, dpf, optimize=True), "wb": np.einsum("bti,btj->ij", back, dpb, optimize=True), "uf": duf, "ub": dub, "v": np.einsum("bti,bt->i", both, d)[:, None], "b": np.array([d.sum()])}
                step += 1
                for k, grad in grads.items():
                    grad = np.clip(grad, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.99 * v[k] + 0.01 * grad * grad
                    w[k] = (w[k] - rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


# Layouts for training: names that pages give to their parts.
CONTENT = ["article", "main", "div.content", "div.post", "div.entry-content", "div#main-content", "section.story", "div.article-body", "div.text", "div"]
MENU = ["nav", "div.menu", "ul.navigation", "div#navbar", "header", "div.header", "div.breadcrumbs", "div.topbar", "div.masthead", "div#nav"]
NOTICE = ["div.cookie-notice", "div.banner", "div#consent", "div.notice", "div.alert", "aside.gdpr", "div.newsletter", "div.popup", "dialog.modal"]
ADVERT = ["div.ad", "div.ads", "div.advert", "aside.sponsored", "div.promo", "div#ad-top", "section.advertisement", "ins.adsbygoogle"]
SIDE = ["aside", "div.sidebar", "div#sidebar", "section.related", "div.widget", "div.tags", "div.share", "div.social", "ul.links", "div.recommended"]
FORM = ["form", "form.search", "form#login", "div.subscribe form", "fieldset"]
FOOT = ["footer", "div.footer", "div#footer", "div.copyright", "div.legal", "section.footer-links"]
REMARKS = ["div.comments", "section#comments", "ol.comment-list", "div.responses", "div.disqus", "div.reviews", "ul.replies"]
STOCK = {
    "notice": ["We use cookies to improve this site.", "Accept all cookies", "Subscribe to our newsletter", "Sign up now", "This site uses cookies. Learn more", "You have 3 free articles left."],
    "advert": ["Advertisement", "Sponsored", "Buy now and save 20%", "Limited offer", "Promoted"],
    "foot": ["© 2024 All rights reserved.", "Privacy policy", "Terms of use", "Contact", "About us", "Imprint"],
    "form": ["Search", "Your name", "E-mail", "Password", "Leave a reply", "Log in"],
    "remark": ["Reply", "Posted by anonymous", "3 comments", "Great post, thanks!", "Report", "2 days ago"],
}


def layout(r, sentences):
    """One random page: [(text, path tokens, linked, depth)] with labels."""
    short = lambda: " ".join(r.choice(sentences).split()[: r.randrange(1, 4)]) or "x"
    several = lambda a, b: " ".join(r.choice(sentences) for _ in range(r.randrange(a, b)))

    def tag(spec, inner, extra=""):
        for s in reversed(spec.split()):
            name, kind, label = (*re.split(r"([.#])", s, maxsplit=1), "", "")[:3]
            attr = f' {"class" if kind == "." else "id"}="{label}{extra}"' if label else ""
            inner = f"<{name}{attr}>{inner}</{name}>"
        return inner

    def links(n):
        items = [f'<a href="/x">{short()}</a>' for _ in range(n)]
        return r.choice([lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<div>{i}</div>" for i in items)])()

    def part(kind):
        own = r.random() < 0.5
        if kind == "menu":
            return tag(r.choice(MENU), links(r.randrange(2, 9)))
        if kind == "side":
            return tag(r.choice(SIDE), (f"<h3>{short()}</h3>" if own else "") + r.choice([lambda: links(r.randrange(2, 7)), lambda: f"<p>{several(1, 3)}</p>"])())
        if kind == "form":
            return tag(r.choice(FORM), f"<label>{r.choice(STOCK['form'])}</label><input><p>{short() if own else r.choice(STOCK['form'])}</p>")
        if kind == "remark":
            one = lambda: f"<{'div class=comment' if own else 'li'}><p>{r.choice(STOCK['remark']) if r.random() < 0.3 else several(1, 4)}</p></{'div' if own else 'li'}>"
            return tag(r.choice(REMARKS), (f"<h3>{r.choice(STOCK['remark'])}</h3>" if own else "") + "".join(one() for _ in range(r.randrange(1, 6))))
        names = {"notice": NOTICE, "advert": ADVERT, "foot": FOOT}[kind]
        said = r.choice(STOCK[kind]) if own else several(1, 3)
        if kind == "foot" and r.random() < 0.5:
            said = f"&copy; www.{short().lower().replace(' ', '')}.example.com &middot; {several(1, 3)}"
        return tag(r.choice(names), r.choice(["<p>%s</p>", "%s", "<span>%s</span>"]) % said + (links(r.randrange(1, 5)) if r.random() < 0.3 else ""))

    def article():
        head = f"<h1>{several(1, 2)[: r.randrange(20, 90)]}</h1>" if r.random() < 0.9 else ""
        if r.random() < 0.3:
            head += f"<p><b>{several(1, 2)}<br>"
        body = []
        for _ in range(r.randrange(0, 14)):
            kind = r.random()
            text = several(1, 5)
            if kind < 0.72:
                body.append(f"<p>{text}" + ("</p>" if r.random() < 0.8 else ""))
            elif kind < 0.8:
                body.append(f"<h2>{short()}</h2>")
            elif kind < 0.86:
                body.append("<ul>" + "".join(f"<li>{several(1, 2)}</li>" for _ in range(r.randrange(2, 5))) + "</ul>")
            elif kind < 0.9:
                body.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.94:
                body.append(f"<p>{text} <a href='/y'>{short()}</a> {text}</p>")
            elif kind < 0.97:
                body.append("<p>" + " | ".join(w for w in text.split()) + "</p>")
            else:
                body.append(f"<table><tr><td>{short()}</td><td>{short()}</td></tr></table>")
        return tag(r.choice(CONTENT) if r.random() < 0.7 else "article", head + ("".join(body) or ("" if head else f"<p>{several(1, 3)}</p>")))

    count = lambda p: sum(r.random() < p for _ in range(2))
    before = ["menu"] * (1 + count(0.2)) + ["notice"] * count(0.25) + ["advert"] * count(0.35) + ["form"] * count(0.15) + ["side"] * count(0.15)
    after = ["side"] * count(0.35) + ["remark"] * count(0.3) + ["form"] * count(0.2) + ["advert"] * count(0.2) + ["notice"] * count(0.1)
    r.shuffle(before), r.shuffle(after)
    page = "<html><head><title>" + several(1, 2)[:60] + "</title></head><body>"
    pieces = [(page, 0), *((part(k), 0) for k in before), (article(), 1), *((part(k), 0) for k in after), (part("foot"), 0)]
    if r.random() < 0.25:
        pieces.insert(2, (f'<div class="{r.choice(["page", "wrapper", "container", "site", "layout"])}">', 0))
    # A mark in front of each piece tells which label its blocks have.
    marked = blocks_of("".join(f"<p>\x01{y}</p>{x}" for x, y in pieces))
    blocks, labels, y = [], [], 0
    for b in marked:
        if b[0][0] == "\x01":
            y = int(b[0][1])
        else:
            blocks.append(b), labels.append(y)
    return blocks, labels


def train_labeller(sentences, layouts=TRAINING_LAYOUTS, seed=7):
    r, features = random.Random(seed), Features()
    pages = [layout(r, sentences) for _ in range(layouts)]
    return BlockLabeller(seed=seed).train([(features(b), np.array(y, np.float32)) for b, y in pages], seed=seed)


def label_pages(labeller, features, pages, cells=40_000):
    """For each page its content blocks' texts; sequences of like length share a batch."""
    parsed = [blocks_of(p) for p in pages]
    out = [[] for _ in pages]
    todo = sorted((len(b), i) for i, b in enumerate(parsed) if b)
    while todo:
        longest = todo[-1][0]
        take = max(1, min(len(todo), cells // longest))
        group, todo = [i for _, i in todo[-take:]], todo[:-take]
        projected = np.zeros((len(group), longest, 8 * HIDDEN), np.float32)
        for k, i in enumerate(group):
            for a in range(0, len(parsed[i]), 4096):
                part = parsed[i][a : a + 4096]
                projected[k, a : a + len(part)] = labeller.project(features(part) if len(parsed[i]) <= 4096 else _placed(features(part), a, len(parsed[i])))
        scores = labeller.scores(projected, np.array([len(parsed[i]) for i in group]))
        for k, i in enumerate(group):
            out[i] = [b[0] for b, s in zip(parsed[i], scores[k]) if s > 0]
    return out


def _placed(x, first, total):
    """Sets the place in the page of blocks that were measured in parts."""
    x[:, DIM - NUMBERS + 3] = (first + np.arange(len(x))) / total
    return x


def sample_sentences(pages, id_col, html_col, most=TRAINING_PAGES, each=SENTENCES):
    """Sentences of the ``most`` pages whose ids have the least hashes; at most ``each`` of a
    page, evenly spread over it."""
    out = []
    for row in pages.filter(F.col(html_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).select(html_col).limit(most).toLocalIterator():
        said = [s for b, *_ in blocks_of(row[0]) for s in re.split(r"(?<=[.!?]) ", b) if len(s.split()) > 1]
        out += said[:: max(1, -(-len(said) // each))]
    return out or ["Some words of a plain text.", "More of the same here."]


def extract_text(pages, id_col="page_id", url_col="url", html_col="html", training_pages=TRAINING_PAGES, layouts=TRAINING_LAYOUTS):
    """One row a page: id, url, ``text`` and ``n_chars``."""
    labeller = train_labeller(sample_sentences(pages, id_col, html_col, training_pages), layouts)
    shared = pages.sparkSession.sparkContext.broadcast(labeller.w)  # a fixed number of weights
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_col, url_col))

    def run(batches):
        own, features = BlockLabeller(shared.value), Features()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                text = ["\n\n".join(x) for x in label_pages(own, features, part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return picked.mapInArrow(run, f"page_id {id_type}, url {url_type}, text string, n_chars bigint").withColumnRenamed("page_id", id_col).withColumnRenamed("url", url_col)
