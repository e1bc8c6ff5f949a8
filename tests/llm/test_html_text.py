"""Page texts: parsing, held-out layouts, whole pages."""

import html
import random
import re
import time

import numpy as np
import pytest

from tarnwork.llm import html_text as h

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()


def sentences(seed, n=300):
    r = random.Random(seed)
    return [" ".join(r.choices(WORDS, k=r.randrange(3, 20))).capitalize() + "." for _ in range(n)]


@pytest.fixture(scope="module")
def labeller():
    return h.train_labeller(sentences(1))


def test_blocks():
    page = "<p>a &amp; b<br>c<script>if(1<2)x='</p>'</script><p>d <b>e</b>f<!-- <p>no</p> --><ul><li>g<li>h</ul>t 1 < 2<td>"
    assert [b[0] for b in h.blocks_of(page)] == ["a & b c", "d ef", "g", "h", "t 1 < 2"]
    assert h.blocks_of(None) == h.blocks_of("") == h.blocks_of("<div><br></div>") == []
    path = h.blocks_of("<main><div class='Ad-Box top' id=x1 role=banner>q")[0][1]
    assert path.tokens == ("div", "c:ad", "c:box", "c:top", "c:x", "c:1", "r:banner") and path.parent.tokens == ("main",) and path.parent.parent is None


def test_held_out_layouts(labeller):
    r, f, right, total = random.Random(77), h.Features(), 0, 0
    for _ in range(120):
        blocks, y = h.layout(r, sentences(2))
        s = labeller.scores(labeller.project(f(blocks))[None], np.array([len(y)]))[0]
        right += int(((s > 0) == np.array(y)).sum())
        total += len(y)
    assert right / total > 0.97


def test_gradients():
    r = np.random.default_rng(0)
    p, u = r.standard_normal((2, 4, 4 * h.HIDDEN)), r.standard_normal((h.HIDDEN, 4 * h.HIDDEN)) * 0.3
    d = r.standard_normal((2, 4, h.HIDDEN))
    dp, du = h._back(d, h._run(p, u)[1], u)
    for x, g, at in ((p, dp, (1, 2, 5)), (u, du, (3, 20))):
        old, e = x[at], 1e-5
        x[at] = old + e
        up = (h._run(p, u)[0] * d).sum()
        x[at] = old - e
        assert abs((up - (h._run(p, u)[0] * d).sum()) / (2 * e) - g[at]) < 1e-4
        x[at] = old


def page(r, i):
    said = sentences(i, 8)
    body = [html.escape(x) for x in said]
    return said, (
        f"<html><head><title>{said[0]}</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>home</a></li><li><a href=/b>news</a></li></ul></nav>"
        f"<div class='ad'>{said[2]}</div><article><h1>{body[0]}</h1>" + "".join(f"<p>{x}</p>" for x in body[1:]) + f"</article><div class=comments><p>{said[3]}</p></div><footer>&copy; x</footer></body></html>"
    )


def test_extract_text(spark):
    r = random.Random(0)
    made = [page(r, i) for i in range(40)]
    rows = [(i, "u", p, "clash") for i, (_, p) in enumerate(made)] + [(100, None, None, "x"), (None, "u", "", "x"), (5, "u", made[5][1], "x"), (101, "u", "<article><p>" + "word " * 40_000 + "</p></article>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string").repartition(2)
    got = h.extract_text(pages, layouts=500).collect()
    assert len(got) == len(rows)
    same = 0
    for g in got:
        assert g["n_chars"] == len(g["text"])
        if g["page_id"] is not None and g["page_id"] < 40:
            same += g["text"] == "\n\n".join(made[g["page_id"]][0])
        elif g["page_id"] != 101:
            assert g["text"] == ""
        else:
            assert g["n_chars"] == 5 * 40_000 - 1
    assert same >= 40
    assert h.extract_text(pages.limit(0), layouts=20).count() == 0


def test_driver_style_page(labeller):
    text = '<body><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad --><div class="ad">Alpha beta.</div><article><h1>Beta gamma.</h1><p><b>Gamma.<br><p>Delta &amp; mu.</p></article><footer>&copy; a.b &middot; Nu.</footer>'
    assert h.label_pages(labeller, h.Features(), [text, None, text]) == [["Beta gamma.", "Gamma.", "Delta & mu."], [], ["Beta gamma.", "Gamma.", "Delta & mu."]]
    assert re.search("Nu", text)


@pytest.mark.parametrize(
    "before",
    [
        "<script>for(i=0;i<n;i++){f(i)}</script>",
        "<script>s = '<!--';</script>",
        "<style>a:before{content:'<b \"'}</style >",
        "<SCRIPT>if(a<b&&'\"'){}</Script\n>",
        "<textarea><!-- <p x='></textarea>",
        "<script>s = '<script '</script>",
        "<div><button>Menu</div>",
        "<button>Menu",
        "<select><option>x<option>y",
        "<div><svg><g></div>",
        "<object data=x>",
        "<iframe src=x>",
        "<button>a<div>b</div></button>",
        "<svg><svg></svg>no</svg>",
        "<template><p>no</p></template>",
        "<svg><style>a{content:'<b \"</body>'}</style></svg>",
        "<object><!-- </object>",
    ],
)
@pytest.mark.parametrize("after", ["", "<button>z</button><svg></svg>"])
def test_silent_elements_leave_the_article(before, after):
    page = f"<body>{before}<article><p>kept <math><mi>x</mi></math> too</p></article>{after}</body>"
    assert [b[0] for b in h.blocks_of(page)] == ["kept x too"]


def test_title_holds_no_markup():
    assert [b[0] for b in h.blocks_of("<title>a <!-- b <p></title><p>c</p>")] == ["a <!-- b <p>", "c"]


@pytest.mark.parametrize(
    "part",
    ["<a ", '<a href="x> y ', "<div>", "<div>x", "<select ", "</x>", "<", "<!--", "<![CDATA[", "<iframe>", "<title>", "<button>x", "<svg><p>", "<script", "<p><span>", "<object><b '"],
)
def test_malformed_pages_take_linear_time(part):
    """A megabyte of each kind; the parts before and after a table of features."""
    long = "<p>first</p>" + part * (1_000_000 // len(part))
    begin = time.process_time()
    blocks = h.blocks_of(long)
    h.Features()(blocks)
    assert blocks[0][0] == "first" and time.process_time() - begin < 15


def test_path_vectors_do_not_depend_on_what_is_remembered():
    page = "<div class=a>" * 300 + "<p>x</p><ul><li>y</ul>"
    blocks = h.blocks_of(page)
    one, two = h.Features(), h.Features()
    together = one(blocks)
    assert (together[1, : h.PATH_DIM] == two.path(blocks[1][1])).all()
    assert together[1, : h.PATH_DIM].max() == 3


# Pages of other makes than the training layouts: their markup is written by hand.
BLOG = """<!doctype html><html lang=en><head><meta charset=utf-8><title>{t}</title><link rel=stylesheet href=x.css></head><body class="single post-7">
<a class="skip-link" href="#c">Skip to content</a><header id="masthead" role="banner"><div class="site-branding"><a href="/">My site</a></div><nav aria-label="Primary"><a href=/1>Home</a> <a href=/2>About</a></nav></header>
<div id="page"><main id="c"><article class="post hentry"><header class="entry-header"><h1 class="entry-title">{t}</h1></header><div class="entry-content"><p>{a}</p><p>{b}</p><h2>{c}</h2><p>{d}</p></div></article>
<section class="comments-area" id="comments"><h2>2 comments</h2><ol class="comment-list"><li class="comment"><p>{e}</p></li><li class="comment"><p>{f}</p></li></ol></section></main>
<aside class="widget-area" role="complementary"><h3>Recent posts</h3><ul><li><a href=/3>{g}</a></li></ul></aside></div><footer class="site-footer"><p>Powered by a program. &copy; 2023</p></footer></body></html>"""
PAPER = """<html><head><title>{t} - The Paper</title></head><body><div id=top><ul class=menu><li><a href=/w>World</a><li><a href=/s>Sport</a></ul></div>
<div class="cookie-banner"><p>We use cookies.</p><button>OK</button></div><div class="story-body"><h1>{t}</h1><p>{a}<p>{b}<div class="advert"><span>Advertisement</span></div><p>{c}<p>{d}</div>
<div class="related-links"><h4>More</h4><a href=/x>{e}</a></div><div id="footer"><a href=/t>Terms</a> | <a href=/p>Privacy</a></div></body></html>"""


def test_layouts_of_another_kind(labeller):
    """Recall and precision over blocks of two hand-made layouts."""
    right = wrong = lost = 0
    for i in range(30):
        said = dict(zip("tabcdefg", sentences(100 + i, 8)))
        for page, wanted in ((BLOG, "tabcd"), (PAPER, "tabcd")):
            got = h.label_pages(labeller, h.Features(), [page.format(**said)])[0]
            want = [said[k] for k in wanted]
            right += sum(x in got for x in want)
            lost += sum(x not in got for x in want)
            wrong += sum(x not in want for x in got)
    print("recall", right / (right + lost), "precision", right / (right + wrong))
    assert right / (right + lost) > 0.9 and right / (right + wrong) > 0.8
