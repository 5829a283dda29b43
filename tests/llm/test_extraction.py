"""Main texts of pages: the field by finite differences and by enumeration, the parser by hand, whole extraction on unseen layouts."""

from __future__ import annotations

import itertools
import math
import random
import time

import numpy as np
import pytest

from rollumen.llm import crf, layouts
from rollumen.llm.extraction import Extractor, extracted, fit, leaf_blocks

WORDS = "the river ran past old mills where nobody had worked since autumn and small boats were left along its muddy banks".split()


def prose(rng, n):
    return " ".join(" ".join(rng.choices(WORDS, k=rng.randint(5, 18))).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    return ["\n".join(prose(rng, rng.randint(1, 6)) for _ in range(10)) for _ in range(200)]


@pytest.fixture(scope="module")
def chain(texts):
    return fit(layouts.labelled_pages(texts, 1000))


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(1)
    there = np.array([[True] * 4, [True, True, False, False], [True, False, False, False]])
    labels = rng.integers(0, 2, (3, 4)) * there
    scores, steps, first = rng.normal(size=(3, 4)) * there, rng.normal(size=(2, 2)), rng.normal(size=2)

    def value(s, t, f):
        out = 0.0
        for r in range(3):
            n = there[r].sum()

            def weight(y):
                return f[y[0]] + sum(s[r, k] * y[k] for k in range(n)) + sum(t[y[k], y[k + 1]] for k in range(n - 1))

            out += weight(labels[r, :n]) - math.log(sum(math.exp(weight(y)) for y in itertools.product((0, 1), repeat=int(n))))
        return out

    got, p, d_steps, d_first = crf.likelihood(scores, there, labels, steps, first)
    assert got == pytest.approx(value(scores, steps, first))
    for at in zip(*np.nonzero(there)):
        moved = scores.copy()
        moved[at] += 1e-6
        assert (labels[at] - p[at]) == pytest.approx((value(moved, steps, first) - got) / 1e-6, abs=1e-4)
    for at in itertools.product((0, 1), repeat=2):
        moved = steps.copy()
        moved[at] += 1e-6
        assert -d_steps[at] == pytest.approx((value(scores, moved, first) - got) / 1e-6, abs=1e-4)
    for k in (0, 1):
        moved = first.copy()
        moved[k] += 1e-6
        assert -d_first[k] == pytest.approx((value(scores, steps, moved) - got) / 1e-6, abs=1e-4)


def test_viterbi_by_enumeration():
    rng = random.Random(4)
    for n in range(8):
        s = tuple(tuple(rng.gauss(0, 1) for _ in range(2)) for _ in range(2))
        f, scores = (rng.gauss(0, 1), rng.gauss(0, 1)), [rng.gauss(0, 1) for _ in range(n)]

        def weight(y):
            return (f[y[0]] if y else 0) + sum(x * k for x, k in zip(scores, y)) + sum(s[a][b] for a, b in zip(y, y[1:]))

        assert crf.Chain({}, s, f).labels(scores) == list(max(itertools.product((0, 1), repeat=n), key=weight))


@pytest.mark.parametrize(
    "html,blocks",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<b>b<br>c<p>d &lt;e&gt;&#233;&eacute", ["ab c", "d <e>éé"]),
        ("<p>x<!-- <p>no --> y</p><!---->z<!-- open", ["x y", "z"]),
        ("<script>var a='</p><p>';</script><style>p{}</style><title>t</title><p>kept", ["kept"]),
        ("<SCRIPT>if (a<b) {}</SCRIPT ><P CLASS=X>kept<script>open <p>x", ["kept"]),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", ["one", "two", "a", "b", "c"]),
        ('<div title="a > b">in</div><div title=\'>\'>two</div>', ["in", "two"]),
        ('<p title="open>lost</p><p>next</p>', ["lost", "next"]),
        ("<p>3 < 4 <5 <<b>x</b>", ["3 < 4 <5 <x"]),
        ("<p>tail<foo", ["tail"]),
        ("a  \t\n b&nbsp;c", ["a b c"]),
        ("<p>&am", ["&am"]),
        ("<select><option>no</select><textarea>no</textarea><button>no</button>yes", ["yes"]),
    ],
)
def test_leaf_blocks(html, blocks):
    assert [b.text for b in leaf_blocks(html)] == blocks


def test_unseen_layouts(texts, chain):
    tool, right, kept, wanted = Extractor(chain), 0, 0, 0
    for html in layouts.labelled_pages(texts, 300, seed=77):
        blocks = leaf_blocks(html, "data-main")
        for b, y in zip(blocks, tool.labels(blocks)):
            right += len(b.text) * (y and b.label)
            kept, wanted = kept + len(b.text) * y, wanted + len(b.text) * b.label
    assert right / kept > 0.97 and right / wanted > 0.97


def around(inner):
    return f"""<!DOCTYPE html><html><head><title>T</title><script>x('<p>')</script></head><body>
<div class="cookie-banner"><p>We use cookies. Accept all cookies to go on reading this site as usual.</p><button>OK</button></div>
<header><a href="/">The Gazette</a></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
{inner}
<aside class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Mills are closed for good</a></li><li><a href="/2">Boats left behind</a></li></ul></aside>
<form action="/s"><label>Email address</label><input name=e><button>Subscribe</button></form>
<footer><p>&copy; 2024 The Gazette. All rights reserved.</p></footer></body></html>"""


def test_hand_made_pages(chain):
    rng = random.Random(9)
    a, b, c = prose(rng, 3), prose(rng, 2), prose(rng, 4)
    body = f"<h1>Old mills &amp; boats</h1><p>{a}</p><div class='ad'><p>Buy now and save 50%!</p></div><h2>Banks</h2><p>{b}</p><p>{c}</p>"
    comments = f"<section id='comments'><h3>Comments (2)</h3><div class='comment'><p>{prose(rng, 2)}</p></div><div class='comment'><p>{prose(rng, 3)}</p></div></section>"
    want = "\n".join(("Old mills & boats", a, "Banks", b, c))
    tool = Extractor(chain)
    for inner in (f"<article>{body}{comments}</article>", f"<main>{body}</main>{comments}", f"<div class='post-content'>{body}</div><div>{comments}</div>", f"<div id=content><div>{body}</div></div>"):
        assert tool.text(around(inner)) == want
    assert tool.text(None) == tool.text("") == ""


@pytest.mark.parametrize("piece", ["<p>word ", '<a title="x', "<", "<div>", "</b>", "<!--", "&am;", "<script>", "<p title='", "x" * 50, "<select>", "<li>", "</div><div>"])
def test_long_and_broken_pages_take_linear_time(chain, piece):
    start = time.time()
    Extractor(chain).text(piece * 100_000)
    Extractor(chain).text("".join(f"<div class='{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}'>" for k in range(20_000)) + "<p>deep")
    assert time.time() - start < 20


def test_table_of_pages(spark, chain):
    rng = random.Random(2)
    a = prose(rng, 4)
    html = around(f"<article><p>{a}</p></article>")
    rows = [(1, "u", html, "x", 1), (1, "u", html, "x", 1), (2, None, None, None, None), (None, "v", "", "", 0), (3, "w", "<nav>Home</nav>", "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = extracted(pages, chain).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "u", a, len(a)), (1, "u", a, len(a)), (2, None, "", 0), (None, "v", "", 0), (3, "w", "", 0)], key=repr)
    assert extracted(pages.limit(0), chain).count() == 0


def test_query_gives_the_articles(spark):
    from conftest import SMALL

    from rollumen.llm.queries import QUERIES

    got = {r.page_id: r for r in QUERIES["op12_html_extraction"](spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        want = "\n".join(b.text for b in leaf_blocks(p.html) if "in:article" in b.keys)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want)
