"""Names inside articles that only look like menus, and those that are."""

import math
import random
import time
from collections import defaultdict

import pytest

from markloom.llm import html_text
from markloom.llm.common import Scratch


@pytest.mark.parametrize(
    "inner, want",
    [
        ('<section id="related-work"><h2>Related work</h2><p>Others did it.</p></section>', "Related work Others did it."),
        ('<h2 id="search-results">Search</h2><p>Found <a href=x>one</a> thing.', "Search Found one thing."),
        ('<div class="form-example"><p>Fill it in.</p></div>', "Fill it in."),
        ('<p>See <a class="related" href=x>that</a> <span class="notice">note</span>.', "See that note."),
        ('<div class="related"><h3>More</h3><ul><li><a href=1>First story</a><li><a href=2>Second story</a></ul></div><p>end', "end"),
        ('<div class="form-example"><p>Kept text here.</p><ul class="share"><li><a href=1>Share</a></ul></div>', "Kept text here."),
        ('<div class="ads">Buy</div><div class="comments"><p>bad</p></div><nav>n</nav><p>end', "end"),
    ],
)
def test_words_inside_an_article(inner, want):
    assert html_text.main_text(f"<body><article>{inner}</article>") == want
    assert html_text.main_text(f"<body><main>{inner}</main>") == want


def pages_of(spark, made):
    return spark.createDataFrame([(k, f"http://{host}/{k}", html) for k, (host, html) in enumerate(made)], "page_id long, url string, html string")


def unique(k, n=3):
    return "".join(f"<p>{' '.join(f'w{k}x{j}y{i}' for i in range(12))}</p>" for j in range(1 + (k + n) % n))


def body(k, n=3):
    return " ".join(" ".join(f"w{k}x{j}y{i}" for i in range(12)) for j in range(1 + (k + n) % n))


def sites():
    """Hosts whose names say nothing: what is a menu or a notice shows only in what their pages share."""
    entries = [f"Entry {k}" for k in range(9)]
    made, want = [], []
    for k in range(30):
        r = random.Random(k)
        menu = "".join(f"<div class=q><a href=/{e}>{e}</a></div>" for e in r.sample(entries, 6))
        note = "<div class=z>Please support this site with a gift</div>"
        made.append(("menus", f"<body><div class=x1>{menu}</div><div class=x2><h2>Title {k}</h2>{unique(k)}</div>{note}</body>"))
        want.append(f"Title {k} {body(k)}")
    for k in range(12):
        made.append(("notes", f"<article><h1>t{k}</h1>{unique(k)}<p>All rights of these words are reserved here.</p></article>"))
        want.append(f"t{k} {body(k)}")
    for k in range(12):
        made.append(("copies", f"<article><p>same text everywhere</p></article><!-- {k} -->"))
        want.append("same text everywhere")
    for k in range(3):
        made.append(("few", f"<article><p>same words</p>{unique(k)}</article>"))
        want.append(f"same words {body(k)}")
    return made, want


def test_the_tree_alone_finds_menus(spark):
    made, want = sites()
    df = pages_of(spark, made)
    got = {limit: [r["text"] for r in html_text.extract(df, broadcast=limit).orderBy("page_id").collect()] for limit in (100_000, 0)}
    assert got[100_000] == want and got[0] == want
    alone = [html_text.main_text(h) for _, h in made]
    assert sum(a != b for a, b in zip(alone, want, strict=True)) == 42  # so many pages the tree changes


def test_importance_against_brute_force(spark):
    made, _ = sites()
    df = pages_of(spark, made)
    scratch = Scratch(spark, "t")
    nodes, low = html_text.importance(scratch.write(html_text.parse(df), "pages"), scratch)
    has, shown, said = defaultdict(set), defaultdict(set), defaultdict(set)
    for host, html in set(made):
        texts, at, keys, _, _, styles, contents = html_text.Page(html.encode(), host).tree()
        for key, style in zip(keys, styles, strict=True):
            has[key].add(html), shown[key, style].add(html)
        for k, c in zip(at, contents, strict=True):
            said[keys[k], c].add(html)
    node, content = {}, {}
    for key, on in has.items():
        if len(on) < 2:
            continue
        top = math.log(len(on) + html_text.PRIOR)

        def mean(table):
            parts = [len(v) for (a, _), v in table.items() if a == key]
            return 1 - sum(k * math.log(k) for k in parts) / (sum(parts) * top) if parts else 1.0

        node[key] = (mean(shown), mean(said))
        content |= {c: 1 - math.log(len(v)) / top for (a, c), v in said.items() if a == key}
    want = {k: v for k, v in node.items() if min(v) < 0.95}
    got = {r["key"]: (r["presentation"], r["content"]) for r in nodes.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {r["key"]: r["content"] for r in low.collect()} == pytest.approx({c: v for c, v in content.items() if v < html_text.LOW})


def test_null_ids_and_repeated_rows(spark):
    made, want = sites()
    rows = [(None if k % 2 else 7, f"http://{host}/{k}", html) for k, (host, html) in enumerate(made)] + [(None, None, None), (None, None, "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (100_000, 0):
        assert sorted(r["text"] for r in html_text.extract(df, broadcast=limit).collect()) == sorted([*want, "", ""])


def test_a_word_in_doubt_needs_less():
    page = "<article><p>Short.</p><div class=notice><p>The same long notice stands on most pages of this host.</p></div></article>"
    tree = html_text.Page(page.encode())
    _, _, keys, *_ = tree.tree()
    notice = next(k for k, d in zip(tree.keys, tree.doubtful, strict=True) if d)
    assert html_text.main_text(page).endswith("of this host.")
    assert html_text.main_text(page, {notice: (0.2, 1.0), keys[-1]: (1.0, 0.5)}) == "Short."
    assert html_text.main_text(page, {keys[-1]: (1.0, 0.9)}).endswith("of this host.")


def test_nothing_else_is_dropped():
    page = '<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p><p class="search-result">kept?</p><ul class="share-list"><li>yes</ul><svg><text>label</text><title>tip</title></svg><object>shown</object></article>'
    assert html_text.main_text(page) == "Let x=2 be kept? yes label shown"


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a '\">", "<div>", "<p>", "<b><i>", "</p>", "<li><ul>", "<center><p>", "<!--", "<!x", "< ", "<div class=related>", "<article><header>", "<math><mi>", "&amp;", "<td><tr>"])
def test_parsing_is_linear(part):
    def took(n):
        began = time.perf_counter()
        html_text.Page((part * (n // len(part))).encode()).tree()
        return time.perf_counter() - began

    took(50_000)
    small, large = took(250_000), took(1_000_000)
    assert large < 12 * small + 0.5  # quadratic would be 16 times


def test_words_outside_articles_decide():
    assert html_text.main_text("<body><div id=related>x</div><div class=sidebar>y</div><p>z</p>") == "z"
