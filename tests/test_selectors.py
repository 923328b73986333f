import pytest

from markloom.operators.selectors import Matcher, SelectorError, nth, parse
from markloom.operators.tokenizer import tokenize


@pytest.mark.parametrize(
    "selector, kind",
    [("", "EmptySelector"), ("div >", "DanglingCombinator"), ("a,,b", "EmptySelector"), ("[", "UnexpectedEnd"), ("[=x]", "MissingAttributeName"), ("[a==b]", "UnexpectedTokenInAttribute"), ("a::before", "UnsupportedPseudoClassOrElement"), (":hover", "UnsupportedPseudoClassOrElement"), (":has(a)", "UnsupportedPseudoClassOrElement"), ("a+b", "UnsupportedCombinator"), ("a ~ b", "UnsupportedCombinator"), ("svg|a", "NamespacedSelector"), (".1a", "InvalidClassName"), (":nth-child(2n of a)", "UnexpectedToken")],
)
def test_errors(selector, kind):
    with pytest.raises(SelectorError) as e:
        parse(selector)
    assert e.value.kind == kind


@pytest.mark.parametrize("step", range(-3, 4))
@pytest.mark.parametrize("offset", range(-3, 4))
def test_nth(step, offset):
    reach = {step * n + offset for n in range(50)}
    assert all(nth(step, offset, i) == (i in reach) for i in range(1, 20))


def matches(selector, html):
    m, out = Matcher([parse(selector)]), []
    for t in tokenize(html):
        if t.kind == "start_tag" and m.start_tag(t):
            out.append(t.elem_id)
        elif t.kind == "end_tag":
            m.end_tag(t)
    return out


@pytest.mark.parametrize(
    "selector, tag, holds",
    [("[a^='']", b"<p a=x>", True), ("[a^='']", b"<p a=''>", False), ("[a*='']", b"<p a=x>", False), ("[a~=y]", b"<p a='x y'>", True), ("[a|=x]", b"<p a=x-y>", True), ("[type=TEXT]", b"<input type=text>", True), ("[foo=TEXT]", b"<input foo=text>", False), ("[foo=TEXT i]", b"<input foo=text>", True), ("[type=TEXT s]", b"<input type=text>", False), (".a.b", b"<p class='b a'>", True), ("#x", b"<p id=x id=y>", True), ("#y", b"<p id=x id=y>", False), (":not(.a.b)", b"<p class=a>", False), (":not(:not(p, .a))", b"<p>", False), ("|p", b"<p>", False), ("*|*", b"<p>", True), (r"esi\:include", b"<esi:include>", True)],
)
def test_tests(selector, tag, holds):
    assert bool(matches(selector, tag)) == holds


def test_structure():
    html = b"<article><p>a<p>b<ul><li>x</li><li>y</li></ul></article><p>"
    assert matches("article > p", html) == [1]
    assert matches("article p", html) == [1, 2]
    assert matches("li:nth-child(2n+1)", html) == [4]
    assert matches("ul li, ul > li", html) == [4, 5]
