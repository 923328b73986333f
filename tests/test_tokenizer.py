import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from markloom.operators.tokenizer import AmbiguityError, Context, MemoryLimitError, Stack, scan, tokenize

PIECES = ["<", "</", "!--", "-->", "<script>", "</script>", "<title>", "</title>", "<svg>", "</svg>", "<math>", " ", "a", "=", '"', "'", "/>", ">", "<![CDATA[", "]]>", "<!DOCTYPE", "é", "<p", "x=y", "<br/>", "?", "<desc>", "<style>", "<plaintext>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25))
def test_tokens_cover_the_document(parts):
    html = "".join(parts).encode()
    found = list(tokenize(html, strict=False))
    assert b"".join(html[t.start : t.end] for t in found) == html
    assert all(a.end == b.start for a, b in zip(found, found[1:]))
    assert not any(a.kind == b.kind == "text" for a, b in zip(found, found[1:]))


def kinds(html: bytes):
    return [(t.kind, t.name or (t.text or b"").decode(), t.text_type) for t in tokenize(html)]


@pytest.mark.parametrize(
    "html, expected",
    [
        (b"<script x=>a</script>", ("text", "a", "ScriptData")),
        (b"<title><b></title>", ("text", "<b>", "RCData")),
        (b"<style>a<b</style>", ("text", "a<b", "RawText")),
        (b"<noscript><p></noscript>", ("text", "<p>", "RawText")),
        (b"<svg><style>a</style></svg>", ("text", "a", "Data")),
        (b"<svg><![CDATA[<x>]]></svg>", ("text", "<x>", "CDataSection")),
        (b"<plaintext></p>", ("text", "</p>", "PlainText")),
        (b"<script><!--<script></script>--></script>", ("text", "<!--<script></script>-->", "ScriptData")),
        (b"<?xml a?>", ("comment", "?xml a?", None)),
        (b"</ x>", ("comment", " x", None)),
        (b"<!-- a --!>", ("comment", " a ", None)),
        (b"<!-->x", ("comment", "", None)),
        (b"<p a", ("raw", "", None)),
    ],
)
def test_text_modes_and_comments(html, expected):
    assert expected in kinds(html)


def test_doctypes():
    html = b'<!DOCTYPE html><!doctype><!DOCTYPE html PUBLIC "p" \'s\'><!DOCTYPE html SYSTEM "a"><!DOCTYPE html foo>'
    assert [t.doctype for t in scan(html, Context())] == [("html", None, None, False), (None, None, None, True), ("html", "p", "s", False), ("html", None, "a", False), ("html", None, None, True)]


def test_attributes_keep_duplicates_and_case():
    (t,) = tokenize(b"<P A=1 a='2' b=\"3\" c/>")
    assert [(a.name, a.name_raw, a.value) for a in t.attrs] == [("a", "A", "1"), ("a", "a", "2"), ("b", "b", "3"), ("c", "c", "")]
    assert t.self_closing


def test_no_implied_end_tags():
    around = [t.anc for t in tokenize(b"<div><p>a<p>b</div></p>")]
    found = list(tokenize(b"<div><p>a<p>b</div></p>"))
    assert around[3] == (0, 1) and (found[3].parent, found[3].depth) == (1, 2) and found[5].popped == (0, 1, 2) and found[6].popped == ()
    assert found[0].close_tok == found[1].close_tok == 5


@pytest.mark.parametrize("html", [b"<select><title>", b"<frameset><style>", b"<select><template><xmp>"])
def test_ambiguity(html):
    with pytest.raises(AmbiguityError):
        list(tokenize(html))
    list(tokenize(html, strict=False))


def test_namespaces():
    found = {t.name: t.ns for t in tokenize(b"<svg><desc><b></b></desc><circle/></svg><math><mi><i></i></mi></math><p>") if t.kind == "start_tag"}
    assert found == {"svg": "svg", "desc": "html", "b": "html", "circle": "svg", "math": "mathml", "mi": "html", "i": "html", "p": "html"}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*PIECES, "--!>", "b c", "-"]), max_size=25), st.lists(st.integers(1, 9), min_size=1, max_size=9))
def test_pieces_give_the_tokens_of_the_whole(parts, sizes):
    html, at, rest, got, ctx, k = "".join(parts).encode(), 0, b"", [], Context(strict=False), 0
    while True:
        final = at >= len(html)
        data = rest + html[at : at + sizes[k % len(sizes)]]
        at, k = at + sizes[k % len(sizes)], k + 1
        for t in scan(data, ctx, final):
            if got and got[-1][0] == "text" == t.kind and got[-1][-1]:
                got[-1] = ("text", None, got[-1][2] + t.text, t.text_type, got[-1][4] + data[t.start : t.end], t.partial)
            else:
                got.append((t.kind, t.name, t.text, t.text_type, data[t.start : t.end], t.partial))
        rest = data[ctx.held :]
        if final:
            break
    assert [x[:5] for x in got] == [(t.kind, t.name, t.text, t.text_type, html[t.start : t.end]) for t in scan(html, Context(strict=False))]


def test_depth_needs_linear_memory():
    import tracemalloc

    def peak(n):
        tracemalloc.start()
        assert sum(1 for _ in tokenize(b"<p>a" * n, stack=Stack(closes=False))) == 2 * n
        out = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out

    assert peak(60_000) < 2.6 * peak(30_000) and peak(30_000) < 30_000 * 700
    with pytest.raises(MemoryLimitError):
        list(tokenize(b"<p>" * 17, stack=Stack(limit=4096)))
    assert len(list(tokenize(b"<p>" * 16, stack=Stack(limit=4096)))) == 16
