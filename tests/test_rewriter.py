import pytest

from markloom.operators.relations import Options
from markloom.operators.rewriter import RewriteError, Rewriting, Rule, rewrite, rewrite_document, rewrite_str, rewriting


def run(html, *rules):
    return rewrite_str(html, rewriting(list(rules)))


@pytest.mark.parametrize(
    "html, rule, expected",
    [
        ("<div>x</div>", Rule("div", "before", "<"), "&lt;<div>x</div>"),
        ("<div>x</div>", Rule("div", "after", "<a>", html=True), "<div>x</div><a>"),
        ("<br>x", Rule("br", "after", "y"), "<br>yx"),
        ("<div>x</div>", Rule("div", "set_inner_content", "y"), "<div>y</div>"),
        ("<div>x<p>y</div>z", Rule("div", "replace", "r"), "rz"),
        ("<div>x</div>z", Rule("div", "remove"), "z"),
        ("<div>x</div>z", Rule("div", "remove_and_keep_content"), "xz"),
        ("<div><p>x</div>", Rule("*", "append", "!"), "<div><p>x!</div>"),
        ("<svg><g>x</svg>", Rule("g", "set_tag_name", "h"), "<svg><h>x</h>"),
        ("<div>x", Rule("div", "append", "y"), "<div>x"),
        ("<div>x", Rule("div", "remove"), ""),
        ("<A  B = 'c' / d>", Rule("a", "set_attribute", 'q"', name="e"), "<A B = 'c' d e=\"q&quot;\">"),
        ("<a HREF=x href=y>", Rule("a", "set_attribute", "z", name="href"), '<a HREF="z" href=y>'),
        ("<a HREF=x href=y b>", Rule("a", "remove_attribute", name="href"), "<a b>"),
        ("<img a/>", Rule("img", "set_attribute", "1", name="b"), '<img a b="1" />'),
        ("<p>a<!--b-->c</p>", Rule("p", "set_text", "x", target="comments"), "<p>a<!--x-->c</p>"),
        ("<p>a<b>c</b></p>", Rule("p", "remove", target="text"), "<p><b></b></p>"),
    ],
)
def test_edits(html, rule, expected):
    assert run(html, rule) == expected


def test_order_of_insertions():
    def edit(el):
        for k in "12":
            el.before(k), el.after(k), el.prepend(k), el.append(k)

    assert rewrite_str("<p>x</p>", Rewriting().on("p", element=edit)) == "12<p>21x12</p>21"


def test_end_tags_texts_and_document():
    seen = []

    def element(el):
        el.on_end_tag(lambda tag: tag.before("!"))

    how = Rewriting().on("p", element=element, text=lambda t: seen.append((t.text, t.last_in_text_node))).on_document(end=lambda e: e.append("end"))
    assert rewrite_str("<p>a</p>", how) == "<p>a!</p>end"
    assert seen == [("a", False), ("", True)]


def test_errors_and_bail_out():
    def bad(el):
        el.name = "1"

    how = Rewriting().on("b", element=bad).on_document(bail_out=lambda e: e.append("<!--", html=True))
    with pytest.raises(RewriteError):
        rewrite_str("<b>", how)
    out, error = rewrite_document(b"<a>x</a><b>y", how, graceful=True)
    assert out == b"<a>x</a><!--<b>y" and error[0] == "ContentHandlerError"
    assert rewrite_document(b"<a>xyz", how, Options(max_bytes=3))[1][0] == "MemoryLimitExceeded"


def test_rewrite_rows(spark):
    df = spark.createDataFrame([(1, "<p>é</p>"), (2, None), (3, ""), (4, "<select><title>")], "doc_id long, html string")
    got = {r["doc_id"]: r for r in rewrite(df, [Rule("p", "append", "&")]).collect()}
    assert got[1]["html_out"] == "<p>é&amp;</p>" and got[2]["html_out"] is None and got[3]["html_out"] == ""
    assert got[4]["error"]["kind"] == "ParsingAmbiguity"
