"""Registered queries over small documents that are written here, each with its expected rows as SQL values.

The driver's pages have one template; what they can't show (text modes, foreign content, errors, encodings, every kind of
edit, documents in pieces) is shown on these.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import relations as R
from ..operators.relations import Options
from ..operators.rewriter import Rewriter, RewriteError, Rewriting, Rule, Stop, rewrite, rewriting
from ..operators.selectors import SelectorError, explain, parse

QUERIES: dict = {}
ORACLES: dict = {}


def _sql(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return f"CAST({v} AS INTEGER)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_sql, r)) + ')' for r in rows)}) AS t({columns})"


def _add(name: str, columns: str, rows: list[tuple], query) -> None:
    QUERIES[name], ORACLES[name] = query, _values(columns, rows)


def _docs(spark: SparkSession, docs: list) -> DataFrame:
    kind = "binary" if docs and isinstance(docs[0], bytes) else "string"
    return spark.createDataFrame(list(enumerate(docs)), f"doc_id int, html {kind}")


# -- tokens


def _tokens(name: str, docs: list[str], want: list[tuple], kinds=None, columns=("kind", "name", "text", "text_type"), options=Options(strict=False)) -> None:
    def query(spark, sf_dir):
        return R.tokens(_docs(spark, docs), options=options, kinds=kinds, columns=columns)

    _add(name, ", ".join(("doc_id", *columns)), want, query)


_tokens(
    "tokens_text_modes",
    ["<title>a<b>c</title>", "<style>x</p></style>", "<script>if(a<b)</script>", "<script><!--<script>x</script>--></script>", "<plaintext></p>", "<svg><![CDATA[<x>]]></svg>", "<svg><style>a</style></svg>", "<textarea></p></textarea >y"],
    [(0, "a<b>c", "RCData"), (1, "x</p>", "RawText"), (2, "if(a<b)", "ScriptData"), (3, "<!--<script>x</script>-->", "ScriptData"), (4, "</p>", "PlainText"), (5, "<x>", "CDataSection"), (6, "a", "Data"), (7, "</p>", "RCData"), (7, "y", "Data")],
    ("text",), ("text", "text_type"),
)
_tokens(
    "tokens_comments",
    ["<!-- a --!>b", "<!-->c", "<?pi x?>", "</ y>", "<!x>", "<!--open-"],
    [(0, " a "), (1, ""), (2, "?pi x?"), (3, " y"), (4, "x"), (5, "open")],
    ("comment",), ("text",),
)
_tokens(
    "tokens_raw_markup",
    ["a</>b", "<svg><![CDATA[x]]></svg>", "<p a", "<3"],
    [(0, 1, 4), (1, 5, 14), (1, 15, 18), (2, 0, 4)],
    ("raw",), ("byte_start", "byte_end"),
)
ORACLES["tokens_raw_markup"] = "SELECT doc_id, CAST(byte_start AS BIGINT) AS byte_start, CAST(byte_end AS BIGINT) AS byte_end FROM (" + ORACLES["tokens_raw_markup"] + ")"
_tokens(
    "element_namespaces",
    ["<svg><desc><b></b></desc><circle/></svg><math><mi><i></i></mi></math><p>", "<svg><p>x", "<math><annotation-xml encoding=text/html><b></b></annotation-xml><x>"],
    [(0, "svg", "svg", True), (0, "desc", "html", True), (0, "b", "html", True), (0, "circle", "svg", False), (0, "math", "mathml", True), (0, "mi", "html", True), (0, "i", "html", True), (0, "p", "html", True), (1, "svg", "svg", True), (1, "p", "html", True), (2, "math", "mathml", True), (2, "annotation-xml", "html", True), (2, "b", "html", True), (2, "x", "mathml", True)],
    ("start_tag",), ("name", "ns", "can_have_content"),
)
_tokens(
    "element_counters",
    ["<ul><li><b></b><li><i></i></ul><br><p/>"],
    [(0, "ul", None, 0, 1, 1), (0, "li", 0, 1, 1, 1), (0, "b", 1, 2, 1, 1), (0, "li", 1, 2, 2, 1), (0, "i", 3, 3, 1, 1), (0, "br", None, 0, 2, 1), (0, "p", None, 0, 3, 1)],
    ("start_tag",), ("name", "parent_id", "depth", "nth_child", "nth_of_type"),
)
_tokens("element_esi", ["<esi:include><esi:comment/><esi:remove>"], [(0, "esi:include", False), (0, "esi:comment", False), (0, "esi:remove", True)], ("start_tag",), ("name", "can_have_content"), Options(esi=True))


def _attribute_rows(spark, sf_dir):
    return R.attributes(_docs(spark, ["<P A=1 a='2' b=\"3\" c = d e/>", "<a x=/ y==z>"])).select("doc_id", "pos", "name", "name_raw", "value", "raw")


_add(
    "attribute_lists", "doc_id, pos, name, name_raw, value, raw",
    [(0, 0, "a", "A", "1", "A=1"), (0, 1, "a", "a", "2", "a='2'"), (0, 2, "b", "b", "3", 'b="3"'), (0, 3, "c", "c", "d", "c = d"), (0, 4, "e", "e", "", "e"), (1, 0, "x", "x", "/", "x=/"), (1, 1, "y", "y", "=z", "y==z")],
    _attribute_rows,
)


def _doctypes(spark, sf_dir):
    docs = ["<!DOCTYPE html>", "<!doctype>", "<!DOCTYPE HTML PUBLIC 'p' \"s\">", "<!DOCTYPE html SYSTEM 'x'>", "<!DOCTYPE html foo>"]
    return R.tokens(_docs(spark, docs), kinds=("doctype",), columns=("doctype",)).select("doc_id", "doctype.*")


_add("doctype_ids", "doc_id, name, public_id, system_id, force_quirks", [(0, "html", None, None, False), (1, None, None, None, True), (2, "html", "p", "s", False), (3, "html", None, "x", False), (4, "html", None, None, True)], _doctypes)


def _status(spark, sf_dir):
    docs = ["<p>", "<select><title>", "<select><template><xmp>", "<frameset><style>", "<select></select><title>", None]
    return R.doc_status(_docs(spark, docs)).select("doc_id", F.col("error.kind").alias("error"))


_add("strict_ambiguity", "doc_id, error", [(0, None), (1, "ParsingAmbiguity"), (2, "ParsingAmbiguity"), (3, "ParsingAmbiguity"), (4, None), (5, None)], _status)


def _limits(spark, sf_dir):
    docs = ["<p>" * 16, "<p>" * 17, "<p></p>" * 40, "<br>" * 40]
    return R.doc_status(_docs(spark, docs), options=Options(max_memory=4096, max_bytes=300)).select("doc_id", F.col("error.kind").alias("error"), "encoding_out")


_add("stack_limits", "doc_id, error, encoding_out", [(0, None, "utf-8"), (1, "MemoryLimitExceeded", "utf-8"), (2, None, "utf-8"), (3, None, "utf-8")], _limits)

# -- selectors

_TREE = "<div id=a class='x y' lang=en-GB><p class=Y title='one two'>1</p><p data-n=Q>2</p><esi:x></esi:x><svg viewBox=1><P Type=text></svg></div><input TYPE=Text foo=Bar>"
#: Selector, ids of the elements that match in _TREE.
_MATCHES = {
    "*": (0, 1, 2, 3, 4, 5, 6), "|p": (), "*|p": (1, 2, 5), "P": (1, 2, 5), "#a": (0,), ".x": (0,), ".y": (0,), "p.Y": (1,), "[title]": (1,), "[title='one two']": (1,), "[title~=two]": (1,), "[title~='']": (), "[title^=one]": (1,),
    "[title$=two]": (1,), "[title*='e t']": (1,), "[lang|=en]": (0,), "[type=TEXT]": (5, 6), "[type=TEXT s]": (), "[foo=bar]": (), "[foo=bar i]": (6,), "[data-n=q I]": (2,), ":not(p)": (0, 3, 4, 6), "p:not(.Y):not([type])": (2,),
    ":not(:not(p))": (1, 2, 5), "div > p": (1, 2), "div p": (1, 2, 5), "p, input": (1, 2, 5, 6), r"esi\:x": (3,), r"#\61": (0,), "p:nth-child(2)": (2,), "p:first-child": (1, 5), "p:nth-of-type(odd)": (1, 5), "div/**/>/* > */p": (1, 2), "[title='/*x*/']": (), ":not(p, div)": (3, 4, 6),
}


def _selected(spark, sf_dir):
    names = list(_MATCHES)
    found = R.select(_docs(spark, [_TREE]), names, columns=("elem_id",))
    return found.select(F.element_at(F.array(*map(F.lit, names)), F.col("match_id") + 1).alias("selector"), "elem_id")


_add("selector_matches", "selector, elem_id", [(s, k) for s, ids in _MATCHES.items() for k in ids], _selected)
#: Selector, kind of its error.
_ERRORS = {
    "div@": "UnexpectedToken", "div.": "UnexpectedEnd", 'div[="foo"]': "MissingAttributeName", "": "EmptySelector", "div >": "DanglingCombinator", 'div[foo~"bar"]': "UnexpectedTokenInAttribute", "svg|img": "NamespacedSelector",
    "[*|Foo]": "NamespacedSelector", "[*|Foo=bar]": "NamespacedSelector", ".foo()": "InvalidClassName", ":not()": "EmptySelector", "div + span": "UnsupportedCombinator", "div ~ span": "UnsupportedCombinator", ":nth-child(n of a)": "UnexpectedToken",
    ":not(foo bar)": "UnsupportedPseudoClassOrElement", ":not(foo > bar)": "UnsupportedPseudoClassOrElement", ":not(* > .x)": "UnsupportedPseudoClassOrElement", ":hover": "UnsupportedPseudoClassOrElement", ":has(div)": "UnsupportedPseudoClassOrElement",
    ":is(p)": "UnsupportedPseudoClassOrElement", ":nth-last-child(1)": "UnsupportedPseudoClassOrElement", ":lang(en)": "UnsupportedPseudoClassOrElement", "::before": "UnsupportedPseudoClassOrElement", "::slotted()": "UnsupportedPseudoClassOrElement",
    ":not(:nth-last-child(even))": "UnsupportedPseudoClassOrElement", "p": None, ":not(:not(div))": None,
}


def _parsed_kinds(spark, sf_dir):
    def kind(s):
        try:
            parse(s)
        except SelectorError as e:
            return e.kind
        return None

    return spark.createDataFrame([(s, kind(s)) for s in _ERRORS], "selector string, error string")


_add("selector_errors", "selector, error", list(_ERRORS.items()), _parsed_kinds)
_EXPLAINED = "ul  => 0\n  > li  => 1\n    a[href]  => 3\n:not(.x)  => 2"


def _explained(spark, sf_dir):
    return spark.createDataFrame([(explain(["ul", "ul > li", ":not(.x)", "ul > li a[href]"]),)], "program string")


_add("selector_explain", "program", [(_EXPLAINED,)], _explained)


def _table_functions(spark, sf_dir):
    tables.register(spark)
    _docs(spark, ["<ul><li a=1 a=2>x</ul><!--c-->"]).createOrReplaceTempView("markloom_case_docs")
    return spark.sql(
        "SELECT 'tokens' AS f, s.kind AS a, s.text AS b FROM markloom_case_docs, LATERAL html_tokens(html) s UNION ALL"
        " SELECT 'elements', s.name, cast(s.depth AS string) FROM markloom_case_docs, LATERAL html_elements(html) s UNION ALL"
        " SELECT 'select', s.name, array_join(transform(s.attrs, x -> x.value), ',') FROM markloom_case_docs, LATERAL html_select(html, 'ul > li') s"
    )


_add(
    "table_functions", "f, a, b",
    [("tokens", "start_tag", None), ("tokens", "start_tag", None), ("tokens", "text", "x"), ("tokens", "end_tag", None), ("tokens", "comment", "c"), ("elements", "ul", "0"), ("elements", "li", "1"), ("select", "li", "1,2")],
    _table_functions,
)

# -- rewrites: (document, how, expected output, expected error), one pass for each


def _rewrites(name: str, cases: list[tuple], options: Options = Options(esi=True), graceful: bool | str = False) -> None:
    def query(spark, sf_dir):
        out = None
        for k, (doc, how, *_) in enumerate(cases):
            df = spark.createDataFrame([(k, doc)], f"doc_id int, html {'binary' if isinstance(doc, bytes) else 'string'}")
            made = rewrite(df, how, options=options, graceful=graceful)
            shown = F.hex("html_out") if isinstance(doc, bytes) else F.col("html_out")
            made = made.select("doc_id", shown.alias("html_out"), "encoding_out", F.col("error.kind").alias("error"))
            out = made if out is None else out.unionByName(made)
        return out

    rows = [(k, e.hex().upper() if isinstance(e, bytes) else e, more[1] if len(more) > 1 else "utf-8", more[0] if more else None) for k, (_, _, e, *more) in enumerate(cases)]
    _add(name, "doc_id, html_out, encoding_out, error", rows, query)


def _made(selector: str | None = None, element=None, comments=None, text=None, **document):
    """A factory of handlers."""

    def how() -> Rewriting:
        out = Rewriting()
        if selector:
            return out.on(selector, element=element, comments=comments, text=text).on_document(**document)
        return out.on_document(comments=comments, text=text, **document)

    return how


def _text(**rule) -> list[Rule]:
    return [Rule("p", target="text", **rule)]


_rewrites(
    "text_edits",
    [
        ("<p>a<b>c</b></p>d", _text(action="remove"), "<p><b></b></p>d"),
        ("<p>a</p>", _text(action="before", content="<"), "<p>&lt;a</p>"),
        ("<p>a</p>", _text(action="after", content="<i>", html=True), "<p>a<i></p>"),
        ("<p>a</p>", _text(action="replace", content="&"), "<p>&amp;</p>"),
        ("<p>a</p>", _text(action="set_text", content="z"), "<p>z</p>"),
        ("<p>a</p>", _made("p", text=lambda t: t.after("!") if t.last_in_text_node else None), "<p>a!</p>"),
        ("x<p>a</p>", _made(text=lambda t: t.replace(t.text.upper()) if t.text else None), "X<p>A</p>"),
    ],
)


def _shout(c) -> None:
    c.text = c.text.upper()


_rewrites(
    "comment_edits",
    [
        ("<p><!--a--></p><!--b-->", [Rule("p", "remove", target="comments")], "<p></p><!--b-->"),
        ("<p><!--a--></p>", [Rule("p", "before", "<", target="comments")], "<p>&lt;<!--a--></p>"),
        ("<p><!--a--></p>", [Rule("p", "after", "<i>", html=True, target="comments")], "<p><!--a--><i></p>"),
        ("<p><!--a--></p>", [Rule("p", "replace", "r", target="comments")], "<p>r</p>"),
        ("<!--a--><?pi>", _made(comments=_shout), "<!--A--><!--?PI-->"),
        ("<p><!--a--></p>", [Rule("p", "set_text", "x-->y", target="comments")], None, "ContentHandlerError"),
    ],
)


def _strip_doctype(d) -> None:
    if d.name == "html":
        d.remove()


_rewrites("doctype_edits", [("<!DOCTYPE html><p>", _made(doctype=_strip_doctype), "<p>"), ("<!DOCTYPE x><p>", _made(doctype=_strip_doctype), "<!DOCTYPE x><p>"), ("<p>", _made(end=lambda e: e.append("<e>")), "<p>&lt;e&gt;")])


def _on_end(edit):
    return lambda el: el.on_end_tag(edit)


def _rename(tag) -> None:
    tag.name = "Q"


def _start_only(el) -> None:
    el.start_tag.set_attribute("k", "v")
    el.start_tag.after("+")


_rewrites(
    "tag_edits",
    [
        ("<p>x</P>", _made("p", _on_end(_rename)), "<p>x</Q>"),
        ("<p>x</p>", _made("p", _on_end(lambda t: t.before("1"))), "<p>x1</p>"),
        ("<p>x</p>", _made("p", _on_end(lambda t: t.after("1"))), "<p>x</p>1"),
        ("<p>x</p>", _made("p", _on_end(lambda t: t.remove())), "<p>x"),
        ("<p>x</p>", _made("p", _on_end(lambda t: t.replace("<r>", html=True))), "<p>x<r>"),
        ("<p>x</p>", _made("p", _start_only), '<p k="v">+x</p>'),
        ("<p>x</p>", _made("p", lambda el: el.start_tag.remove()), "x</p>"),
        ("<br>x", _made("br", _on_end(_rename)), None, "ContentHandlerError"),
        ("<svg a/><g/>", _made("svg", lambda el: el.set_attribute("s", str(el.is_self_closing) + str(el.can_have_content))), '<svg a s="TrueFalse" /><g/>'),
    ],
)


def _twice(el) -> None:
    for k in "12":
        el.before(k), el.after(k), el.prepend(k), el.append(k)


def _streams(el) -> None:
    def write(sink) -> None:
        sink.write_str("<")
        sink.write_utf8_chunk("é".encode()[:1])
        sink.write_utf8_chunk("é".encode()[1:], html=True)

    el.before(write)
    el.append(write)


def _pass_on(el) -> None:
    el.user_data = [*(el.user_data or []), el.source_location[0]]
    el.set_attribute("d", str(el.user_data))


def _ordered() -> Rewriting:
    said: list[str] = []
    out = Rewriting().on("p", element=lambda el: said.append("p"), text=lambda t: said.append("pt") if t.text else None).on("*", element=lambda el: said.append("*"))
    return out.on_document(text=lambda t: said.append("t") if t.text else None, end=lambda e: e.append(" ".join(said)))


def _user_data() -> Rewriting:
    return Rewriting().on("p", element=_pass_on).on("p", element=_pass_on)


_rewrites(
    "handler_order",
    [
        ("<p>x</p>", _made("p", _twice), "12<p>21x12</p>21"),
        ("<p>x</p>", _made("p", _streams), "&lt;é<p>x&lt;é</p>"),
        ("<i></i><p>x</p>", _user_data, '<i></i><p d="[7, 7]">x</p>'),
        ("<p>x</p>", _ordered, "<p>x</p>p * pt t"),
        ("<p>x</p>", _made("p", lambda el: el.remove() or el.before(str(el.removed))), "True"),
    ],
)


def _refuse(el) -> None:
    raise ValueError("no")


def _stop_class(el):
    return Stop


def _bad_name(el) -> None:
    el.name = "1a"


_rewrites(
    "errors_end_documents",
    [("<a>x</a><b>y", _made("b", _refuse), None, "ContentHandlerError"), ("<a>x</a><b>y", _made("b", _stop_class), None, "Stopped"), ("<b>", _made("b", _bad_name), None, "ContentHandlerError"), ("<select><title>", [], None, "ParsingAmbiguity")],
)
_rewrites(
    "graceful_bail_out",
    [
        ("<a>1</a><b>2<c>", _made("b", _refuse, bail_out=lambda e: e.append("<!--!-->", html=True)), "<a>1</a><!--!--><b>2<c>", "ContentHandlerError"),
        ("<div>a<!--x-->b</div>", _made("div", comments=_refuse), "<div>a<!--x-->b</div>", "ContentHandlerError"),
        ("<p>x</p>", _made(end=_refuse), "<p>x</p>", "ContentHandlerError"),
        ("<i></i>" + "<div>" * 20, [Rule("i", "remove")], "<div>" * 20, "MemoryLimitExceeded"),
        ("<select><title>x", [], None, "ParsingAmbiguity"),
    ],
    Options(max_memory=4096), True,
)

_THREE = [Rule("p", "append", "ж漢")]


def _louder(t) -> None:
    if t.text:
        t.replace(t.text.replace("!", "!!"))


_rewrites(
    "charset_switch",
    [
        (b"<meta charset=windows-1251><p>\xd5!</p>", _made(text=_louder), b"<meta charset=windows-1251><p>\xd5!!</p>", None, "windows-1251"),
        (b"<title>\xc3\xb0</title><meta charset=latin1>\xf0!", _made(text=_louder), b"<title>\xc3\xb0</title><meta charset=latin1>\xf0!!", None, "windows-1252"),
        (b"<head>\xc3<meta charset=latin1>\xb0</head>", _made(text=lambda t: None), b"<head>\xef\xbf\xbd<meta charset=latin1>\xb0</head>", None, "windows-1252"),
        (b"<meta http-equiv='conTent-type' content='text/html; charset=koi8-r'><meta charset=utf-8><p></p>", _THREE, b"<meta http-equiv='conTent-type' content='text/html; charset=koi8-r'><meta charset=utf-8><p>\xd6&#28450;</p>", None, "koi8-r"),
        (b"<meta charset=utf-16><p>\xff</p>", _THREE, b"<meta charset=utf-16><p>\xff" + "ж漢".encode() + b"</p>", None, "utf-8"),
    ],
    Options(adjust_charset=True),
)


def _rename_to(name):
    def run(el) -> None:
        el.name = name

    return run


_rewrites(
    "legacy_encodings",
    [
        (b"<p>\x83\x5c<b>\xff</b></p>", [Rule("b", "set_attribute", "ソ", name="k")], b'<p>\x83\x5c<b k="\x83\x5c">\xff</b></p>', None, "shift_jis"),
        (b"<p></p>", [Rule("p", "append", "é")], b"<p>&#233;</p>", None, "shift_jis"),
        (b"<p></p>", _made("p", _rename_to("fooøbar")), None, "ContentHandlerError", "shift_jis"),
        (b"<p><!--x--></p>", [Rule("p", "set_text", "é", target="comments")], None, "ContentHandlerError", "shift_jis"),
    ],
    Options(encoding="shift_jis"),
)
_rewrites("binary_passthrough", [(b"<p>\xe9\xff</p>", [], b"<p>\xe9\xff</p>"), (b"\xff<p a=\xfe>", [Rule("p", "set_attribute", "1", name="b")], b'\xff<p a=\xfe b="1">')])


# -- in pieces


def _in_pieces(df: DataFrame, how: list[Rule], size: int, options: Options = Options()) -> DataFrame:
    """Rewrites each document as if it came in pieces of ``size`` bytes, with what the rewriter gives out joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc in batch.column(1).to_pylist():
                data, r = (doc or "").encode(), Rewriter(rewriting(how), options)
                got = [r.write(data[i : i + size]) for i in range(0, len(data), size)]
                out.append(b"".join([*got, r.end()]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["page_id", "html_out"])

    return df.select("page_id", "html").mapInArrow(run, "page_id long, html_out string")


def rewrite_in_pieces(spark, sf_dir):
    pages = R.spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))
    return _in_pieces(pages, [Rule("h1", "set_tag_name", "h2"), Rule("footer", "append", "<hr>", html=True)], 700)


QUERIES["rewrite_in_pieces"] = rewrite_in_pieces
ORACLES["rewrite_in_pieces"] = "SELECT page_id, replace(replace(replace(html, '<h1>', '<h2>'), '</h1>', '</h2>'), '</footer>', '<hr></footer>') AS html_out FROM pages"


def _piecewise(spark, sf_dir):
    """What each write gives out, its error, and that nothing is taken after it."""
    cases = [
        ([b"<p>a</p><im", b"g><p", b">b"], Options(), False), ([b"<img alt='" + b"l" * 60, b"r" * 60 + b"'>"], Options(max_memory=100), True), ([b"<!--a--><img alt='" + b"l" * 60, b"r" * 60 + b"'>"], Options(max_memory=100), False),
        ([b"<im"], Options(max_memory=1), True), ([b"<!--a", b"-->b ", b"c"], Options(), False),
    ]
    rows = []
    for k, (pieces, options, graceful) in enumerate(cases):
        r = Rewriter(rewriting([Rule("*", "set_text", "z", target="comments"), Rule("p", "before", "+")]), options, graceful)
        for i, piece in enumerate([*pieces, None]):
            try:
                out = (r.end() if piece is None else r.write(piece)).decode()
            except RewriteError as e:
                out = e.kind
            rows.append((k, i, out, r.error[0] if r.error else None))
    return spark.createDataFrame(rows, "doc_id int, piece int, html_out string, error string")


_L, _R = "l" * 60, "r" * 60
_add(
    "pieces_and_limits", "doc_id, piece, html_out, error",
    [
        (0, 0, "+<p>a</p>", None), (0, 1, "<img>", None), (0, 2, "+<p>", None), (0, 3, "b", None), (1, 0, "", None), (1, 1, f"<img alt='{_L}{_R}'>", "MemoryLimitExceeded"), (1, 2, "Poisoned", "MemoryLimitExceeded"),
        (2, 0, "<!--a-->", None), (2, 1, "", "MemoryLimitExceeded"), (2, 2, "Poisoned", "MemoryLimitExceeded"), (3, 0, "<im", "MemoryLimitExceeded"), (3, 1, "Poisoned", "MemoryLimitExceeded"), (4, 0, "", None), (4, 1, "<!--a-->b ", None), (4, 2, "", None), (4, 3, "c", None),
    ],
    _piecewise,
)
