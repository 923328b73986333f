"""Documents to relations: tokens, elements, attributes, matches and status, each by one Arrow pass without a shuffle.

Selectors and the wanted token kinds are pushed into the pass, so only matching rows leave the Python workers, and what is
counted for each document is counted there. Tokens are used as they come: a document needs memory for its open elements and
for its rows. A document that fails (a parsing ambiguity in strict mode, a byte budget) keeps the tokens before the failure;
``doc_status`` has the error, and the job goes on. All of it works on streaming DataFrames too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encodings import codec_for
from .selectors import Matcher, Selector, parse
from .tokenizer import NAMESPACES, AmbiguityError, Context, MemoryLimitError, Stack, Token, placed, scan

ATTR = "struct<name:string,name_raw:string,value:string,raw:string,name_start:long,value_start:long>"
_ATTR = pa.struct([("name", pa.string()), ("name_raw", pa.string()), ("value", pa.string()), ("raw", pa.string()), ("name_start", pa.int64()), ("value_start", pa.int64())])
_DOCTYPE = pa.struct([("name", pa.string()), ("public_id", pa.string()), ("system_id", pa.string()), ("force_quirks", pa.bool_())])
#: Column, Spark type, Arrow type, value of a token.
COLUMNS = {
    "tok": ("int", pa.int32(), None),
    "kind": ("string", pa.string(), lambda t: t.kind),
    "byte_start": ("long", pa.int64(), lambda t: t.start),
    "byte_end": ("long", pa.int64(), lambda t: t.end),
    "name": ("string", pa.string(), lambda t: t.name),
    "name_raw": ("string", pa.string(), lambda t: t.name_shown),
    "ns": ("string", pa.string(), lambda t: t.ns),
    "self_closing": ("boolean", pa.bool_(), lambda t: t.self_closing),
    "can_have_content": ("boolean", pa.bool_(), lambda t: t.content),
    "attrs": (f"array<{ATTR}>", pa.list_(_ATTR), lambda t: [{"name": a.name, "name_raw": a.name_raw, "value": a.value, "raw": t.codec.decode(a.raw), "name_start": a.name_start, "value_start": a.value_start} for a in t.attrs] if t.attrs is not None else None),
    "text": ("string", pa.string(), lambda t: t.said),
    "text_type": ("string", pa.string(), lambda t: t.text_type),
    "doctype": ("struct<name:string,public_id:string,system_id:string,force_quirks:boolean>", _DOCTYPE, lambda t: dict(zip(("name", "public_id", "system_id", "force_quirks"), t.doctype, strict=True)) if t.doctype else None),
    "elem_id": ("int", pa.int32(), lambda t: t.elem_id),
    "parent_id": ("int", pa.int32(), lambda t: t.parent),
    "depth": ("int", pa.int32(), lambda t: t.depth),
    "anc": ("array<int>", pa.list_(pa.int32()), lambda t: list(t.anc)),
    "popped": ("array<int>", pa.list_(pa.int32()), lambda t: list(t.popped) if t.popped is not None else None),
    "nth_child": ("int", pa.int32(), lambda t: t.nth_child),
    "nth_of_type": ("int", pa.int32(), lambda t: t.nth_of_type),
    "close_tok": ("int", pa.int32(), None),
}
ELEMENT = ("elem_id", "tok", "name", "name_raw", "ns", "self_closing", "can_have_content", "attrs", "parent_id", "depth", "anc", "nth_child", "nth_of_type", "close_tok", "byte_start", "byte_end")


@dataclass(frozen=True)
class Options:
    """How documents are read: ``strict`` reports parsing ambiguities, ``esi`` knows ESI's void tags. ``max_bytes`` is a
    document's budget, ``max_memory`` the bytes that its open elements (and, where it comes in pieces, what is held back) may
    take; None: no limit. ``encoding`` is a label; with ``adjust_charset`` what follows the first valid ``<meta>`` that
    declares a charset is in that encoding. Strings are read as UTF-8 whatever ``encoding`` says."""

    strict: bool = True
    esi: bool = False
    max_bytes: int | None = None
    max_memory: int | None = None
    encoding: str = "utf-8"
    adjust_charset: bool = False

    def context(self, text: bool = False) -> Context:
        return Context(self.strict, codec_for("utf-8" if text else self.encoding), self.adjust_charset and not text)


class Reader:
    """Iterates over a document's tokens; ``error`` is (kind, message) if it ended early, ``context`` the state it is in."""

    def __init__(self, html: bytes | str | None, options: Options = Options(), closes: bool = False):
        self.data = html.encode("utf-8", "replace") if isinstance(html, str) else html or b""
        self.options, self.error = options, None
        self.context, self.stack = options.context(isinstance(html, str)), Stack(options.esi, closes, options.max_memory)

    def __iter__(self) -> Iterator[Token]:
        budget = self.options.max_bytes
        if budget is not None and len(self.data) > budget:
            self.error = ("MemoryLimitExceeded", f"the document has {len(self.data)} bytes; its budget is {budget}")
            return
        try:
            yield from placed(scan(self.data, self.context), self.stack)
        except AmbiguityError as e:
            self.error = ("ParsingAmbiguity", str(e))
        except MemoryLimitError as e:
            self.error = ("MemoryLimitExceeded", str(e))


def declared_charset(data: bytes) -> tuple[str, int] | None:
    """(encoding, end of the tag) of the first valid ``<meta charset>`` or ``http-equiv=content-type``."""
    reader = Reader(data, Options(strict=False, adjust_charset=True))
    for t in reader:
        if not reader.context.adjust:
            return reader.context.codec.name, t.end
    return None


#: Bytes of a table, by its plan's statistics, up to which its rows are dealt to all cores.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Deal a small table to all cores, whatever its files are; larger ones and streams stay as they are, without an exchange."""
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


def _pass(df: DataFrame, id_col: str, html: str, columns: tuple[str, ...], extra: str, rows) -> DataFrame:
    """Runs ``rows(document, closes) -> iterator of (token number, token, extra values)`` over all documents."""
    kind = df.schema[id_col].dataType.simpleString()
    extras = [x.split()[0] for x in extra.split(", ")] if extra else []
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    extra_types = [kinds[x.split()[1]] for x in extra.split(", ")] if extra else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, values = [], []
            cells: list[list] = [[] for _ in columns]
            late = {columns.index("close_tok")} if "close_tok" in columns else set()  # known when the element's end has come
            takes = [(cell, COLUMNS[c][2]) for cell, c in zip(cells, columns, strict=True) if COLUMNS[c][2]]
            number = cells[columns.index("tok")] if "tok" in columns else None
            ends = cells[columns.index("close_tok")] if late else None
            for k, doc in enumerate(batch.column(1).to_pylist()):
                for i, t, more in rows(doc, bool(late)):
                    which.append(k), values.append(more)
                    for cell, take in takes:
                        cell.append(take(t))
                    if number is not None:
                        number.append(i)
                    if ends is not None:
                        ends.append(t)
                if ends is not None:
                    ends[:] = [t.close_tok if isinstance(t, Token) else t for t in ends]
            cols = [pa.array(cell, COLUMNS[c][1]) for cell, c in zip(cells, columns, strict=True)]
            more = [pa.array([v[j] for v in values], x) for j, x in enumerate(extra_types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *more, *cols], ["id", *extras, *columns])

    schema = ", ".join([f"id {kind}", *([extra] if extra else []), *(f"{c} {COLUMNS[c][0]}" for c in columns)])
    return spread(df.select(F.col(id_col).alias("id"), F.col(html).alias("html"))).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def tokens(df: DataFrame, id_col: str = "doc_id", html: str = "html", options: Options = Options(), kinds: tuple[str, ...] | None = None, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """The tokens of each document, of the given kinds and with the given columns; ``tok`` is their order."""

    def rows(doc, closes):
        for i, t in enumerate(Reader(doc, options, closes)):
            if kinds is None or t.kind in kinds:
                yield i, t, ()

    return _pass(df, id_col, html, columns, "", rows)


def elements(df: DataFrame, id_col: str = "doc_id", html: str = "html", options: Options = Options(), columns: tuple[str, ...] = ELEMENT) -> DataFrame:
    """A row per start tag, with its place in the stack of open elements."""
    return tokens(df, id_col, html, options, ("start_tag",), columns)


def attributes(df: DataFrame, id_col: str = "doc_id", html: str = "html", options: Options = Options()) -> DataFrame:
    """A row per attribute, duplicates included, in order (``pos``)."""
    e = elements(df, id_col, html, options, ("elem_id", "attrs"))
    return e.select(id_col, "elem_id", F.posexplode("attrs").alias("pos", "a")).select(id_col, "elem_id", "pos", "a.*")


def namespace_uri(ns: str = "ns"):
    """Column: the URI of a namespace."""
    c = F.col(ns)
    return F.when(c == "html", NAMESPACES["html"]).when(c == "svg", NAMESPACES["svg"]).when(c == "mathml", NAMESPACES["mathml"])


def doc_status(df: DataFrame, id_col: str = "doc_id", html: str = "html", options: Options = Options()) -> DataFrame:
    """id, n_bytes, n_tokens, encoding_out (that of the document's end), error (kind, message; null if it was read to its end)."""
    kind = df.schema[id_col].dataType.simpleString()
    error = pa.struct([("kind", pa.string()), ("message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts, names, errors = [], [], [], []
            for doc in batch.column(1).to_pylist():
                reader = Reader(doc, options)
                counts.append(sum(1 for _ in reader))
                sizes.append(len(reader.data)), names.append(reader.context.codec.name)
                errors.append(dict(zip(("kind", "message"), reader.error, strict=True)) if reader.error else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(errors, error)], ["id", "n_bytes", "n_tokens", "encoding_out", "error"])

    docs = spread(df.select(F.col(id_col).alias("id"), F.col(html).alias("html")))
    return docs.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, encoding_out string, error struct<kind:string,message:string>").withColumnRenamed("id", id_col)


def _parsed(selectors: str | list[str]) -> list[Selector]:
    return [parse(s) for s in ([selectors] if isinstance(selectors, str) else selectors)]


def select(df: DataFrame, selectors: str | list[str], id_col: str = "doc_id", html: str = "html", options: Options = Options(), columns: tuple[str, ...] = ELEMENT) -> DataFrame:
    """A row per (element, selector that matches it); ``match_id`` is the selector's number.

    Raises SelectorError while the plan is built.
    """
    chosen = _parsed(selectors)

    def rows(doc, closes):
        m = Matcher(chosen)
        for i, t in enumerate(Reader(doc, options, closes)):
            if t.kind == "start_tag":
                for k in m.start_tag(t):
                    yield i, t, (k,)
            elif t.kind == "end_tag":
                m.end_tag(t)

    return _pass(df, id_col, html, columns, "match_id int", rows)


def select_content(df: DataFrame, selectors: str | list[str], kind: str = "text", id_col: str = "doc_id", html: str = "html", options: Options = Options(), columns: tuple[str, ...] = ("tok", "text", "text_type", "parent_id", "anc", "byte_start", "byte_end")) -> DataFrame:
    """The texts (or comments) anywhere inside a match, once for each selector however many of its matches nest."""
    chosen = _parsed(selectors)

    def rows(doc, closes):
        m, active = Matcher(chosen), Active(len(chosen))
        for i, t in enumerate(Reader(doc, options, closes)):
            if t.kind == "start_tag":
                found = m.start_tag(t)
                if t.content and found:
                    active.open(t.elem_id, found)
            elif t.kind == "end_tag":
                m.end_tag(t)
                active.close(t.popped)
            elif t.kind == kind and active.elements:
                for k in active.numbers():
                    yield i, t, (k,)

    return _pass(df, id_col, html, columns, "match_id int", rows)


class Active:
    """Which selectors have a match among the open elements."""

    def __init__(self, n: int):
        self.elements: dict[int, list[int]] = {}
        self.counts = [0] * n

    def open(self, element: int, found: list[int]) -> None:
        self.elements[element] = found
        for k in found:
            self.counts[k] += 1

    def close(self, popped: tuple[int, ...]) -> None:
        if self.elements:
            for e in popped:
                for k in self.elements.pop(e, ()):
                    self.counts[k] -= 1

    def numbers(self) -> list[int]:
        return [k for k, n in enumerate(self.counts) if n]


def count_matches(df: DataFrame, selectors: str | list[str], id_col: str = "doc_id", html: str = "html", options: Options = Options()) -> DataFrame:
    """id, match_id, n: how often each selector matches in each row's document, where it does. Counted inside the pass."""
    chosen = _parsed(selectors)

    def rows(doc, closes):
        m, counts = Matcher(chosen), [0] * len(chosen)
        for t in Reader(doc, options):
            if t.kind == "start_tag":
                for k in m.start_tag(t):
                    counts[k] += 1
            elif t.kind == "end_tag":
                m.end_tag(t)
        return ((0, None, (k, n)) for k, n in enumerate(counts) if n)

    return _pass(df, id_col, html, (), "match_id int, n long", rows)


def text_sizes(df: DataFrame, id_col: str = "doc_id", html: str = "html", options: Options = Options()) -> DataFrame:
    """id, text_type, chars: the characters of each row's texts by type. Counted inside the pass."""

    def rows(doc, closes):
        counts: dict[str, int] = {}
        for t in Reader(doc, options):
            if t.kind == "text":
                counts[t.text_type] = counts.get(t.text_type, 0) + len(t.said)
        return ((0, None, x) for x in counts.items())

    return _pass(df, id_col, html, (), "text_type string, chars long", rows)
