"""Documents that arrive in chunks: rewritten as they arrive, in Structured Streaming state.

Chunks of a document may come in any order and over any number of micro-batches; a repeated chunk counts once. Each
micro-batch gives out, for every document that moved on, the part of its output that is settled. State is what the rewriter
holds (open elements, edits due at their ends, one unfinished token) and chunks that came too early; it doesn't grow with
what has been given out. ``max_memory`` limits all of it for each document.

An error ends a document's rewriting with a row that names it. With ``graceful`` the bytes taken so far, and all chunks after
them, follow as they are; else its later chunks are dropped. A document that gets no chunk for ``timeout_ms`` ends with an
error TimedOut, its held bytes given out as they are. Every document ends with one row whose ``is_last`` is true.
"""

from __future__ import annotations

import io
import types
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relations import Options
from ..operators.rewriter import Rewriter, Rewriting, Rule, rewriting

OUT = "doc_id long, part long, html_out binary, is_last boolean, encoding_out string, error_kind string, error_message string"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _fill(cell: types.CellType, contents: tuple) -> None:
    if contents:
        cell.cell_contents = contents[0]


def _cell() -> types.CellType:
    return types.CellType()


class _Pickler(cloudpickle.Pickler):
    """Keeps variables that several handlers of a document share, and may set, one variable."""

    def reducer_override(self, obj):
        if type(obj) is types.CellType:
            try:
                contents = (obj.cell_contents,)
            except ValueError:
                contents = ()
            return _cell, (), contents, None, None, _fill
        return super().reducer_override(obj)

    def _function_getnewargs(self, func):
        return (*super()._function_getnewargs(func)[:4], func.__closure__)


def dumps(obj: object) -> bytes:
    with io.BytesIO() as f:
        _Pickler(f).dump(obj)
        return f.getvalue()


class Document:
    """What is kept of a document between micro-batches."""

    def __init__(self, rewriter: Rewriter):
        self.rewriter, self.early, self.next, self.last, self.part = rewriter, {}, 0, None, 0

    def take(self, options: Options) -> tuple[bytes, bool, tuple[str, str] | None]:
        """(output, whether the document has ended, error that occurred now) from the chunks that are there in order."""
        r, out, error = self.rewriter, [], None

        def step(data: bytes | None) -> None:
            nonlocal error
            if r.error:
                if r.passing and data:
                    out.append(data)
                return
            out.append(r.end() if data is None else r.write(data))
            error = r.error

        while self.next in self.early:
            step(self.early.pop(self.next))
            self.next += 1
        done = self.last is not None and self.next > self.last
        if done:
            step(None)
        elif not r.error and options.max_memory is not None and sum(map(len, self.early.values())) > options.max_memory:
            r._data, r._at, r._out = r._held, 0, []
            r._bail("MemoryLimitExceeded", f"chunks that came early need more than {options.max_memory} bytes")
            out.append(b"".join(r._out))
            error = r.error
        if r.error and not r.passing:
            self.early = dict.fromkeys(self.early, b"")  # only their numbers still matter
        return b"".join(out), done, error


def rewrite_chunks(chunks: DataFrame, how: list[Rule] | Callable[[], Rewriting], options: Options = Options(), graceful: bool | str = False, timeout_ms: int | None = None) -> DataFrame:
    """``chunks(doc_id, seq, chunk, is_last)`` of a stream to (doc_id, part, html_out, is_last, encoding_out, error_kind,
    error_message): a document's output is its rows' ``html_out`` in order of ``part``.

    A stream with ``timeout_ms`` goes on checking the clock, so leave it None with ``trigger(availableNow=True)``.
    """
    if isinstance(how, list):
        rewriting(how)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        make = (lambda: rewriting(how)) if isinstance(how, list) else how
        if state.exists:
            doc = cloudpickle.loads(state.get[0])
            if isinstance(how, list):
                doc.rewriter.attach(make())
        else:
            doc = Document(Rewriter(make(), options, graceful))
        if state.hasTimedOut:
            held = b"" if doc.rewriter.error else doc.rewriter._held
            state.remove()
            yield pd.DataFrame([(key[0], doc.part, held, True, doc.rewriter.context.codec.name, "TimedOut", "no chunk came in time")], columns=_NAMES)
            return
        for frame in frames:
            for seq, chunk, is_last in zip(frame["seq"], frame["chunk"], frame["is_last"], strict=True):
                if int(seq) >= doc.next:
                    doc.early[int(seq)] = bytes(chunk or b"")
                if is_last:
                    doc.last = int(seq)
        out, done, error = doc.take(options)
        rows = []
        if out or done or error:
            rows = [(key[0], doc.part, out, done, doc.rewriter.context.codec.name, *(error or (None, None)))]
            doc.part += 1
        if done:
            state.remove()
        else:
            if isinstance(how, list):
                doc.rewriter.detach()
            doc.rewriter._data, doc.rewriter._out = b"", []
            state.update((dumps(doc),))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        if rows:
            yield pd.DataFrame(rows, columns=_NAMES)

    return chunks.groupBy("doc_id").applyInPandasWithState(run, OUT, "state binary", "append", GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def assembled(parts: DataFrame) -> DataFrame:
    """Parts that were written out, as a table, to (doc_id, html_out, error_kind): the documents that have ended."""
    from pyspark.sql import functions as F

    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "html_out"))).alias("x"), F.max("is_last").alias("done"), F.max("error_kind").alias("error_kind"))
    joined = F.aggregate("x", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["html_out"]))
    return whole.filter("done").select("doc_id", joined.alias("html_out"), "error_kind")
