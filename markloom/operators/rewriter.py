"""Rewriting documents: handlers on elements, comments, texts, doctypes, end tags and the document's end.

Untouched tokens are passed through byte for byte; touched ones are written again. Edits fill the slots of a token:
content before it, its replacement, content after it, whether it is removed. An element's edits at its end wait for the
end tag that pops it, and are lost if none comes. Rules are handlers made from data. All of it runs inside one Arrow
pass over the documents, without a shuffle; a document that fails is reported in its row.

A document may come in pieces: :class:`Rewriter` gives out what each piece settles, and holds the open elements, the edits
due at their ends, and an unfinished token. What is inserted is written in the document's encoding.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.encodings import Codec, encoding_for
from .relations import Active, Options, spread
from .selectors import Matcher, parse
from .tokenizer import _LOWER, NAMESPACES, STACK_ITEM, AmbiguityError, Attribute, MemoryLimitError, Stack, Token, placed, scan


class RewriteError(ValueError):
    """``kind``: ContentHandlerError, ParsingAmbiguity, MemoryLimitExceeded, Stopped, Poisoned, or that of a rejected name or text."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class Stop(Exception):
    """Raised (or returned, as the class) by a handler that wants the rewriting to end at once."""


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def escape_attribute(s: str) -> str:
    return s.replace('"', "&quot;")


Content = "str | Callable[[Sink], None]"


class Sink:
    """Where a content producer writes; chunks of UTF-8 may split characters."""

    def __init__(self):
        self.parts: list[str] = []
        self.rest = b""

    def write_str(self, s: str, html: bool = False) -> None:
        if self.rest:
            raise RewriteError("InvalidUtf8", "a chunk of UTF-8 ends inside a character")
        self.parts.append(s if html else escape_text(s))

    def write_utf8_chunk(self, chunk: bytes, html: bool = False) -> None:
        data, self.rest = self.rest + chunk, b""
        try:
            s = data.decode()
        except UnicodeDecodeError as e:
            if e.reason != "unexpected end of data":
                raise RewriteError("InvalidUtf8", str(e)) from None
            s, self.rest = data[: e.start].decode(), data[e.start :]
        self.parts.append(s if html else escape_text(s))


def _content(content, html: bool):
    """Text as it will be written; what a producer writes is asked for when its place in the output has come."""
    return (escape_text(content) if not html else content) if isinstance(content, str) else content


def _written(parts: list) -> str:
    out = []
    for part in parts:
        if not isinstance(part, str):
            sink = Sink()
            part(sink)
            if sink.rest:
                raise RewriteError("InvalidUtf8", "a chunk of UTF-8 ends inside a character")
            part = "".join(sink.parts)
        out.append(part)
    return "".join(out)


class Slots:
    __slots__ = ("before", "after", "replacement", "removed")

    def __init__(self):
        self.before: list = []
        self.after: list = []
        self.replacement: list = []
        self.removed = False

    def replace(self, s) -> None:
        self.replacement, self.removed = [s], True

    def wrap(self, own: bytes, codec: Codec) -> bytes:
        if not (self.before or self.after or self.removed):
            return own
        before = codec.encode(_written(self.before))
        mid = codec.encode(_written(self.replacement)) if self.removed else own
        return before + mid + codec.encode(_written(self.after))


class Unit:
    """What all handler arguments share. ``user_data`` passes between the handlers of a token."""

    def __init__(self, token: Token):
        self._token, self._slots, self.user_data = token, Slots(), None

    @property
    def source_location(self) -> tuple[int, int]:
        return self._token.start, self._token.end

    @property
    def removed(self) -> bool:
        return self._slots.removed

    def before(self, content: Content, html: bool = False) -> None:
        self._slots.before.append(_content(content, html))

    def after(self, content: Content, html: bool = False) -> None:
        self._slots.after.insert(0, _content(content, html))

    def replace(self, content: Content, html: bool = False) -> None:
        self._slots.replace(_content(content, html))

    def remove(self) -> None:
        self._slots.removed = True


def _encodable(s: str, codec: Codec) -> None:
    """Names and comments can't hold references, so what the encoding lacks can't be in them."""
    if not codec.has(s):
        raise RewriteError("UnencodableCharacter", f"{s!r} has a character that {codec.name} lacks")


class Comment(Unit):
    def __init__(self, token: Token):
        super().__init__(token)
        self._text = None

    @property
    def text(self) -> str:
        return self._token.said if self._text is None else self._text

    @text.setter
    def text(self, s: str) -> None:
        if "-->" in s or "--!>" in s or s.startswith((">", "->")):
            raise RewriteError("CommentClosingSequence", "the text would end the comment")
        _encodable(s, self._token.codec)
        self._text = s

    def _own(self, raw: bytes) -> bytes:
        return raw if self._text is None else b"<!--" + self._token.codec.encode(self._text) + b"-->"


class Text(Unit):
    """A chunk of a text node; the node's last chunk is empty."""

    def __init__(self, token: Token, text: str, last: bool):
        super().__init__(token)
        self._text, self.last_in_text_node = text, last
        self.text_type = token.text_type

    @property
    def text(self) -> str:
        return self._text

    @text.setter
    def text(self, s: str) -> None:
        self._text = s

    def _own(self, raw: bytes) -> bytes:
        """A text that a handler has seen is written again: what is malformed in it was seen, and is written, as U+FFFD."""
        return self._token.codec.encode(self._text)


class Doctype(Unit):
    def __init__(self, token: Token):
        super().__init__(token)
        self.name, self.public_id, self.system_id, self.force_quirks = token.doctype

    def _own(self, raw: bytes) -> bytes:
        return raw


class EndTag(Unit):
    def __init__(self, token: Token):
        super().__init__(token)
        self._name = None

    @property
    def name(self) -> str:
        return self.name_preserve_case.translate(_LOWER)

    @name.setter
    def name(self, s: str) -> None:
        _encodable(s, self._token.codec)
        self._name = s

    @property
    def name_preserve_case(self) -> str:
        return self._token.name_shown if self._name is None else self._name

    def _own(self, raw: bytes) -> bytes:
        return raw if self._name is None else b"</" + self._token.codec.encode(self._name) + b">"


class StartTag(Unit):
    """A start tag, apart from its element: edits here leave content and end tag alone."""

    def __init__(self, token: Token):
        super().__init__(token)
        self._name, self._attrs, self._edited, self._closing = None, None, False, token.self_closing

    @property
    def attributes(self) -> list[Attribute]:
        return list(self._token.attrs if self._attrs is None else self._attrs)

    @property
    def name(self) -> str:
        return self.name_preserve_case.translate(_LOWER)

    @name.setter
    def name(self, s: str) -> None:
        _encodable(s, self._token.codec)
        self._name, self._edited = s, True

    @property
    def name_preserve_case(self) -> str:
        return self._token.name_shown if self._name is None else self._name

    def set_attribute(self, name: str, value: str) -> None:
        if not name:
            raise RewriteError("EmptyAttributeName", "an attribute needs a name")
        if bad := re.search(r"[ \n\r\t\f/>=]", name):
            raise RewriteError("ForbiddenCharacterInAttributeName", f"{bad[0]!r} can't be part of an attribute's name")
        _encodable(name, self._token.codec)
        attrs, key = self.attributes, name.translate(_LOWER)
        for k, a in enumerate(attrs):
            if a.name == key:
                attrs[k] = Attribute(a.name, a.name_raw, value, None, a.name_start, a.value_start)
                break
        else:
            attrs.append(Attribute(key, key, value, None, -1, -1))
        self._attrs, self._edited = attrs, True

    def remove_attribute(self, name: str) -> None:
        key = name.translate(_LOWER)
        kept = [a for a in self.attributes if a.name != key]
        if len(kept) < len(self.attributes):
            self._attrs, self._edited = kept, True

    def _own(self, raw: bytes) -> bytes:
        if not self._edited:
            return raw
        encode = self._token.codec.encode
        out = [b"<", self._token.name_raw if self._name is None else encode(self._name)]
        for a in self.attributes:
            out += [b" ", a.raw if a.raw is not None else encode(f'{a.name_raw}="{escape_attribute(a.value)}"')]
        out.append((b" />" if self.attributes else b"/>") if self._closing else b">")
        return b"".join(out)


class Element:
    """A matched element: its start tag, and what waits for its end."""

    def __init__(self, token: Token):
        self._token, self.start_tag, self.user_data = token, StartTag(token), None
        self._end, self._end_name, self._end_edited, self._drop_content = Slots(), None, False, False
        self._handlers: list[Callable[[EndTag], None]] = []
        self.can_have_content = bool(token.content)
        self.is_self_closing = bool(token.self_closing)
        self.namespace_uri = NAMESPACES[token.ns]
        self.source_location = (token.start, token.end)

    @property
    def name(self) -> str:
        return self.start_tag.name

    @name.setter
    def name(self, s: str) -> None:
        if not s:
            raise RewriteError("EmptyTagName", "a tag needs a name")
        if not re.match(r"[A-Za-z]", s):
            raise RewriteError("InvalidFirstCharacter", f"a tag's name can't start with {s[0]!r}")
        if bad := re.search(r"[ \n\r\t\f/>]", s):
            raise RewriteError("ForbiddenCharacterInTagName", f"{bad[0]!r} can't be part of a tag's name")
        self.start_tag.name = s
        if self.can_have_content:
            self._end_name, self._end_edited = s, True

    @property
    def name_preserve_case(self) -> str:
        return self.start_tag.name_preserve_case

    @property
    def attributes(self) -> list[Attribute]:
        return self.start_tag.attributes

    @property
    def removed(self) -> bool:
        return self.start_tag.removed

    def get_attribute(self, name: str) -> str | None:
        key = name.translate(_LOWER)
        return next((a.value for a in self.attributes if a.name == key), None)

    def has_attribute(self, name: str) -> bool:
        return self.get_attribute(name) is not None

    def set_attribute(self, name: str, value: str) -> None:
        self.start_tag.set_attribute(name, value)

    def remove_attribute(self, name: str) -> None:
        self.start_tag.remove_attribute(name)

    def before(self, content: Content, html: bool = False) -> None:
        self.start_tag.before(content, html)

    def after(self, content: Content, html: bool = False) -> None:
        if self.can_have_content:
            self._end.after.insert(0, _content(content, html))
            self._end_edited = True
        else:
            self.start_tag.after(content, html)

    def _opened(self) -> bool:
        if self.can_have_content:
            self.start_tag._closing = False
        return self.can_have_content

    def prepend(self, content: Content, html: bool = False) -> None:
        if self._opened():
            self.start_tag.after(content, html)

    def append(self, content: Content, html: bool = False) -> None:
        if self._opened():
            self._end.before.append(_content(content, html))
            self._end_edited = True

    def _clear(self) -> None:
        self.start_tag._slots.after.clear()
        self._end.before.clear()
        self._drop_content = True

    def set_inner_content(self, content: Content, html: bool = False) -> None:
        if self._opened():
            self._clear()
            self.start_tag.after(content, html)

    def replace(self, content: Content, html: bool = False) -> None:
        self.start_tag.replace(content, html)
        self._remove_rest()

    def remove(self) -> None:
        self.start_tag.remove()
        self._remove_rest()

    def _remove_rest(self) -> None:
        if self.can_have_content:
            self._clear()
            self._end.removed = self._end_edited = True

    def remove_and_keep_content(self) -> None:
        self.start_tag.remove()
        if self.can_have_content:
            self._end.removed = self._end_edited = True

    def on_end_tag(self, handler: Callable[[EndTag], None]) -> None:
        if not self.can_have_content:
            raise RewriteError("NoEndTag", f"<{self.name}> can't have an end tag")
        self._handlers.append(handler)

    @property
    def end_tag_handlers(self) -> list | None:
        return self._handlers if self.can_have_content else None

    def _at_end(self, tag: EndTag) -> None:
        if self._end_edited:
            tag._slots = self._end
            if self._end_name is not None:
                tag.name = self._end_name
        for h in self._handlers:
            _run(h, tag)


def _run(handler: Callable, unit) -> None:
    if handler(unit) is Stop:
        raise Stop


class DocumentEnd:
    def __init__(self):
        self._parts: list = []

    def append(self, content: Content, html: bool = False) -> None:
        self._parts.append(_content(content, html))


@dataclass
class Rewriting:
    """Handlers in order of registration; those on selectors run before those on the document."""

    def __post_init__(self):
        self.selected: list[tuple] = []
        self.document: list[dict] = []

    def on(self, selector: str, element=None, comments=None, text=None) -> Rewriting:
        """Handlers for matches of a selector, and for comments and texts anywhere inside them."""
        self.selected.append((parse(selector), element, comments, text))
        return self

    def on_document(self, doctype=None, comments=None, text=None, end=None, bail_out=None) -> Rewriting:
        self.document.append({"doctype": doctype, "comments": comments, "text": text, "end": end, "bail_out": bail_out})
        return self


@dataclass(frozen=True)
class Rule:
    """An edit as data. ``action``: before, after, prepend, append, set_inner_content, replace, remove,
    remove_and_keep_content, set_attribute, remove_attribute, set_tag_name; on texts or comments inside (``target``):
    before, after, replace, remove, set_text. ``name`` is an attribute's; ``replace_prefix`` swaps a value's start."""

    selector: str
    action: str
    content: str = ""
    html: bool = False
    name: str = ""
    target: str = "element"
    replace_prefix: str | None = None


ELEMENT_ACTIONS = ("before", "after", "prepend", "append", "set_inner_content", "replace", "remove", "remove_and_keep_content", "set_attribute", "remove_attribute", "set_tag_name")
CONTENT_ACTIONS = ("before", "after", "replace", "remove", "set_text")


def rewriting(rules: list[Rule]) -> Rewriting:
    """Rules to handlers; raises ValueError or SelectorError for what can't be."""
    out = Rewriting()
    for rule in rules:
        if rule.action not in (ELEMENT_ACTIONS if rule.target == "element" else CONTENT_ACTIONS) or rule.target not in ("element", "comments", "text"):
            raise ValueError(f"no action {rule.action!r} on {rule.target!r}")
        out.on(rule.selector, **{rule.target: _handler(rule)})
    return out


def _handler(r: Rule) -> Callable:
    def run(unit) -> None:
        if r.target == "text" and not unit.text and r.action != "remove":
            return
        if r.action in ("remove", "remove_and_keep_content"):
            getattr(unit, r.action)()
        elif r.action == "set_text":
            unit.text = r.content
        elif r.action == "set_tag_name":
            unit.name = r.content
        elif r.action == "remove_attribute":
            unit.remove_attribute(r.name)
        elif r.action == "set_attribute":
            if r.replace_prefix is None:
                unit.set_attribute(r.name, r.content)
            elif (have := unit.get_attribute(r.name)) is not None and have.startswith(r.replace_prefix):
                unit.set_attribute(r.name, r.content + have[len(r.replace_prefix) :])
        else:
            getattr(unit, r.action)(r.content, html=r.html)

    return run


class Rewriter:
    """Rewrites one document that comes in pieces.

    ``write`` and ``end`` return what can be given out. After an error, ``error`` is (kind, message), and what they returned
    ends where it occurred; with ``graceful`` (True, or "memory" or "handlers" for errors of that kind only), all bytes taken
    so far follow as they are, after what the bail-out handlers append, and ``passing`` says that the caller may go on with
    the bytes that come. A rewriter with an error takes no more bytes. ``encodings`` lists (bytes given out before, encoding).
    """

    def __init__(self, how: Rewriting, options: Options = Options(), graceful: bool | str = False, text: bool = False):
        self.how, self.options, self.graceful = how, options, graceful
        self.context = options.context(text)
        self.matcher = Matcher([s for s, *_ in how.selected])
        self.stack = Stack(options.esi, False, options.max_memory if how.selected else None)
        self.active = Active(len(how.selected))
        self.edited: dict[int, Element] = {}  # open elements with something due at their end
        self.hidden: set[int] = set()
        self.error: tuple[str, str] | None = None
        self.passing = self.ended = False
        self.encodings = [(0, self.context.codec.name)]
        self._held, self._base, self._given, self._open_text = b"", 0, 0, None
        self._out: list[bytes] = []

    # -- state between pieces: handlers made from rules are made again
    def detach(self) -> None:
        self.how = None

    def attach(self, how: Rewriting) -> None:
        self.how = how

    def write(self, piece: bytes) -> bytes:
        return self._take(self._held + piece, False)

    def end(self) -> bytes:
        return self._take(self._held, True)

    def _open_bytes(self) -> int:
        return len(self.stack.ids) * STACK_ITEM if self.how.selected else 0

    def _emit(self, data: bytes) -> None:
        if data and not self.hidden:
            self._out.append(data)
            self._given += len(data)

    def _handlers(self, k: int, name: str) -> list[Callable]:
        """Those on selectors, then those on the document."""
        inside = [self.how.selected[n][k] for n in self.active.numbers() if self.how.selected[n][k]] if self.active.elements else []
        return inside + [d[name] for d in self.how.document if d[name]]

    def _take(self, data: bytes, final: bool) -> bytes:
        if self.error or self.ended:
            raise RewriteError("Poisoned", "a rewriter takes nothing after its end or an error")
        self._out, self._at, self._data = [], 0, data
        limits = self.options
        try:
            if limits.max_memory is not None and self._held and len(data) + self._open_bytes() > limits.max_memory and not final:
                raise MemoryLimitError(f"what is held of the document needs more than {limits.max_memory} bytes")
            if limits.max_bytes is not None and self._base + len(data) > limits.max_bytes:
                raise MemoryLimitError(f"the document has more than {limits.max_bytes} bytes")
            for t in placed(scan(data, self.context, final), self.stack):
                end = t.end
                self._step(t)
                self._at = end
            self._held = data[self.context.held :] if not final else b""
            self._base += len(data) - len(self._held)
            if limits.max_memory is not None and self._held and len(self._held) + self._open_bytes() > limits.max_memory:
                self._at = len(data) - len(self._held)
                raise MemoryLimitError(f"what is held of the document needs more than {limits.max_memory} bytes")
            if final:
                self._finish()
        except AmbiguityError as e:
            self.error = ("ParsingAmbiguity", str(e))
        except Stop:
            self.error = ("Stopped", "a handler ended the rewriting")
        except MemoryLimitError as e:
            self._bail("MemoryLimitExceeded", str(e))
        except Exception as e:  # of a handler
            self._bail("ContentHandlerError", f"{type(e).__name__}: {e}")
        return b"".join(self._out)

    def _bail(self, kind: str, message: str) -> None:
        self.error = (kind, message)
        if self.graceful is True or self.graceful == ("memory" if kind == "MemoryLimitExceeded" else "handlers"):
            self.passing = True
            end = DocumentEnd()
            for h in [d["bail_out"] for d in self.how.document if d["bail_out"]]:
                h(end)
            self.hidden.clear()
            self._emit(self.context.codec.encode(_written(end._parts)))
            self._emit(self._data[self._at :])
            self._held = b""

    def _finish(self) -> None:
        self._at = len(self._data)
        self._last_text()
        end = DocumentEnd()
        for h in [d["end"] for d in self.how.document if d["end"]]:
            _run(h, end)
        self.hidden.clear()
        self._emit(self.context.codec.encode(_written(end._parts)))
        self.ended = True

    def _last_text(self) -> None:
        t, self._open_text = self._open_text, None
        if t is not None and (handlers := self._handlers(3, "text")):
            last = Text(t, "", True)
            for h in handlers:
                _run(h, last)
            self._emit(last._slots.wrap(last._own(b""), t.codec))

    def _step(self, t: Token) -> None:
        raw = self._data[t.start : t.end]
        if self._base:
            t.start, t.end, t.base = t.start + self._base, t.end + self._base, self._base
        if t.kind != "text" and self._open_text is not None:
            self._last_text()
        if t.kind == "start_tag":
            self._start(t, raw)
            if self.context.codec.name != self.encodings[-1][1]:
                self.encodings.append((self._given, self.context.codec.name))
        elif t.kind == "end_tag":
            self._end(t, raw)
        elif t.kind == "text":
            if handlers := self._handlers(3, "text"):
                chunk = Text(t, t.said, False)
                for h in handlers:
                    _run(h, chunk)
                self._emit(chunk._slots.wrap(chunk._own(raw), t.codec))
            else:
                self._emit(raw)
            self._at = t.end - self._base
            self._open_text = t
            if not t.partial:
                self._last_text()
        elif t.kind in ("comment", "doctype"):
            handlers = self._handlers(2, "comments") if t.kind == "comment" else [d["doctype"] for d in self.how.document if d["doctype"]]
            if handlers:
                unit = Comment(t) if t.kind == "comment" else Doctype(t)
                for h in handlers:
                    _run(h, unit)
                self._emit(unit._slots.wrap(unit._own(raw), t.codec))
            else:
                self._emit(raw)
        else:
            self._emit(raw)

    def _start(self, t: Token, raw: bytes) -> None:
        found = self.matcher.start_tag(t)
        element = None
        for n in found:
            if handler := self.how.selected[n][1]:
                element = element or Element(t)
                _run(handler, element)
        if element:
            self._emit(element.start_tag._slots.wrap(element.start_tag._own(raw), t.codec))
            if t.content:
                if element._drop_content:
                    self.hidden.add(t.elem_id)
                if element._end_edited or element._handlers:
                    self.edited[t.elem_id] = element
                    t.attrs  # taken apart now: an open element shouldn't keep the bytes around its tag
        else:
            self._emit(raw)
        if t.content and found:
            self.active.open(t.elem_id, found)

    def _end(self, t: Token, raw: bytes) -> None:
        self.matcher.end_tag(t)
        due = []
        for e in t.popped if self.edited or self.hidden else ():
            self.hidden.discard(e)
            if e in self.edited:
                due.append(self.edited.pop(e))
        self.active.close(t.popped)
        if due:
            tag = EndTag(t)
            for element in reversed(due):
                element._at_end(tag)
            self._emit(tag._slots.wrap(tag._own(raw), t.codec))
        else:
            self._emit(raw)


def rewrite_document(html: bytes, how: Rewriting, options: Options = Options(), graceful: bool | str = False) -> tuple[bytes, tuple[str, str] | None]:
    """(output, error) of a whole document, as by :class:`Rewriter`."""
    out, _, error = rewrite_bytes(html, how, options, graceful)
    return out, error


def rewrite_bytes(html: bytes, how: Rewriting, options: Options = Options(), graceful: bool | str = False, text: bool = False) -> tuple[bytes, str, tuple[str, str] | None]:
    """(output, encoding at its end, error) of a whole document."""
    r = Rewriter(how, options, graceful, text)
    out = r._take(html, True)
    return out, r.context.codec.name, r.error


def rewrite_str(html: str, how: Rewriting, esi: bool = True, strict: bool = True) -> str:
    """One document; raises RewriteError."""
    out, error = rewrite_document(html.encode("utf-8", "replace"), how, Options(strict, esi))
    if error:
        raise RewriteError(*error)
    return out.decode("utf-8", "replace")


def rewrite(
    df: DataFrame, how: list[Rule] | Callable[[], Rewriting], id_col: str = "doc_id", html: str = "html", options: Options = Options(esi=True), graceful: bool | str = False, encoding_col: str | None = None
) -> DataFrame:
    """id, ``html_out``, ``encoding_out`` (at the output's end), ``error`` (kind, message) of each row.

    ``how``: rules, or a factory that is called for each document, so that handlers may keep state across one. ``html_out``
    has the type of ``html``: binary documents are read in the options' encoding, or that which ``encoding_col`` names in
    their row (null: the options'; unknown: an error UnknownEncoding), and keep every byte that nothing touches. Null html
    gives null. After an error ``html_out`` is null, unless ``graceful`` made it whole.
    """
    if isinstance(how, list):
        rewriting(how)  # errors show while the plan is built
    kind = df.schema[id_col].dataType.simpleString()
    is_text = df.schema[html].dataType.simpleString() != "binary"
    made = pa.string() if is_text else pa.binary()
    error_type = pa.struct([("kind", pa.string()), ("message", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = rewriting(how) if isinstance(how, list) else None
        for batch in batches:
            outs, names, errors = [], [], []
            for doc, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                out = name = bad = None
                if doc is not None:
                    own = options if label is None or is_text else replace(options, encoding=label)
                    if encoding_for(own.encoding) is None:
                        bad = ("UnknownEncoding", f"{own.encoding!r} is unknown or isn't a superset of ASCII")
                    else:
                        data = doc.encode("utf-8", "replace") if is_text else doc
                        r = Rewriter(shared or how(), own, graceful, is_text)
                        out, name, bad = r._take(data, True), r.context.codec.name, r.error
                        if bad and not r.passing:
                            out = None
                outs.append(out.decode("utf-8", "replace") if is_text and out is not None else out)
                names.append(name), errors.append({"kind": bad[0], "message": bad[1]} if bad else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(outs, made), pa.array(names, pa.string()), pa.array(errors, error_type)], ["id", "html_out", "encoding_out", "error"])

    label = F.col(encoding_col) if encoding_col else F.lit(None).cast("string")
    docs = df.select(F.col(id_col).alias("id"), F.col(html).alias("html"), label.alias("label"))
    return spread(docs).mapInArrow(run, f"id {kind}, html_out {'string' if is_text else 'binary'}, encoding_out string, error struct<kind:string,message:string>").withColumnRenamed("id", id_col)
