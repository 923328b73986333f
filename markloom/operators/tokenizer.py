"""HTML tokenizer without a tree: bytes to tokens that cover the document, with the stack of open elements.

It scans with compiled patterns and ``bytes.find``; context (text modes, namespaces, ambiguities) comes from tag names,
as a tree builder's feedback would. Every byte belongs to exactly one token; ``raw`` tokens are markup that stands for
nothing. Character references stay as they are, duplicate attributes are kept, end tags are never implied.

A document may come in pieces: ``scan`` with ``final=False`` stops before what the next bytes could change and leaves its
place in the context. Memory is linear in a document's depth: a token knows its depth and parent, and the whole path to it
only while it is the current one.

Tags are scanned, not lexed: one pattern finds a tag's end, and its attributes are taken apart when they are first asked for.
So what looks at names only never pays for attributes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from ..functions.encodings import UTF8, Codec, declared_in

WS = rb" \n\r\t\x0c"
_NAME = re.compile(rb"[^ \n\r\t\x0c/>]+")
_GAP = re.compile(rb"[ \n\r\t\x0c/]*")
_ATTR = re.compile(rb"=?[^ \n\r\t\x0c/>=]*")
_EQUALS = re.compile(rb"[ \n\r\t\x0c]*=[ \n\r\t\x0c]*")
_BARE = re.compile(rb"[^ \n\r\t\x0c>]*")
_BLANKS = re.compile(rb"[ \n\r\t\x0c]*")
#: From a tag's name to its end: attributes, the group that is set if the last one's value is missing, and what is before >.
_REST = re.compile(
    rb"(?:[ \n\r\t\x0c/]*+(?!>)=?+[^ \n\r\t\x0c/>=]*+"
    rb"(?:[ \n\r\t\x0c]*+=[ \n\r\t\x0c]*+(?:\"[^\"]*+\"|'[^']*+'|(?=>)()|[^ \n\r\t\x0c>\"'][^ \n\r\t\x0c>]*+)|(?![ \n\r\t\x0c]*+=)))*+"
    rb"([ \n\r\t\x0c/]*+)>"
)
_COMMENT_END = re.compile(rb"--!?>")
_COMMENT_CUT = re.compile(rb"(?:--!?|-)\Z")
_SCRIPT = re.compile(rb"<(?:/script(?=[ \n\r\t\x0c/>])|!--)", re.I)
_ESCAPED = re.compile(rb"--+>|<(/?)script(?=[ \n\r\t\x0c/>])", re.I)
_ALPHA = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

#: Element and attribute names of the HTML standard (fixed values).
RCDATA = frozenset(("textarea", "title"))
RAWTEXT = frozenset(("style", "iframe", "xmp", "noembed", "noframes", "noscript"))
VOID = frozenset("area base basefont bgsound br col embed hr img input keygen link meta param source track wbr".split())
ESI_VOID = frozenset(("esi:include", "esi:comment"))
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p"
    " pre ruby s small span strong strike sub sup table tt u ul var".split()
)
MATHML_POINTS = frozenset("mi mo mn ms mtext".split())
SVG_POINTS = frozenset("desc title foreignobject".split())
NAMESPACES = {"html": "http://www.w3.org/1999/xhtml", "svg": "http://www.w3.org/2000/svg", "mathml": "http://www.w3.org/1998/Math/MathML"}


_LOWER = {c: c + 32 for c in range(65, 91)}
_names: dict[bytes, str] = {}


def lower(name: bytes, codec: Codec = UTF8) -> str:
    """A name in lower case, A-Z only, decoded."""
    found = _names.get(name)
    if found is None:
        if not name.isascii():
            return codec.decode(name).translate(_LOWER)
        if len(_names) > 4096:
            _names.clear()
        found = _names[name] = name.lower().decode()
    return found


class AmbiguityError(ValueError):
    """A tag after which a tree builder could read the text in another mode."""


class MemoryLimitError(ValueError):
    """The open elements, or what is held back of a document in pieces, go beyond the document's limit."""


@dataclass(slots=True)
class Attribute:
    name: str
    name_raw: str
    value: str
    raw: bytes
    name_start: int
    value_start: int


@dataclass(slots=True)
class Token:
    kind: str  # start_tag, end_tag, text, comment, doctype, raw
    start: int
    end: int
    name: str | None = None
    name_raw: bytes | None = None
    ns: str | None = None
    self_closing: bool | None = None
    lexed: list[Attribute] | None = None  # of a start tag, once asked for; before, the bytes they are in
    source: bytes | None = field(default=None, repr=False)
    base: int = 0  # what was given out of the document before ``source``
    text: bytes | None = None
    text_type: str | None = None
    doctype: tuple[str | None, str | None, str | None, bool] | None = None
    codec: Codec = UTF8
    partial: bool = False  # a text that goes on
    # of the stack of open elements
    elem_id: int | None = None
    parent: int | None = None
    depth: int = 0
    open: list[int] | None = field(default=None, repr=False)  # the live stack's ids
    popped: tuple[int, ...] | None = None
    nth_child: int | None = None
    nth_of_type: int | None = None
    content: bool | None = None
    close_tok: int | None = None

    @property
    def attrs(self) -> list[Attribute] | None:
        """A start tag's attributes."""
        if self.lexed is None and self.source is not None:
            at = self.start - self.base
            self.lexed = _attributes(self.source, at + 1 + len(self.name_raw), self.codec, self.base)
            self.source = None
        return self.lexed

    @property
    def anc(self) -> tuple[int, ...]:
        """Ids of the elements around this token; true until the next token is asked for."""
        return tuple(self.open[: self.depth]) if self.open else ()

    @property
    def said(self) -> str | None:
        """The text, decoded."""
        return None if self.text is None else self.codec.decode(self.text)

    @property
    def name_shown(self) -> str | None:
        """The name as it stands in the document, decoded."""
        return None if self.name_raw is None else self.codec.decode(self.name_raw)


@dataclass
class Context:
    """What tag names tell about the text that follows; small enough to be kept between chunks."""

    strict: bool = True
    codec: Codec = UTF8
    adjust: bool = False  # whether the first declared charset is taken
    held: int = 0  # of a document in pieces: where the bytes begin that weren't taken
    in_cdata: bool = False
    ns: list[str] = field(default_factory=lambda: ["html"])
    cdata: bool = False
    guard: tuple[str, int] = ("", 0)
    mode: str = "Data"  # how text is scanned
    label: str = "Data"  # what text is called
    last_start: str = ""

    def _check(self, name: str) -> None:
        if name in RCDATA or name in RAWTEXT or name in ("plaintext", "script"):
            raise AmbiguityError(f"<{name}> leaves the parsing of what follows ambiguous here")

    def _guard_start(self, name: str) -> None:
        state, depth = self.guard
        if state == "":
            if name in ("select", "frameset"):
                self.guard = (name, 0)
        elif state == "select":
            if name in ("select", "textarea", "input", "keygen"):
                self.guard = ("", 0)
            elif name == "template":
                self.guard = ("template", 1)
            elif name != "script":
                self._check(name)
        elif state == "template":
            if name == "template":
                self.guard = ("template", depth + 1)
            else:
                self._check(name)
        elif name != "noframes":
            self._check(name)

    def _guard_end(self, name: str) -> None:
        state, depth = self.guard
        if state == "select" and name == "select":
            self.guard = ("", 0)
        elif state == "template" and name == "template":
            self.guard = ("select", 0) if depth == 1 else ("template", depth - 1)

    def _leave(self) -> None:
        if len(self.ns) > 1:
            self.ns.pop()
        self.cdata = self.ns[-1] != "html"

    def _enter(self, ns: str) -> None:
        self.ns.append(ns)
        self.cdata = ns != "html"

    def start_tag(self, t: Token) -> None:
        """Take in a start tag and give it its namespace."""
        name, now = t.name, self.ns[-1]
        if self.strict:
            self._guard_start(name)
        self.mode = self.label = "Data"
        if name == "svg":
            self._enter("svg")
        elif name == "math":
            self._enter("mathml")
        elif now == "html":
            if name in RCDATA:
                self.mode = self.label = "RCData"
            elif name in RAWTEXT:
                self.mode = self.label = "RawText"
            elif name == "script":
                self.mode = self.label = "ScriptData"
            elif name == "plaintext":
                self.mode = self.label = "PlainText"
        elif name in BREAKOUT:
            self._leave()
        elif (now == "svg" and name in SVG_POINTS) or (now == "mathml" and name in MATHML_POINTS):
            if not t.self_closing:
                self._enter("html")
        elif name == "font":
            if any(a.name in ("color", "size", "face") for a in t.attrs):
                self._leave()
        elif now == "mathml" and name == "annotation-xml" and not t.self_closing:
            if any(a.name == "encoding" and a.value.lower() in ("text/html", "application/xhtml+xml") for a in t.attrs):
                self._enter("html")
        self.last_start = name
        t.ns = self.ns[-1]

    def end_tag(self, name: str) -> None:
        if self.strict:
            self._guard_end(name)
        self.mode = self.label = "Data"
        now = self.ns[-1]
        if now == "html":
            before = self.ns[-2] if len(self.ns) > 1 else None
            if (before == "mathml" and (name in MATHML_POINTS or name == "annotation-xml")) or (before == "svg" and name in SVG_POINTS):
                self._leave()
        elif (now, name) in (("svg", "svg"), ("mathml", "math")) or name in ("p", "br"):
            self._leave()


#: Bytes that an open element is taken to need, for limits.
STACK_ITEM = 256


class Stack:
    """Open elements: identifiers, depth, child counters, and which end tag closes what.

    ``closes`` keeps the start tags of open elements, so that they learn their end tags; ``limit`` is in bytes, at STACK_ITEM
    for an open element.
    """

    def __init__(self, esi: bool = False, closes: bool = True, limit: int | None = None):
        self.esi, self.next_id, self.limit = esi, 0, limit
        self.names: list[str] = []
        self.ids: list[int] = []
        self.open: dict[str, int] = {}
        self.totals: list[int] = [0]
        self.by_name: list[dict[str, int] | None] = [None]
        self.start_of: list[Token] | None = [] if closes else None

    def place(self, t: Token) -> None:
        ids = self.ids
        t.open, t.depth, t.parent = ids, len(ids), ids[-1] if ids else None

    def start_tag(self, t: Token) -> None:
        if t.ns == "html":
            t.content = t.name not in VOID and not (self.esi and t.name_raw.decode("utf-8", "replace") in ESI_VOID)
        else:
            t.content = not t.self_closing
        if t.content and self.limit is not None and (len(self.ids) + 1) * STACK_ITEM > self.limit:
            raise MemoryLimitError(f"{len(self.ids) + 1} open elements need more than {self.limit} bytes")
        self.place(t)
        t.elem_id, self.next_id = self.next_id, self.next_id + 1
        self.totals[-1] += 1
        t.nth_child = self.totals[-1]
        by_name = self.by_name[-1]
        if by_name is None:
            by_name = self.by_name[-1] = {}
        t.nth_of_type = by_name[t.name] = by_name.get(t.name, 0) + 1
        if t.content:
            self.names.append(t.name), self.ids.append(t.elem_id)
            if self.start_of is not None:
                self.start_of.append(t)
            self.open[t.name] = self.open.get(t.name, 0) + 1
            self.totals.append(0), self.by_name.append(None)

    def end_tag(self, t: Token, index: int) -> None:
        t.popped = ()
        if self.open.get(t.name):
            k = len(self.names) - 1
            while self.names[k] != t.name:
                k -= 1
            for name in self.names[k:]:
                self.open[name] -= 1
            if self.start_of is not None:
                for s in self.start_of[k:]:
                    s.close_tok = index
                del self.start_of[k:]
            t.popped = tuple(self.ids[k:])
            del self.names[k:], self.ids[k:], self.totals[k + 1 :], self.by_name[k + 1 :]
        self.place(t)


def _tag(html: bytes, at: int, name_at: int, closing: bool, codec: Codec) -> tuple[Token | None, int, bool]:
    """(token, end, value missing) of a tag; no token if it is cut off."""
    raw = _NAME.match(html, name_at)[0]
    p = name_at + len(raw)
    if html[p : p + 1] == b">":
        end, closed, missing = p + 1, False, False
    elif m := _REST.match(html, p):
        end, missing = m.end(), m[1] is not None
        closed = not missing and m[2].endswith(b"/")
    else:
        return None, len(html), False
    t = Token("end_tag" if closing else "start_tag", at, end, lower(raw, codec), raw, codec=codec)
    if not closing:
        t.self_closing, t.source = closed, html
    return t, end, missing


def _attributes(html: bytes, p: int, codec: Codec, base: int) -> list[Attribute]:
    """The attributes of a whole tag whose name ends at ``p``."""
    attrs = []
    while True:
        gap = _GAP.match(html, p).end()
        if html[gap] == 62:  # >
            return attrs
        name_end = _ATTR.match(html, gap).end()
        eq = _EQUALS.match(html, name_end)
        missing = False
        if not eq:
            p = v0 = v1 = raw_end = name_end
        else:
            p = eq.end()
            c = html[p]
            if c == 62:
                v0 = v1 = raw_end = p
                missing = True
            elif c in b"\"'":
                v0, v1 = p + 1, html.find(html[p : p + 1], p + 1)
                p = raw_end = v1 + 1
            else:
                v0, v1 = p, _BARE.match(html, p).end()
                p = raw_end = v1
        shown = html[gap:name_end]
        attrs.append(Attribute(lower(shown, codec), codec.decode(shown), codec.decode(html[v0:v1]), html[gap:raw_end], base + gap, base + v0))
        if missing:
            return attrs


def _doctype(html: bytes, at: int, codec: Codec) -> tuple[Token, int]:
    n, p = len(html), at + 9
    name = public = system = None
    quirks = False

    def end(q: int) -> int:
        e = html.find(b">", q)
        return n if e < 0 else e + 1

    def quoted(q: int) -> tuple[str, int, bool]:
        """(value, position after it, whether it was closed): up to the quote or a >."""
        m = re.compile(rb"[^>" + html[q : q + 1] + rb"]*").match(html, q + 1)
        e = m.end()
        return codec.decode(m[0]), e + (e < n and html[e] != 62), e < n and html[e] != 62

    p = _BLANKS.match(html, p).end()
    stop = end(p)
    if p >= n or html[p] == 62:
        return Token("doctype", at, stop, doctype=(None, None, None, True)), stop
    m = re.compile(rb"[^ \n\r\t\x0c>]+").match(html, p)
    name = lower(m[0], codec)
    p = _BLANKS.match(html, m.end()).end()
    if p >= n:
        quirks = True
    elif html[p] != 62:
        word = html[p : p + 6].upper()
        ok = word in (b"PUBLIC", b"SYSTEM")
        if ok:
            p += 6
            q = _BLANKS.match(html, p).end()
            if q < n and html[q] in b"\"'":
                value, p, ok = quoted(q)
                if word == b"PUBLIC":
                    public = value
                    if ok:
                        q = _BLANKS.match(html, p).end()
                        if q < n and html[q] in b"\"'":
                            system, p, ok = quoted(q)
                        elif q >= n or html[q] != 62:
                            ok = False
                else:
                    system = value
                if ok and system is not None:
                    p = _BLANKS.match(html, p).end()
                    quirks = p >= n
            else:
                ok = False
        quirks = quirks or not ok
        stop = end(p)
    return Token("doctype", at, stop, doctype=(name, public, system, quirks)), stop


def tokenize(html: bytes, strict: bool = True, esi: bool = False, ctx: Context | None = None, stack: Stack | None = None) -> Iterator[Token]:
    """The tokens of a document in order. Raises AmbiguityError or MemoryLimitError, after the tokens before the tag."""
    ctx, stack = ctx or Context(strict), stack or Stack(esi)
    yield from placed(scan(html, ctx), stack)


def placed(tokens: Iterator[Token], stack: Stack, index: int = 0) -> Iterator[Token]:
    """Gives tokens their place in the stack; ``index`` is the first one's number."""
    for t in tokens:
        if t.kind == "start_tag":
            stack.start_tag(t)
        elif t.kind == "end_tag":
            stack.end_tag(t, index)
        else:
            stack.place(t)
        index += 1
        yield t


_SPACES = re.compile(rb"[ \n\r\t\x0c]")


def _cut(html: bytes, start: int, end: int) -> int:
    """Where a text that goes on may be cut: after its last white space, which is no part of a character in any encoding."""
    return max(html.rfind(c, start, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0c")) + 1 or start


def scan(html: bytes, ctx: Context, final: bool = True) -> Iterator[Token]:
    """The tokens of ``html`` in the state ``ctx``. With ``final=False`` more bytes follow: what they could change isn't taken,
    and ``ctx.held`` is where that begins."""
    n, at, run, run_label = len(html), 0, 0, ctx.label
    in_cdata = ctx.in_cdata
    ctx.held = n

    def text(upto: int, partial: bool = False) -> Token | None:
        return Token("text", run, upto, text=html[run:upto], text_type=run_label, codec=ctx.codec, partial=partial) if upto > run else None

    def hold(p: int, cut: bool = True) -> Token | None:
        """More bytes are needed from ``p`` on: the text before it is given out as far as it can't change."""
        ctx.held = p if not cut else max(run, _cut(html, run, p)) if p == n else p
        return text(ctx.held, True)

    while at < n:
        # the next markup, by mode
        if in_cdata:
            p = html.find(b"]]>", at)
            if p < 0:
                if not final:
                    if t := hold(n):
                        yield t
                    return
                break
            if t := text(p):
                yield t
            ctx.in_cdata = in_cdata = False
            at = run = p + 3
            ctx.label = run_label = "Data"
            yield Token("raw", p, p + 3)
            continue
        if ctx.mode == "PlainText":
            if not final:
                if t := hold(n):
                    yield t
                return
            break
        if ctx.mode == "ScriptData":
            p, q, escaped = -1, at, 0
            while True:
                m = (_ESCAPED if escaped else _SCRIPT).search(html, q)
                if not m:
                    break
                q = m.end()
                if not escaped:
                    if html[m.start() + 1] == 47:
                        p = m.start()
                        break
                    escaped, q = 1, m.start() + 2
                elif m[0][:1] == b"-":
                    escaped = 0
                elif escaped == 1:
                    if m[1]:
                        p = m.start()
                        break
                    escaped = 2
                elif m[1]:
                    escaped = 1
            if p < 0:
                if not final:  # a script is held back as a whole
                    ctx.held = run
                    return
                break
        elif ctx.mode in ("RCData", "RawText"):
            m = re.compile(rb"</" + ctx.last_start.encode() + rb"(?=[ \n\r\t\x0c/>])", re.I).search(html, at)
            if not m:
                if not final:
                    ctx.held = run
                    return
                break
            p = m.start()
        else:
            p = html.find(b"<", at)
            if p < 0:
                if not final:
                    if t := hold(n):
                        yield t
                    return
                break
        if not final and not _complete(html, p, ctx):
            if t := hold(p):
                yield t
            return
        c = html[p + 1] if p + 1 < n else -1
        if c in _ALPHA:
            closing, name_at = False, p + 1
        elif c == 47:
            c = html[p + 2] if p + 2 < n else -1
            if c in _ALPHA:
                closing, name_at = True, p + 2
            else:
                if c == -1:
                    break
                if t := text(p):
                    yield t
                if c == 62:
                    yield Token("raw", p, p + 3)
                    at = run = p + 3
                else:
                    e = html.find(b">", p + 2)
                    at = run = n if e < 0 else e + 1
                    yield Token("comment", p, at, text=html[p + 2 : n if e < 0 else e], codec=ctx.codec)
                run_label = ctx.label
                continue
        elif c == 33 or c == 63:
            if t := text(p):
                yield t
            if c == 33 and html.startswith(b"--", p + 2):
                if html.startswith(b">", p + 4):
                    s = e = p + 4
                    at = p + 5
                elif html.startswith(b"->", p + 4):
                    s = e = p + 4
                    at = p + 6
                else:
                    s, m = p + 4, _COMMENT_END.search(html, p + 4)
                    if m:
                        e, at = m.start(), m.end()
                    else:
                        at = n
                        cut = _COMMENT_CUT.search(html, s)
                        e = cut.start() if cut else n
                yield Token("comment", p, at, text=html[s:e], codec=ctx.codec)
            elif c == 33 and html[p + 2 : p + 9].upper() == b"DOCTYPE":
                t, at = _doctype(html, p, ctx.codec)
                yield t
            elif c == 33 and ctx.cdata and html.startswith(b"[CDATA[", p + 2):
                at = p + 9
                ctx.in_cdata = in_cdata = True
                ctx.label = "CDataSection"
                yield Token("raw", p, at)
            else:
                s = p + 2 if c == 33 else p + 1
                e = html.find(b">", s)
                at = n if e < 0 else e + 1
                yield Token("comment", p, at, text=html[s : n if e < 0 else e], codec=ctx.codec)
            run, run_label = at, ctx.label
            continue
        else:
            at = p + 1  # a plain <
            continue
        t, end, missing = _tag(html, p, name_at, closing, ctx.codec)
        if t is None and not final:
            if t := hold(p):
                yield t
            return
        if (before := text(p)) is not None:
            yield before
        if t is None:
            yield Token("raw", p, n)
            return
        if closing:
            ctx.end_tag(t.name)
        else:
            ctx.start_tag(t)
            if missing:
                ctx.mode = "Data"
            if ctx.adjust and t.name == "meta" and (found := declared_in([(a.name, a.value) for a in t.attrs])):
                ctx.codec, ctx.adjust = Codec(found), False  # from the tag's end on
        at = run = end
        run_label = ctx.label
        yield t
    if t := text(n):
        yield t


def _complete(html: bytes, p: int, ctx: Context) -> bool:
    """Whether the markup at ``p``, of a document that goes on, is there as a whole; tags are tried elsewhere."""
    rest = html[p + 1 : p + 9]
    if not rest or (rest == b"/"):
        return False
    if rest[0] == 33:  # !
        if rest[1:3] == b"--":
            m = _COMMENT_END.search(html, p + 4)
            return bool(m) or html.startswith((b">", b"->"), p + 4)
        for word in (b"--", b"doctype", b"[cdata["):
            if len(html) - p - 2 < len(word) and word.startswith(html[p + 2 :].lower()):
                return False
        if ctx.cdata and html.startswith(b"[CDATA[", p + 2):
            return True
        return html.find(b">", p + 2) >= 0
    if rest[0] == 63 or (rest[0] == 47 and rest[1] not in _ALPHA):
        return html.find(b">", p + 1) >= 0
    return True
