"""CSS selectors: a parser, its errors, matching inside the tokenizer pass, and compounds as Catalyst predicates.

Supported: type, universal, id, class, attribute tests with i and s flags, :nth-child and :nth-of-type with their
:first- forms, :not with simple selectors, descendant and child combinators, and lists. :not negates each simple
selector of its argument and requires all of the negations.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = " \n\r\t\x0c"
#: Attributes of HTML elements whose values compare without regard to case, per the HTML standard (fixed values).
FOLDED = frozenset(
    "accept accept-charset align alink axis bgcolor charset checked clear codetype color compact declare defer dir direction disabled"
    " enctype face frame hreflang http-equiv lang language link media method multiple nohref noresize noshade nowrap readonly rel rev"
    " rules scope scrolling selected shape target text type valign valuetype vlink".split()
)
#: Kinds of errors (fixed names), with what each means.
ERRORS = {
    "UnexpectedToken": "something stands where it can't",
    "UnexpectedEnd": "it breaks off",
    "MissingAttributeName": "an attribute test lacks its attribute",
    "EmptySelector": "nothing is selected between the commas, or at all",
    "DanglingCombinator": "a combinator joins nothing on one side",
    "UnexpectedTokenInAttribute": "an attribute test isn't name, operator, value",
    "UnsupportedPseudoClassOrElement": "this pseudo-class or pseudo-element can't be known while a document streams by",
    "NamespacedSelector": "namespace prefixes have no meaning here",
    "InvalidClassName": "a dot is followed by what can't be a class; escape it",
    "UnsupportedCombinator": "only descendants and children can be matched going forward",
}


class SelectorError(ValueError):
    """A selector that can't be parsed; ``kind`` is a key of ERRORS."""

    def __init__(self, kind: str, detail: str = ""):
        super().__init__(f"{kind}: {ERRORS[kind]}" + (f" ({detail})" if detail else ""))
        self.kind = kind


@dataclass(frozen=True)
class Test:
    """One simple selector: what it looks at, and whether it is negated."""

    what: str  # any, none, type, id, class, attr, nth_child, nth_of_type
    name: str = ""
    op: str = ""  # of attr: "", =, ~=, ^=, $=, *=, |=
    value: str = ""
    fold: str = ""  # i, s, or "" for the attribute's default
    step: int = 0
    offset: int = 0
    negated: bool = False


@dataclass(frozen=True)
class Compound:
    tests: tuple[Test, ...]
    combinator: str = ""  # to the compound before: "" for the first, " " or ">"


@dataclass(frozen=True)
class Selector:
    """Alternatives, each a chain of compounds."""

    text: str
    chains: tuple[tuple[Compound, ...], ...] = field(compare=False)


def nth(step: int, offset: int, index: int) -> bool:
    """Whether the 1-based ``index`` is step * n + offset for some n >= 0."""
    d = index - offset
    return d == 0 if step == 0 else d % step == 0 and d // step >= 0


_IDENT = re.compile(r"-?(?:[A-Za-z_\u0080-\U0010ffff]|\\[0-9A-Fa-f]{1,6}[ \n\r\t\f]?|\\[^\n\r\f0-9A-Fa-f])(?:[-\w\u0080-\U0010ffff]|\\[0-9A-Fa-f]{1,6}[ \n\r\t\f]?|\\[^\n\r\f0-9A-Fa-f])*|--(?:[-\w\u0080-\U0010ffff]|\\.)*")
_HASH = re.compile(r"#((?:[-\w\u0080-\U0010ffff]|\\[0-9A-Fa-f]{1,6}[ \n\r\t\f]?|\\[^\n\r\f0-9A-Fa-f])+)")
_ESCAPE = re.compile(r"\\(?:([0-9A-Fa-f]{1,6})[ \n\r\t\f]?|(.))", re.S)
_STRING = re.compile(r'"((?:[^"\\\n]|\\.)*)"|\'((?:[^\'\\\n]|\\.)*)\'', re.S)
_COMMENT = re.compile(r"(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\\.)|/\*.*?(?:\*/|\Z)", re.S)
_NTH = re.compile(r"\s*(?:(even)|(odd)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.I)


def _unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            code = int(m[1], 16)
            return chr(code) if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
        return "" if m[2] == "\n" else m[2]

    return _ESCAPE.sub(one, s)


class _Parser:
    def __init__(self, text: str):
        self.s, self.at = _COMMENT.sub(lambda m: m[1] or "", text), 0

    def peek(self) -> str:
        return self.s[self.at : self.at + 1]

    def blanks(self) -> bool:
        start = self.at
        while self.at < len(self.s) and self.s[self.at] in WS:
            self.at += 1
        return self.at > start

    def ident(self) -> str | None:
        m = _IDENT.match(self.s, self.at)
        if not m:
            return None
        self.at = m.end()
        return _unescape(m[0])

    def list(self, stop: str = "") -> list[list[Compound]]:
        out = [self.chain(stop)]
        while self.peek() == ",":
            self.at += 1
            out.append(self.chain(stop))
        return out

    def chain(self, stop: str) -> list[Compound]:
        self.blanks()
        out: list[Compound] = []
        combinator = ""
        while True:
            tests = self.compound()
            if not tests:
                c = self.peek()
                if out and combinator:
                    raise SelectorError("DanglingCombinator")
                if c in (">", "+", "~") and c:
                    raise SelectorError("DanglingCombinator")
                if c in ("", ",", stop):
                    raise SelectorError("EmptySelector")
                raise SelectorError("UnexpectedToken", c)
            out.append(Compound(tuple(tests), combinator))
            spaced = self.blanks()
            c = self.peek()
            if c == "" or c == "," or (stop and c == stop):
                return out
            if c == ">":
                combinator = ">"
                self.at += 1
                self.blanks()
            elif c in "+~|" and (c != "|" or self.s.startswith("||", self.at)):
                self.at += 1
                self.blanks()
                if self.peek() in ("", ","):
                    raise SelectorError("DanglingCombinator")
                raise SelectorError("UnsupportedCombinator", c)
            elif spaced:
                combinator = " "
            else:
                raise SelectorError("UnexpectedToken", c)

    def compound(self) -> list[Test]:
        tests: list[Test] = []
        start = self.at
        name = None
        if self.peek() == "*":
            self.at += 1
            name = "*"
        elif self.peek() != "|":
            name = self.ident()
        if self.peek() == "|" and self.s[self.at + 1 : self.at + 2] not in ("=", "|"):
            self.at += 1
            local = "*" if self.peek() == "*" else None
            if local:
                self.at += 1
            else:
                local = self.ident()
            if local is None:
                raise SelectorError("UnexpectedToken" if self.peek() else "UnexpectedEnd")
            if name is None:
                tests.append(Test("none"))
            elif name != "*":
                raise SelectorError("NamespacedSelector")
            name = local
        if name is not None:
            tests.append(Test("any") if name == "*" else Test("type", name.translate(_LOWER)))
        while True:
            c = self.peek()
            if c == "#":
                m = _HASH.match(self.s, self.at)
                if not m:
                    raise SelectorError("UnexpectedToken", c)
                self.at = m.end()
                tests.append(Test("id", value=_unescape(m[1])))
            elif c == ".":
                self.at += 1
                v = self.ident()
                if v is None:
                    raise SelectorError("InvalidClassName" if self.peek() else "UnexpectedEnd")
                if self.peek() == "(":
                    raise SelectorError("InvalidClassName", v + "(")
                tests.append(Test("class", value=v))
            elif c == "[":
                tests.append(self.attribute())
            elif c == ":":
                tests += self.pseudo()
            else:
                return tests if self.at > start else []

    def attribute(self) -> Test:
        self.at += 1
        self.blanks()
        if self.peek() == "|":
            self.at += 1
        elif self.s.startswith("*|", self.at):
            raise SelectorError("NamespacedSelector", "*|")
        name = self.ident()
        if name is None:
            if not self.peek():
                raise SelectorError("UnexpectedEnd")
            raise SelectorError("MissingAttributeName" if self.peek() in "]=" else "UnexpectedToken", self.peek())
        if self.peek() == "|" and self.s[self.at + 1 : self.at + 2] != "=":
            raise SelectorError("NamespacedSelector")
        name = name.translate(_LOWER)
        self.blanks()
        if self.peek() == "]":
            self.at += 1
            return Test("attr", name)
        m = re.compile(r"[~^$*|]?=").match(self.s, self.at)
        if not m:
            raise SelectorError("UnexpectedTokenInAttribute" if self.peek() else "UnexpectedEnd", self.peek())
        self.at = m.end()
        self.blanks()
        q = _STRING.match(self.s, self.at)
        if q:
            self.at = q.end()
            value = _unescape(q[1] if q[1] is not None else q[2])
        else:
            value = self.ident()
            if value is None:
                raise SelectorError("UnexpectedTokenInAttribute" if self.peek() else "UnexpectedEnd", self.peek())
        self.blanks()
        fold = self.peek()
        if fold and fold in "iIsS":
            self.at += 1
            self.blanks()
            fold = fold.lower()
        else:
            fold = ""
        if self.peek() != "]":
            raise SelectorError("UnexpectedTokenInAttribute" if self.peek() else "UnexpectedEnd", self.peek())
        self.at += 1
        return Test("attr", name, m[0], value, fold)

    def pseudo(self) -> list[Test]:
        self.at += 1
        if self.peek() == ":":
            raise SelectorError("UnsupportedPseudoClassOrElement")
        name = self.ident()
        if name is None:
            raise SelectorError("UnexpectedToken" if self.peek() else "UnexpectedEnd", self.peek())
        name = name.lower()
        if self.peek() != "(":
            if name in ("first-child", "first-of-type"):
                return [Test("nth_child" if name == "first-child" else "nth_of_type", offset=1)]
            raise SelectorError("UnsupportedPseudoClassOrElement", name)
        self.at += 1
        if name in ("nth-child", "nth-of-type"):
            end = self.s.find(")", self.at)
            if end < 0:
                raise SelectorError("UnexpectedEnd")
            inside = self.s[self.at : end]
            m = _NTH.match(inside)
            if not m:
                raise SelectorError("UnexpectedToken", inside)
            self.at = end + 1
            if m[1] or m[2]:
                step, offset = 2, 0 if m[1] else 1
            elif m[6]:
                step, offset = 0, int(m[6])
            else:
                step = int(m[3] + "1") if m[3] in ("", "+", "-") else int(m[3])
                offset = int((m[4] or "+") + m[5]) if m[5] else 0
            return [Test(name.replace("-", "_"), step=step, offset=offset)]
        if name == "not":
            found = self.list(")")
            if self.peek() != ")":
                raise SelectorError("UnexpectedEnd")
            self.at += 1
            if any(len(chain) > 1 for chain in found):
                raise SelectorError("UnsupportedPseudoClassOrElement", "combinators inside :not")
            return [_negate(t) for chain in found for t in chain[0].tests]
        raise SelectorError("UnsupportedPseudoClassOrElement", name)


_LOWER = {c: c + 32 for c in range(65, 91)}


def _negate(t: Test) -> Test:
    return Test(t.what, t.name, t.op, t.value, t.fold, t.step, t.offset, not t.negated)


def parse(text: str) -> Selector:
    p = _Parser(text)
    chains = p.list()
    if p.at < len(p.s):
        raise SelectorError("UnexpectedToken", p.peek())
    return Selector(text, tuple(tuple(c) for c in chains))


# -- in the tokenizer pass


def _value_holds(op: str, have: str, want: str) -> bool:
    if op == "=":
        return have == want
    if op == "~=":
        return want in re.split(f"[{WS}]", have)
    if op == "^=":
        return have != "" and have.startswith(want)
    if op == "$=":
        return have != "" and have.endswith(want)
    if op == "*=":
        return want != "" and want in have
    return have == want or have.startswith(want + "-")


def holds(t: Test, token) -> bool:
    """Whether a simple selector holds for a start tag."""
    return _plain(t, token) != t.negated


def _plain(t: Test, token) -> bool:
    if t.what == "type":
        return token.name == t.name
    if t.what in ("any", "none"):
        return t.what == "any"
    if t.what == "nth_child":
        return nth(t.step, t.offset, token.nth_child)
    if t.what == "nth_of_type":
        return nth(t.step, t.offset, token.nth_of_type)
    name = t.name if t.what == "attr" else t.what
    have = next((a.value for a in token.attrs if a.name == name), None)
    if have is None:
        return False
    if t.what == "id":
        return have == t.value
    if t.what == "class":
        return t.value in re.split(f"[{WS}]", have)
    if t.op == "":
        return True
    want = t.value
    if t.fold == "i" or (t.fold == "" and t.name in FOLDED and token.ns == "html"):
        have, want = have.translate(_LOWER), want.translate(_LOWER)
    return _value_holds(t.op, have, want)


class Matcher:
    """Which of several selectors match each start tag, in one pass; equal prefixes of chains are shared as states.

    A state is (selector, chain, number of compounds met). Open elements carry the states that their children, or all
    their descendants, continue; a state already active for all descendants isn't kept twice.
    """

    def __init__(self, selectors: list[Selector]):
        self.nodes: list[tuple[Compound, list[int], set[int]]] = []  # compound, continuing nodes, ids matched here
        self.roots: list[int] = []
        for i, s in enumerate(selectors):
            for chain in s.chains:
                level = self.roots
                for k, compound in enumerate(chain):
                    found = next((n for n in level if self.nodes[n][0] == compound), None)
                    if found is None:
                        found = len(self.nodes)
                        self.nodes.append((compound, [], set()))
                        level.append(found)
                    if k == len(chain) - 1:
                        self.nodes[found][2].add(i)
                    level = self.nodes[found][1]
        # roots by the type they ask for, so that most tags are looked at by none
        self.typed: dict[str, list[int]] = {}
        self.untyped: list[int] = []
        for n in self.roots:
            name = next((t.name for t in self.nodes[n][0].tests if t.what == "type" and not t.negated), None)
            (self.untyped if name is None else self.typed.setdefault(name, [])).append(n)
        self.children: list[tuple[int, ...]] = [()]
        self.below: list[frozenset[int]] = [frozenset()]

    def start_tag(self, t) -> list[int]:
        """Numbers of the matching selectors, ascending; opens the element if it has content."""
        found: set[int] = set()
        children: list[int] = []
        below: set[int] = set()
        wanted = self.typed.get(t.name, ())
        if self.children[-1] or self.below[-1]:
            wanted = {*wanted, *self.untyped, *self.children[-1], *self.below[-1]}
        elif self.untyped:
            wanted = [*wanted, *self.untyped]
        for n in wanted:
            compound, then, ids = self.nodes[n]
            if all(holds(x, t) for x in compound.tests):
                found |= ids
                for k in then:
                    if self.nodes[k][0].combinator == ">":
                        children.append(k)
                    else:
                        below.add(k)
        if t.content:
            self.children.append(tuple(children))
            self.below.append(self.below[-1] | below if below else self.below[-1])
        return sorted(found) if found else []

    def end_tag(self, t) -> None:
        if t.popped:
            del self.children[-len(t.popped) :], self.below[-len(t.popped) :]


def _shown(t: Test) -> str:
    if t.what in ("any", "none", "type"):
        said = {"any": "*", "none": "|*", "type": t.name}[t.what]
    elif t.what in ("id", "class"):
        said = f"{'#' if t.what == 'id' else '.'}{t.value}"
    elif t.what == "attr":
        said = f"[{t.name}{t.op}{t.value!r}{' ' + t.fold if t.fold else ''}]" if t.op else f"[{t.name}]"
    else:
        said = f":{t.what.replace('_', '-')}({t.step}n{t.offset:+d})"
    return f":not({said})" if t.negated else said


def program(selectors: list[str]) -> list[tuple[int, int | None, str, str, list[int]]]:
    """What the pass runs for several selectors: (node, node before, combinator, compound, selectors matched here)."""
    m = Matcher([parse(s) for s in selectors])
    before = {k: n for n, (_, then, _) in enumerate(m.nodes) for k in then}
    return [(n, before.get(n), {"": "root", " ": "descendant", ">": "child"}[c.combinator], "".join(map(_shown, c.tests)), sorted(ids)) for n, (c, _, ids) in enumerate(m.nodes)]


def explain(selectors: list[str]) -> str:
    """The program of several selectors as an indented text; compounds that selectors share stand once."""
    rows, depth, lines = program(selectors), {}, []

    def add(parent: int | None, level: int) -> None:
        for n, up, combinator, said, ids in rows:
            if up == parent and n not in depth:
                depth[n] = level
                lines.append("  " * level + ("> " if combinator == "child" else "") + said + (f"  => {', '.join(map(str, ids))}" if ids else ""))
                add(n, level + 1)

    add(None, 0)
    return "\n".join(lines)


# -- as Catalyst predicates over elements


def attribute(name: str) -> Column:
    """The value of the first attribute of that name; null if there is none."""
    return F.get(F.filter("attrs", lambda a: a["name"] == name.translate(_LOWER)), F.lit(0))["value"]


def _fold(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _test_column(t: Test) -> Column:
    if t.what in ("any", "none"):
        return F.lit(t.what == "any")
    if t.what == "type":
        return F.col("name") == t.name
    if t.what in ("nth_child", "nth_of_type"):
        d = F.col(t.what) - t.offset
        return d == 0 if t.step == 0 else (d * (1 if t.step > 0 else -1) >= 0) & (d % abs(t.step) == 0)
    have = attribute(t.name if t.what == "attr" else t.what)
    if t.what == "id":
        return have == t.value
    if t.what == "class":
        return F.array_contains(F.split(have, f"[{WS}]"), t.value)
    if t.op == "":
        return have.isNotNull()

    def test(have: Column, want: str) -> Column:
        if t.op == "=":
            return have == want
        if t.op == "~=":
            return F.array_contains(F.split(have, f"[{WS}]"), want)
        if t.op == "^=":
            return (have != "") & have.startswith(want)
        if t.op == "$=":
            return (have != "") & have.endswith(want)
        if t.op == "*=":
            return have.contains(want) if want else F.lit(False)
        return (have == want) | have.startswith(want + "-")

    plain, folded = test(have, t.value), test(_fold(have), t.value.translate(_LOWER))
    if t.fold == "i":
        return folded
    return F.when(F.col("ns") == "html", folded).otherwise(plain) if t.fold == "" and t.name in FOLDED else plain


def predicate(selector: str | Selector) -> Column:
    """A selector without combinators as a predicate over ``elements``; raises SelectorError for others."""
    s = parse(selector) if isinstance(selector, str) else selector
    out = F.lit(False)
    for chain in s.chains:
        if len(chain) > 1:
            raise SelectorError("UnsupportedCombinator", "as a predicate; use select()")
        all_hold = F.lit(True)
        for t in chain[0].tests:
            c = F.coalesce(_test_column(t), F.lit(False))
            all_hold = all_hold & (~c if t.negated else c)
        out = out | all_hold
    return out
