"""Main text of web pages by site style trees.

1. ``parse``: one Arrow pass reads each page with the engine's tokenizer, keeps a stack of its block elements, and writes the
   page's part of its site's style tree to the shared folder: the element nodes (numbered, with the hash of their path of
   names and classes from the root, their parent, and a digest of the child elements met there: the presentation) and the
   content nodes (runs of text in one block, with a digest). Only what can become main text is written: text inside the
   page's articles (or its main element, or else its body), without elements that say what they are: menus, headers,
   footers, sidebars, notices, adverts, forms, comments, by element, role or class. Inside articles such words are often
   just names: but for those of CLEAR, they drop only blocks that are mostly links, and else leave the node in doubt.
2. ``importance``: Spark merges the pages of a host by path. A presentation or content that k of a node's m different pages
   share is important by 1 - log k / log(m + PRIOR): 1 if a page has it alone, near 0 if all of many pages have it. The
   importance of a node's presentation and of its content is the mean over its pages, which is their entropy as a share of
   the largest possible, with PRIOR pages that differ added: few pages say little.
3. ``extract``: a second pass over the written pages composes importance from the leaves up: that of an element is
   (1 - g^l) of its presentation's and g^l of the mean of its l children's, g = DECAY. It removes branches in which all
   elements are below LOW, branches in doubt below DOUBT, and content nodes below LOW. If that would leave a page without
   text, its site says nothing about it, and it keeps its text.

Importances are broadcast if they are at most BROADCAST, else joined to the nodes of each page; both give the same results.
Character references are decoded, white space inside a block becomes one space, blocks are joined by one space.

Defined cases: null and empty html give an empty text; unclosed and stray tags are tolerated; a page without article and
main is taken from its body, less paragraphs that are mostly links; pages with a null url form a host of their own;
equal pages of a host count once; repeated rows and null ids give repeated results; other columns are ignored; an empty
table gives an empty result. A page costs time and memory in proportion to its length, however deep it nests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tokenizer import VOID, Context, scan
from .common import Scratch, salted_join

PRIOR, LOW, DOUBT, DECAY, BROADCAST = 6, 0.3, 0.6, 0.9, 100_000
#: Element names and words of classes, by their meaning in HTML (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
AWAY = frozenset(
    "head script style noscript template iframe audio video nav footer aside form button select option"
    " textarea input datalist dialog menu title xmp noembed noframes".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs masthead topbar footer sidebar aside widget widgets ad ads advert adverts"
    " advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promotion cookie cookies consent notice notices gdpr"
    " popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond disqus"
    " related recommended recommendations share sharing social toolbar pagination pager skip search copyright disclaimer form".split()
)
#: Words of classes that decide inside articles too, alone.
CLEAR = frozenset("ad ads advert adverts advertisement advertisements adsense comments commentlist disqus".split())
#: Elements whose start ends an open element of the second kind.
CLOSES = {t: frozenset({"p"}) for t in BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}} | {
    "li": frozenset({"li", "p"}),
    "dt": frozenset({"dt", "dd", "p"}),
    "dd": frozenset({"dt", "dd", "p"}),
    "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}),
    "tr": frozenset({"tr", "td", "th", "p"}),
    "option": frozenset({"option"}),
}
SCOPES = frozenset("html body article main section aside nav header footer div ul ol dl table form blockquote td th".split())
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _any_word(said: str, of: frozenset[str]) -> bool:
    return any(w.lower() in of for w in _PARTS.findall(said))


def _says_away(name: str, attributes: dict[str, str], inside: bool) -> bool:
    if name in AWAY or attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if name in ("html", "body", "article", "main") and "comment" not in attributes.get("class", "").lower():
        return False
    if _HIDDEN.search(attributes.get("style", "")):
        return True
    said = attributes.get("class", "")
    return _any_word(said, CLEAR) if inside and name not in ("article", "main") else _any_word(f"{said} {attributes.get('id', '')}", WORDS)


def _in_doubt(name: str, attributes: dict[str, str]) -> bool:
    """Whether a block inside an article has a word that needs more than itself; ids of headings and sections say nothing."""
    if name not in BLOCKS or name in ("article", "main"):
        return False
    named = "" if name in HEADINGS or name == "section" else attributes.get("id", "")
    return _any_word(f"{attributes.get('class', '')} {named}", WORDS)


def _key(said: str) -> int:
    return xxhash.xxh3_64_intdigest(said.encode("utf-8", "replace")) - (1 << 63)


class Open:
    """An open element that matters: a block, a link, or one that is no text."""

    __slots__ = ("name", "node", "away", "header", "inside", "doubt", "block")

    def __init__(self, name: str, node: int, away: bool, header: bool, inside: bool, doubt: int, block: bool):
        self.name, self.node, self.away, self.header, self.inside, self.doubt, self.block = name, node, away, header, inside, doubt, block


class Page:
    """A page's part of the style tree. Nodes are in order of their start tags, so parents come first; node 0 is the root."""

    def __init__(self, html: bytes, host: str = ""):
        self.keys, self.parents, self.doubtful = [_key(host)], [-1], [False]
        self.children: list[list[str]] = [[]]
        self.blocks: list[tuple[str, int, int, bool, int]] = []  # text, characters of links in it, node, inside, doubt
        self.over: list[int] = []  # of each doubt, the one around it
        self._text: list[str] = []
        self._linked = self._links = 0
        self._stack = [Open("", 0, False, False, False, -1, True)]
        self._count: dict[str, int] = {}
        for t in scan(html, Context(strict=False)):
            if t.kind == "text":
                if not self._stack[-1].away:
                    self._say(t.text.decode("utf-8", "replace"))
            elif t.kind == "start_tag":
                self._start(t)
            elif t.kind == "end_tag":
                if self._count.get(t.name):
                    k = len(self._stack) - 1
                    while self._stack[k].name != t.name:
                        k -= 1
                    self._pop(k)
                elif t.name == "p":
                    self._flush()
        self._flush()

    def _say(self, part: str) -> None:
        part = unescape(part) if "&" in part else part
        self._text.append(part)
        if self._links:
            self._linked += len(part)

    def _flush(self) -> None:
        """The run of text ends; it belongs to the innermost block."""
        if self._text:
            said = " ".join("".join(self._text).split())
            top = self._stack[-1]
            if said and not top.away and (not top.header or top.name in HEADINGS):
                self.blocks.append((said, min(self._linked, len(said)), top.node, top.inside, top.doubt))
            self._text.clear()
        self._linked = 0

    def _pop(self, k: int) -> None:
        if any(o.block or o.away for o in self._stack[k:]):
            self._flush()
        for o in self._stack[k:]:
            self._count[o.name] -= 1
            self._links -= o.name == "a"
        del self._stack[k:]

    def _start(self, t) -> None:
        name = t.name
        if name == "br":
            self._say("\n")
            return
        if name in VOID or (t.ns != "html" and t.self_closing):
            if name == "hr":
                self._flush()
            return
        ends = CLOSES.get(name)
        if ends and any(self._count.get(e) for e in ends):
            for k in range(len(self._stack) - 1, 0, -1):
                if self._stack[k].name in ends:
                    self._pop(k)
                    break
                if self._stack[k].name in SCOPES:
                    break
        up = self._stack[-1]
        attributes: dict[str, str] = {}
        for a in t.attrs:
            attributes.setdefault(a.name, unescape(a.value) if "&" in a.value else a.value)
        header = up.header or name == "header"
        away = up.away or _says_away(name, attributes, up.inside) or (header and not up.inside)
        block = name in BLOCKS
        if not (block or away or name == "a"):
            return
        if block or away != up.away:
            self._flush()
        inside = up.inside or name in ("article", "main") or attributes.get("role", "").lower() == "main"
        node, doubt = up.node, up.doubt
        if block and not away:
            label = f"{name}.{'.'.join(sorted(attributes['class'].split()))}" if attributes.get("class") else name
            self.children[up.node].append(label)
            node = len(self.keys)
            doubtful = up.inside and _in_doubt(name, attributes)
            if doubtful:
                self.over.append(doubt)
                doubt = len(self.over) - 1
            self.keys.append(_key(f"{self.keys[up.node]} {label}")), self.parents.append(up.node), self.children.append([]), self.doubtful.append(doubtful)
        self._stack.append(Open(name, node, away, header, inside, doubt, block))
        self._count[name] = self._count.get(name, 0) + 1
        self._links += name == "a"

    def candidates(self) -> list[tuple[str, int]]:
        """(text, node) of what can become main text."""
        found = [b for b in self.blocks if b[3]]
        if not found:
            return [(b[0], b[2]) for b in self.blocks if 2 * b[1] <= len(b[0])]
        sizes = [[0, 0] for _ in self.over]
        for said, linked, _, _, d in found:
            if d >= 0:
                sizes[d][0] += len(said)
                sizes[d][1] += linked
        for d in range(len(sizes) - 1, -1, -1):
            if self.over[d] >= 0:
                sizes[self.over[d]][0] += sizes[d][0]
                sizes[self.over[d]][1] += sizes[d][1]
        dense: list[bool] = []
        for d, (n, linked) in enumerate(sizes):
            dense.append(2 * linked > n or (self.over[d] >= 0 and dense[self.over[d]]))
        return [(b[0], b[2]) for b in found if b[4] < 0 or not dense[b[4]]]

    def tree(self) -> tuple[list[str], list[int], list[int], list[int], list[bool], list[int], list[int]]:
        """(texts, their nodes, nodes' keys, parents, doubts, presentation keys, content keys), nodes without text left out."""
        texts = self.candidates()
        used = {0}
        for _, n in texts:
            while n not in used:
                used.add(n)
                n = self.parents[n]
        place = {n: k for k, n in enumerate(sorted(used))}
        keys = [self.keys[n] for n in place]
        styles: dict[int, list[str]] = {}
        for n in place:
            styles.setdefault(self.keys[n], []).append(" ".join(self.children[n]))
        shown = {key: _key(f"{key} style {'|'.join(s)}") for key, s in styles.items()}
        at = [place[n] for _, n in texts]
        return (
            [x for x, _ in texts], at, keys, [place.get(self.parents[n], -1) for n in place], [self.doubtful[n] for n in place],
            [shown[k] for k in keys], [_key(f"{keys[n]} text {x}") for (x, _), n in zip(texts, at, strict=True)],
        )


def kept_texts(texts: list[str], at: list[int], keys: list[int], parents: list[int], doubts: list[bool], contents: list[int], importance: dict) -> list[str]:
    """The content nodes that stay. ``importance``: (presentation, content) by node key, and importance by content key; 1 if absent."""
    if not importance:
        return texts
    n = len(keys)
    sums, counts, own = [0.0] * n, [0] * n, [0] * n
    for k in at:
        own[k] += 1
    most, composite = [0.0] * n, [0.0] * n  # the largest composite importance in a branch; the element's own
    for k in range(n - 1, -1, -1):
        shown, said = importance.get(keys[k], (1.0, 1.0))
        if own[k]:
            sums[k], counts[k], most[k] = sums[k] + said, counts[k] + 1, max(most[k], said)
        if counts[k] == 1 and own[k]:
            composite[k] = said  # a leaf
        elif counts[k]:
            rest = DECAY ** counts[k]
            composite[k] = (1 - rest) * shown + rest * sums[k] / counts[k]
        most[k] = max(most[k], composite[k])
        if parents[k] >= 0:
            p = parents[k]
            sums[p], counts[p], most[p] = sums[p] + composite[k], counts[p] + 1, max(most[p], most[k])
    cut = [False] * n
    for k in range(n):
        cut[k] = most[k] < LOW or (doubts[k] and composite[k] < DOUBT) or (parents[k] >= 0 and cut[parents[k]])
    kept = [x for x, k, c in zip(texts, at, contents, strict=True) if not cut[k] and importance.get(c, 1.0) >= LOW]
    return kept or texts


def main_text(html: str, importance: dict | None = None) -> str:
    """The main text of a page without (or with given) importances of its site."""
    texts, at, keys, parents, doubts, _, contents = Page(html.encode("utf-8", "replace")).tree()
    return " ".join(kept_texts(texts, at, keys, parents, doubts, contents, importance or {}))


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].lower()


_LISTS = (("texts", pa.string()), ("at", pa.int32()), ("keys", pa.int64()), ("parents", pa.int32()), ("doubts", pa.bool_()), ("styles", pa.int64()), ("contents", pa.int64()))
_PARSED = "id {0}, url string, page long, texts array<string>, at array<int>, keys array<long>, parents array<int>, doubts array<boolean>, styles array<long>, contents array<long>"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, trees = [], []
        for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = (html or "").encode("utf-8", "replace")
            pages.append(int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True))
            trees.append(Page(data, host_of(url)).tree())
        cols = list(zip(*trees, strict=True)) if trees else [[]] * len(_LISTS)
        lists = [pa.array(c, pa.list_(kind)) for c, (_, kind) in zip(cols, _LISTS, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pages, pa.int64()), *lists], ["id", "url", "page", *(n for n, _ in _LISTS)])


def parse(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The pages' parts of their sites' style trees, a row for each row."""
    kind = df.schema[id_col].dataType.simpleString()
    pages = df.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return pages.mapInArrow(_parse, _PARSED.format(kind)).withColumn("row", F.monotonically_increasing_id())


def importance(parsed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(key, presentation, content) of element nodes and (key, content) of content nodes below LOW, from pages by ``parse``."""
    pairs = lambda kind, keys, digests: F.transform(F.arrays_zip(keys.alias("a"), digests.alias("b")), lambda x: F.struct(F.lit(kind).alias("kind"), x["a"].alias("key"), x["b"].alias("digest")))
    owners = F.transform("at", lambda k: F.get("keys", k))
    each = parsed.select("page", F.explode(F.array_distinct(F.concat(pairs(0, F.col("keys"), F.col("styles")), pairs(1, owners, F.col("contents"))))).alias("x"))
    counts = each.select("page", "x.*").distinct().groupBy("kind", "key", "digest").agg(F.count("*").alias("k"))
    counts = scratch.write(counts, "counts")
    # every page has one presentation of a path that it has, so those sum up to the path's pages
    sums = counts.groupBy("key").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("k"))).alias("m"),
        F.sum(F.when(F.col("kind") == 0, F.col("k") * F.log("k"))).alias("s0"),
        F.sum(F.when(F.col("kind") == 1, F.col("k"))).alias("n1"),
        F.sum(F.when(F.col("kind") == 1, F.col("k") * F.log("k"))).alias("s1"),
    ).filter("m > 1")
    share = lambda s, n: F.coalesce(1 - F.col(s) / (F.col(n) * F.log(F.col("m") + PRIOR)), F.lit(1.0))
    nodes = sums.select("key", "m", share("s0", "m").alias("presentation"), share("s1", "n1").alias("content"))
    often = counts.filter((F.col("kind") == 1) & (F.col("k") > 1)).select("key", "digest", "k")
    met = salted_join(often, scratch.write(nodes.select("key", "m"), "sizes"), "key", "digest", scratch)
    low = met.select(F.col("digest").alias("key"), (1 - F.log("k") / F.log(F.col("m") + PRIOR)).alias("content")).filter(F.col("content") < LOW)
    return nodes.filter((F.col("presentation") < 0.95) | (F.col("content") < 0.95)).select("key", "presentation", "content"), low


def _texts(everywhere: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(2, len(batch.columns))), strict=True):
                known = everywhere
                if known is None:
                    known = {k: (a, b) if a is not None else b for k, a, b in zip(*row[-3:], strict=True)} if row[-3] else {}
                out.append(" ".join(kept_texts(*row[:6], known)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    return run


def extract(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", broadcast: int = BROADCAST, scratch: Scratch | None = None) -> DataFrame:
    """id, url, text, n_chars of each page. At most ``broadcast`` importances are sent to all workers."""
    spark, scratch = df.sparkSession, scratch or Scratch(df.sparkSession, "html")
    kind = df.schema[id_col].dataType.simpleString()
    pages = scratch.write(parse(df, id_col, url, html), "pages")
    nodes, low = importance(pages, scratch)
    known = scratch.write(nodes.unionByName(low.withColumn("presentation", F.lit(None).cast("double"))), "importance")
    needed, made = ("id", "url", "texts", "at", "keys", "parents", "doubts", "contents"), f"id {kind}, url string, text string"
    if known.count() <= broadcast:
        found = {r["key"]: (r["presentation"], r["content"]) if r["presentation"] is not None else r["content"] for r in known.collect()}
        shared = spark.sparkContext.broadcast(found)
        texts = pages.select(*needed).mapInArrow(lambda b: _texts(shared.value)(b), made)
    else:
        asked = scratch.write(pages.select("row", F.explode(F.array_distinct(F.concat("keys", "contents"))).alias("key")), "asked")
        own = salted_join(asked, known, "key", "row", scratch).groupBy("row").agg(F.collect_list(F.struct("key", "presentation", "content")).alias("x"))
        own = own.select("row", *(F.col(f"x.{c}").alias(f"k_{c}") for c in ("key", "presentation", "content")))
        texts = pages.join(own, "row", "left").select(*needed, "k_key", "k_presentation", "k_content").mapInArrow(_texts(None), made)
    return texts.select(F.col("id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"))
