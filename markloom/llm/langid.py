"""Language identification by cross-parsing entropy.

Training, on the driver: a bounded sample of labelled texts per language (ROWS rows, of each PIECE_CHARS characters at a
place drawn from the whole text; a rare language's sample is shorter and shortens no other one) becomes a suffix automaton.
Greedy cross-parsing walks it from the root as long as the text goes on matching; where it doesn't, one phrase ends and
the next begins. So each phrase is the longest match from its start. The language that needs the fewest phrases, times the
logarithm of the places a phrase can name (its sample's characters and all letters), wins.

Transitions are sparse: the rows of all states are laid over each other in one array, so that a state's transition by a
letter is at its offset plus the letter's code, if that cell is the state's (row displacement). So a model's size follows
its sample, not its alphabet, and all letters of the samples are known. All languages that are labelled are learned: above
TOTAL_CHARS characters in all, every language gets the same smaller number of rows, so the model that is broadcast stays
below about 40 * TOTAL_CHARS bytes. More than LANGUAGES different labels raise ValueError: they are no languages.

Prediction, on the executors: whole texts as letters and single spaces, many texts and all languages side by side with
array operations, one character a step; texts follow each other in lanes of equal length, and very long ones go alone.
Nothing but the text is used.

The pipeline keeps texts that cost at most MARGIN times the bits a character that all but the costliest pieces of their
language's sample cost, by a model of its other half. So texts of no learned language go; all stay where none was learned.

Defined cases: a null text, or one without letters, is ``und`` with score 0. Ties go to the first language in order.
Rows with a null language, and those that the caller holds out, aren't learned from. Without any labelled row all
results are ``und``. Other columns are ignored; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released

ROWS, PIECE_CHARS, TOTAL_CHARS, LANGUAGES = 120, 1000, 12_000_000, 10_000
UNKNOWN = "und"
#: Calibration: characters of a piece, the share of pieces taken as typical, what a text may cost as a multiple of those.
PIECE, TYPICAL, MARGIN = 100, 0.95, 2.0
OTHER, BLANK = 1, 2
#: A transition's count of phrases that end stands above its state; the state that owns a cell above that.
COUNT, OWNER = 29, 32
_STATE = (1 << COUNT) - 1
#: Texts and characters of a slice, about; lanes times languages at most; where a text would have fewer, it is parsed alone.
SLICE, SLICE_CHARS, LANES, FEW = 4000, 8_000_000, 16_384, 100


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        cur = len(moves)
        moves.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return moves


@lru_cache(1)
def _classes() -> np.ndarray:
    """OTHER for letters, BLANK for the rest, by code point."""
    return np.fromiter((OTHER if chr(i).isalpha() else BLANK for i in range(0x110000)), np.uint8, 0x110000)


def displaced(moves: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, cells, root): transitions laid over each other. ``cells[base[s] + c]`` is s's if its owner is s.

    A value is a state and, above it, the number of phrases that end on the way there. ``root`` has the values by which a
    phrase starts anew with a letter, for states that don't go on with it; the root's own row is complete.
    """
    root = np.full(width, 2 << COUNT, np.int64)  # a letter that the sample lacks is a phrase by itself
    own = {c: to for c, to in moves[0].items() if c >= 0}
    for c, to in own.items():
        root[c] = to | 1 << COUNT
    size = width + sum(map(len, moves)) + 1
    used = bytearray(2 * size + width)
    base = [0] * len(moves)
    used[:width] = b"\1" * width
    placed: list[tuple[int, int, int]] = []
    top, hint, lowest = width, 0, 0
    for s in sorted((s for s in range(1, len(moves)) if moves[s]), key=lambda s: -len(moves[s])):
        row = [(c, to) for c, to in moves[s].items() if c >= 0]
        if not row:
            continue
        low = min(row)[0]
        at, tries = used.find(0, max(hint if len(row) > 1 else lowest, low)), 0
        while True:
            if at < 0 or at + width >= len(used):
                used.extend(bytes(size))
            if at >= 0 and not any(used[at - low + c] for c, _ in row):
                break
            at, tries = used.find(0, max(at, hint) + 1), tries + 1
            if tries > 50:  # what lies before is left to states of one transition
                hint = at
        if len(row) == 1:
            lowest = max(lowest, at - width)
        base[s] = at - low
        for c, to in row:
            used[at - low + c] = 1
            placed.append((at - low + c, s, to))
            top = max(top, at - low + c + 1)
    cells = np.full(top + width, -1 << OWNER, np.int64)
    cells[:width] = np.where(root >> COUNT == 1, root & _STATE, 1 << COUNT)  # owned by the root, where no phrase is open
    for at, s, to in placed:
        cells[at] = s << OWNER | to
    return np.array(base, np.int64), cells, root


@dataclass
class Model:
    languages: list[str]
    alphabet: str
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(repr=False)  # per language, by displaced()
    logs: list[float] = field(default_factory=list)
    limits: list[float] = field(default_factory=list)  # bits a character, by limit()

    def codes(self, text: str) -> np.ndarray:
        """Codes of the lower-cased text's characters, runs of BLANK as one."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        c = self.lookup[points]
        blank = c == BLANK
        if len(c) > 1:
            c = c[~np.concatenate(([False], blank[1:] & blank[:-1]))]
        return c

    @property
    def lookup(self) -> np.ndarray:
        found = self.__dict__.get("_lookup")
        if found is None:
            found = _classes().astype(np.uint16 if len(self.alphabet) < 65_000 else np.int32)
            for k, ch in enumerate(self.alphabet):
                found[ord(ch)] = 3 + k
            self.__dict__["_lookup"] = found
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    @property
    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All languages' tables as one: base and cells with shifted offsets, roots by language, first state by language."""
        found = self.__dict__.get("_joined")
        if found is None:
            sizes = np.cumsum([0] + [len(c) for _, c, _ in self.tables])
            firsts = np.cumsum([0] + [len(b) for b, _, _ in self.tables])
            base = np.concatenate([b + at for (b, _, _), at in zip(self.tables, sizes, strict=False)])
            found = self.__dict__["_joined"] = (base, np.concatenate([c for _, c, _ in self.tables]), np.stack([r for _, _, r in self.tables]), firsts[:-1])
        return found

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (rows) by each language (columns)."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        order = sorted((k for k in range(len(texts)) if len(texts[k])), key=lambda k: -len(texts[k]))
        left = sum(len(texts[k]) for k in order)
        while order and left // len(texts[order[0]]) * len(self.languages) < FEW:  # too long to have others beside it
            k = order.pop(0)
            left -= len(texts[k])
            out[k] = self._alone(texts[k])
        if order:
            out[order] = self._side_by_side([texts[k] for k in order])
        return out

    def _alone(self, text: np.ndarray) -> list[int]:
        found, letters = [], text.tolist()
        for base, cells, root in self.tables:
            base, cells, root = memoryview(base), memoryview(cells), memoryview(root)
            state = count = 0
            for c in letters:
                cell = cells[base[state] + c]
                got = cell & 0xFFFFFFFF if cell >> OWNER == state else root[c]
                count += got >> COUNT
                state = got & _STATE
            found.append(count + (state > 0))
        return found

    def _side_by_side(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of texts (rows, from the longest to the shortest) by language (columns).

        Lanes of about equal length hold one text after another, each with OTHER behind it: a letter that no sample has
        ends the open phrase and is one itself, so the next text starts at the root, and counts read there are one too high.
        """
        base, cells, root, first = self.joined
        n, total = len(first), sum(map(len, texts))
        lanes = max(1, min(len(texts), LANES // n, total // len(texts[0])))
        fill = [(0, k) for k in range(lanes)]
        spots = []
        for t in texts:
            length, lane = fill[0]
            spots.append((lane, length))
            heapq.heapreplace(fill, (length + len(t) + 1, lane))
        letters = np.full((max(fill)[0], lanes), OTHER, texts[0].dtype)
        ends: dict[int, list[tuple[int, int]]] = {}
        for k, (t, (lane, at)) in enumerate(zip(texts, spots, strict=True)):
            letters[at : at + len(t), lane] = t
            ends.setdefault(at + len(t), []).append((k, lane))
        width, shape = root.shape[1], (n, lanes)
        root = root.ravel()
        rows = np.arange(n)[:, None] * width
        first = np.broadcast_to(first[:, None], shape).copy()
        state, count, begun = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros((lanes, n), np.int64)
        place, cell, owner, new, hit = np.empty(shape, np.int64), np.empty(shape, np.int64), np.empty(shape, np.int64), np.empty(shape, np.int64), np.empty(shape, bool)
        out = np.zeros((len(texts), n), np.int64)
        for step in range(len(letters)):
            c = letters[step]
            np.add(state, first, out=place)
            base.take(place, out=new, mode="clip")
            np.add(new, c, out=place)
            cells.take(place, out=cell, mode="clip")
            np.right_shift(cell, OWNER, out=owner)
            np.equal(owner, state, out=hit)
            np.bitwise_and(cell, 0xFFFFFFFF, out=cell)
            np.add(rows, c, out=place)
            root.take(place, out=new, mode="clip")
            np.copyto(new, cell, where=hit)
            np.right_shift(new, COUNT, out=owner)
            np.add(count, owner, out=count)
            np.bitwise_and(new, _STATE, out=state)
            for k, lane in ends.get(step, ()):
                out[k] = count[:, lane] - begun[lane] - 1
                begun[lane] = count[:, lane]
        return out

    def slices(self, texts: pa.Array) -> Iterator[list[str | None]]:
        """At most SLICE texts and about SLICE_CHARS characters at a time."""
        now, size = [], 0
        for t in texts:
            now.append(t.as_py())
            size += len(now[-1] or "")
            if len(now) >= SLICE or size >= SLICE_CHARS:
                yield now
                now, size = [], 0
        if now:
            yield now

    def predict_all(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        named, score = [], []
        for part in self.slices(texts):
            n, s = self.predict(part)
            named += n
            score += s
        return named, score

    def bits(self, texts: list[str | None]) -> np.ndarray:
        """Cost of each text (rows) by each language (columns), in bits a character."""
        codes = [self.codes(t or "") for t in texts]
        return self.phrases(codes) * np.array(self.logs) / np.array([[max(1, len(c))] for c in codes])

    def known(self, texts: pa.Array) -> tuple[list[bool], list[str]]:
        """Whether each text has a letter and costs no more than the limit of its cheapest language, and that language."""
        out, named = [], []
        for part in self.slices(texts):
            bits = self.bits(part)
            best = bits.argmin(axis=1)
            ok = bits[np.arange(len(part)), best] <= np.array(self.limits)[best]
            out += [bool(k) and any(map(str.isalpha, t or "")) for k, t in zip(ok, part, strict=True)]
            named += [self.languages[b] for b in best]
        return out, named

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes = [self.codes(t or "") for t in texts]
        lettered = [bool((c != BLANK).any()) for c in codes]
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cost = self.phrases(codes) * np.array(self.logs)
        best = cost.argmin(axis=1)
        rows = np.arange(len(texts))
        least = cost[rows, best]
        rest = cost.copy()
        rest[rows, best] = np.inf
        second = rest.min(axis=1)
        score = np.where(np.isinf(second), 1.0, (second - least) / np.where(np.isinf(second) | (second <= 0), 1.0, second))
        named = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return named, [float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)]


def fit(samples: dict[str, list[str]]) -> Model:
    """Texts per language to a model; languages in order."""
    blank = " "
    joined = {}
    for lang in sorted(samples):
        text = "\n".join("".join(ch if ch.isalpha() else blank for ch in t.lower()) for t in samples[lang])
        while blank * 2 in text:
            text = text.replace(blank * 2, blank)
        if any(ch.isalpha() for ch in text):
            joined[lang] = text
    alphabet = "".join(sorted({ch for t in joined.values() for ch in t if ch.isalpha()}))
    code = {ch: 3 + k for k, ch in enumerate(alphabet)} | {blank: BLANK}
    model = Model(list(joined), alphabet, [], [])
    for t in joined.values():
        # a line break, between texts, is a code that no text has
        model.tables.append(displaced(suffix_automaton([code.get(ch, -1) for ch in t]), 3 + len(alphabet)))
        # a phrase names a place in the sample or, unmatched, a letter: short samples don't get phrases for nothing
        model.logs.append(math.log2(max(2, len(t) + len(alphabet))))
    return model


def limit(texts: list[str]) -> float:
    """Bits a character that a language's texts may cost: each half of its sample is parsed by the other half's model."""
    if len(texts) < 2:
        half = (len(texts[0]) + 1) // 2
        texts = [texts[0][:half], texts[0][half:]]
    found: list[float] = []
    for k in range(2):
        model = fit({"": texts[k::2]})
        pieces = [t[i : i + PIECE] for t in texts[1 - k :: 2] for i in range(0, max(1, len(t) - PIECE // 2), PIECE)]
        pieces = [p for p in pieces if any(map(str.isalpha, p))]
        if not model.languages or not pieces:
            return math.inf
        found += model.bits(pieces)[:, 0].tolist()
    return MARGIN * float(np.quantile(found, TYPICAL))


def spark_shares(rows: DataFrame, lang: str, shares: dict[str, int]) -> DataFrame:
    """``rows`` with ``__share``, by language: a broadcast table of at most LANGUAGES rows."""
    table = rows.sparkSession.createDataFrame(list(shares.items()), "__lang string, __share long")
    return rows.join(F.broadcast(table), F.col(lang) == F.col("__lang"))


def train(df: DataFrame, learned: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id", limits: bool = False) -> Model:
    """Fit on at most ROWS rows a language among those for which ``learned`` holds; with ``limits``, calibrate them too."""
    rows = df.filter(learned & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(lang) != UNKNOWN))
    counts = rows.groupBy(F.col(lang).alias("k")).agg(F.approx_count_distinct(F.xxhash64(id_col, text)).alias("n")).limit(LANGUAGES + 1).collect()
    if not counts:
        return Model([], "", [], [])
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different labels in {lang}")
    each = max(1, min(ROWS, TOTAL_CHARS // PIECE_CHARS // len(counts)))
    million = 1_000_000
    shares = spark_shares(rows, lang, {r["k"]: math.ceil(min(1.0, 2 * (each + 20) / max(1, r["n"])) * million) for r in counts})
    drawn = shares.filter(F.pmod(F.xxhash64(F.col(id_col), F.col(text), F.lit(7)), F.lit(million)) < F.col("__share"))
    pieces = F.ceil(F.length(text) / PIECE_CHARS)
    start = F.pmod(F.xxhash64(F.col(id_col), F.col(text), F.lit(8)), F.greatest(pieces, F.lit(1))) * PIECE_CHARS + 1
    drawn = drawn.select(F.col(lang).alias("k"), F.xxhash64(id_col, text).alias("h"), F.substring(text, start, F.lit(PIECE_CHARS)).alias("t")).distinct()
    chosen = drawn.groupBy("k").agg(F.slice(F.array_sort(F.collect_list(F.struct("h", "t"))), 1, each).alias("x"))
    samples = {r["k"]: [x["t"] for x in r["x"]] for r in chosen.collect()}
    model = fit(samples)
    if limits:
        model.limits = [limit(samples[k]) for k in model.languages]
    return model


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred, score of each row."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # bounded by TOTAL_CHARS

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            named, score = shared.value.predict_all(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    out = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows that aren't learned from: every fifth by the checksum of the id's text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the rows not held out, predict all: id, held_out, lang_pred, score."""
    model = train(df, ~held_out(id_col), text, lang, id_col)
    return predict(df, model, id_col, text).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")


def keep_identified(df: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` whose text is in a language of the model (by its limits); all if there is none.

    Where ``lang`` is a null string column, kept rows get the predicted language; all else stays as it is.
    """
    if not model.languages:
        return df
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text)
    fill = df.columns.index(lang) if lang in df.columns and df.schema[lang].dataType.simpleString() == "string" else None

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            keep, named = shared.value.known(batch.column(at))
            if fill is not None:
                batch = batch.set_column(fill, batch.schema.field(fill), pc.coalesce(batch.column(fill), pa.array(named, batch.column(fill).type)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
