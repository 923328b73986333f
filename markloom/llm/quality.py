"""Quality rules: a threshold table compiled into one projection.

Every rule is a named measure with a lower and an upper bound. The measures are built-in functions over the words and
lines of the whole text, so the plan is a scan, projections and nothing else: no shuffle, no user functions.

Repeated five-word windows are looked for by their 64-bit hashes; only windows whose hash occurs again are compared as
words, so equal hashes of different windows change nothing and memory stays near the text's own size.

Defined cases: a null text counts as empty; an empty text has no words and fails the base rule; extra columns pass
through, whatever their names (they travel in one struct beside the working columns); repeated rows are judged alike; an empty table gives an empty result. A ratio whose denominator is 0 is null and breaks no rule.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Frequent function words of the supported languages (fixed values).
STOP_WORDS = (
    "the of and to a in is that it for was on are with be by this from or as an at not "
    "de la le les et des un une du en que qui dans est pour par sur au avec ce il "
    "der die das und ist von den dem mit zu ein eine sich auf für als im nicht auch es "
    "el los las y se del al por con para su una lo más no"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``; None leaves a side open. Measures are per word unless said otherwise.

    With ``least_words``, only texts of so many words that also break a rule of WEAK can break it.
    """

    measure: str
    low: float | None = None
    high: float | None = None
    least_words: int = 0


#: The threshold table.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=2, high=15),
    Rule("symbol_ratio", high=0.25),  # characters of [#*$%&|<>] to words
    Rule("shout_ratio", high=0.3),  # words that end in at least two of ! and ?
    Rule("letter_word_ratio", low=0.6),  # words with a letter
    Rule("stop_word_ratio", low=0.01),
    Rule("dup_line_ratio", high=0.7),  # to lines with a word
    Rule("bullet_line_ratio", high=0.9),  # lines that start with a bullet, to lines with a word
    Rule("ellipsis_line_ratio", high=0.5),  # lines that end in an ellipsis, to lines with a word
    Rule("longest_word_chars", high=1000),
)
#: Weak signals: these alone reject nothing.
WEAK = (
    Rule("mean_word_chars", low=3, high=10),
    Rule("symbol_ratio", high=0.1),
    Rule("shout_ratio", high=0.1),
    Rule("letter_word_ratio", low=0.8),
    Rule("dup_line_ratio", high=0.3),
    Rule("bullet_line_ratio", high=0.5),
    Rule("ellipsis_line_ratio", high=0.25),
)
#: The rules of the pipeline. A ratio of 0.01 says something from 100 words on, and a lack of listed words also means another language.
KEEP_RULES = tuple(replace(r, least_words=100) if r.measure == "stop_word_ratio" else r for r in RULES)
WINDOW = 5
P = "__quality_"


def _repeat_words(w: Column, n: Column) -> list[tuple[str, Column]]:
    """Steps that count the words inside windows of WINDOW words found at least twice."""
    c = lambda name: F.col(P + name)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))
    by_hash = F.array_sort(F.transform(c("hashes"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    near = lambda x, k: F.get(c("by_hash"), k)["h"] == x["h"]
    again = F.filter(c("by_hash"), lambda x, k: F.coalesce(near(x, k + 1), F.lit(False)) | ((k > 0) & near(x, F.greatest(k - 1, F.lit(0)))))
    placed = F.array_sort(F.transform(again, lambda x: F.struct(F.concat_ws(" ", F.slice(w, x["i"] + 1, WINDOW)).alias("x"), (x["i"] + 1).alias("i"))))
    last = F.size(c("placed")) - 1
    at = lambda k: F.get(c("placed"), k)["x"]
    starts = F.array_sort(
        F.transform(
            F.filter(
                F.sequence(F.lit(0), last),
                lambda k: ((k > 0) & (at(k) == at(k - 1))) | ((k < last) & (at(k) == at(k + 1))),
            ),
            lambda k: F.get(c("placed"), k)["i"],
        )
    )
    covered = F.aggregate(
        c("starts"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, s: F.struct((s + WINDOW).alias("end"), (a["n"] + s + WINDOW - F.greatest(a["end"], s)).alias("n")),
    )["n"]
    return [
        ("hashes", F.when(n >= WINDOW, hashes)),
        ("by_hash", F.when(F.size(F.array_distinct(c("hashes"))) < F.size(c("hashes")), by_hash)),
        ("placed", F.when(c("by_hash").isNotNull(), placed)),
        ("starts", F.when(c("placed").isNotNull(), starts)),
        ("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")),
    ]


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base counts and the measures, in columns whose names start with ``__quality_``."""
    c = lambda name: F.col(P + name)
    ratio = lambda a, b: F.when(b > 0, a / b)
    count = lambda x, f: F.size(F.filter(x, f)).cast("long")
    w, n, t = c("words"), c("n"), F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(P + "words", words(F.col(text)))
    df = df.withColumns({P + "n": F.size(w), P + "lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    for name, col in _repeat_words(w, n):
        df = df.withColumn(P + name, col)
    n_lines = F.size(c("lines")).cast("long")
    df = df.withColumns(
        {
            P + "n_words": n.cast("long"),
            P + "word_chars": F.length(F.array_join(w, "")).cast("long"),
            P + "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            P + "n_lines": n_lines,
            P + "n_dup_lines": n_lines - F.size(F.array_distinct(c("lines"))),
            P + "n_shout": count(w, lambda x: x.rlike(r"[!?][!?]$")),
            P + "n_letter_words": count(w, lambda x: x.rlike(r"\p{L}")),
            P + "n_stop": count(w, lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS))),
            P + "n_bullets": count(c("lines"), lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•‣●]")),
            P + "n_ellipsis": count(c("lines"), lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")),
            P + "longest_word_chars": F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).cast("long"),
        }
    )
    return df.withColumns(
        {
            P + "mean_word_chars": ratio(c("word_chars"), c("n_words")),
            P + "symbol_ratio": ratio(c("n_symbols"), c("n_words")),
            P + "shout_ratio": ratio(c("n_shout"), c("n_words")),
            P + "letter_word_ratio": ratio(c("n_letter_words"), c("n_words")),
            P + "stop_word_ratio": ratio(c("n_stop"), c("n_words")),
            P + "dup_line_ratio": ratio(c("n_dup_lines"), c("n_lines")),
            P + "bullet_line_ratio": ratio(c("n_bullets"), c("n_lines")),
            P + "ellipsis_line_ratio": ratio(c("n_ellipsis"), c("n_lines")),
        }
    )


def _breaks(r: Rule) -> Column:
    m, bad = F.col(P + r.measure), F.lit(False)
    if r.low is not None:
        bad = bad | (m < r.low)
    if r.high is not None:
        bad = bad | (m > r.high)
    return bad


def verdict(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(base_failed, names of the broken rules) over the columns of :func:`measured`."""
    base = (F.col(P + "n_words") < 10) | (100 * F.col(P + "n_repeat_words") > 20 * F.col(P + "n_words"))
    weak = F.lit(False)
    for r in WEAK:
        weak = weak | F.coalesce(_breaks(r), F.lit(False))
    broken = []
    for r in rules:
        bad = _breaks(r)
        if r.least_words:
            bad = bad & (F.col(P + "n_words") >= r.least_words) & weak
        broken.append(F.when(bad, F.lit(r.measure)))
    return base, F.array_compact(F.array(*broken))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(df: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: id, the base counts, ``base_failed``, ``kept`` and ``broken_rules`` (names of the rules it breaks)."""
    base, broken = verdict(rules)
    return (
        measured(df.select(F.col(id_col).alias(P + "id"), F.col(text).alias(P + "text")), P + "text")
        .withColumns({P + "base": base, P + "broken": broken, P + "row": F.monotonically_increasing_id()})
        .select(
            F.col(P + "id").alias(id_col),
            *(F.col(P + k).alias(k) for k in COUNTS),
            F.col(P + "base").alias("base_failed"),
            ((F.col(P + "row") >= 0) & ~F.col(P + "base") & (F.size(P + "broken") == 0)).alias("kept"),
            F.array_join(P + "broken", ",").alias("broken_rules"),
        )
    )


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = KEEP_RULES) -> DataFrame:
    """The rows of ``df`` that pass, with their own columns only."""
    base, broken = verdict(rules)
    rows = df.select(F.struct(*(F.col(f"`{x}`") for x in df.columns)).alias(P + "in"), F.col(f"`{text}`").alias(P + "text"))
    # the id, being nondeterministic and used, keeps the filter above the projections: pushed down, it would repeat their work per word
    out = measured(rows, P + "text").withColumns({P + "base": base, P + "broken": broken, P + "row": F.monotonically_increasing_id()})
    return out.filter((F.col(P + "row") >= 0) & ~F.col(P + "base") & (F.size(P + "broken") == 0)).select(P + "in.*")
