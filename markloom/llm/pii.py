"""Personal data: base patterns, plus candidates that boosted trees select.

Base spans are leftmost non-overlapping matches of one pattern a kind, with a check (octets, Luhn, number of digits).
Further generators of high recall propose spans that may overlap: numbers in phone-like groups, shorter cards, spelled-out
addresses, IPv6. For each, format and context features are computed, and boosted trees give a calibrated probability. They
are trained on the driver on ``pii_examples``; each kind's threshold is the best of LEVELS where every family of
examples is judged by trees that have not seen it. Candidates that touch a base span are out, however many there are; of those that
overlap each other, one stays if none that is likelier (or as likely and earlier) overlaps it. All of it is one projection
of built-in functions over the whole text: no shuffle and no user functions. Texts without a digit, @ or spelled-out "at"
skip the patterns.

Positions count code points, ends are exclusive. The patterns are written so that a run of characters is scanned once:
a match can start only where a run starts or where the last match ended.

Defined cases: null and empty texts have no spans. Repeated rows give repeated results. Other columns are ignored by
``find`` and kept by ``redact``, whatever their names: there they travel in one struct. An empty table gives an empty
result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .pii_examples import FOLDS, examples

KINDS = ("email", "ip", "card", "phone")
#: Thresholds are those of LEVELS with the best F measure in which precision weighs twice as much as recall.
LEVELS = tuple(t / 100 for t in range(50, 100))
P = "__pii_"
_RUN = r"(?:\G|(?<![A-Za-z0-9._%+-]))"
_DIGITS = r"(?:\G|(?<![0-9]))"
BASE = {
    "email": _RUN + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _DIGITS + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[{<]\x20?(?i:at)\x20?[)\]}>]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[{<]\x20?(?i:dot)\x20?[)\]}>])\x20?[A-Za-z0-9-]{1,63}+){1,5}+",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}+:){2,7}+:?[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.+-])(?:[0-9]{13,19}+|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{4,5}+|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,5}+(?:\)\x20?|[\x20.-])[0-9]{2,5}+(?:[\x20.-][0-9]{2,5}+){0,3}+(?![0-9A-Za-z]|[.,:/-][0-9])",
}
#: A candidate has at most 490 characters (the e-mail generator's bounds) and at least 5, and those of one kind don't
#: overlap. So a candidate overlaps at most 3 * (490 / 5 + 1) others, all of them within so many places by start.
NEAR = 300
#: Words that come before personal data (fixed values).
CONTEXT = {
    "phone": r"(?i)\b(tel|tél|phone|telephone|call|fax|mobile|cell|whatsapp|sms|telefon|téléphone|teléfono|anruf|handy|ring|appelez|llame)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|pay|payment|karte|carte|tarjeta)\b",
    "email": r"(?i)\b(mail|email|e-mail|contact|write|correo|courriel|schreib)\b",
    "ip": r"(?i)\b(ip|ipv6|address|host|server|adresse|dirección|ping|from)\b",
    "other": r"(?i)\b(order|isbn|version|page|date|no|invoice|article|id|part|serial|figure|table|year|rechnung|seite|numéro|número|bestellung)\b",
}
FEATURES = ("size", "digits", "letters", "groups", "luhn", "grouped", "zero", "kinds_of_digit", "says", "other", "spelled", "first", "last")


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn test."""
    at = f"cast(substr({digits}, length({digits}) - i, 1) as int)"
    twice = f"CASE WHEN i % 2 = 0 THEN {at} WHEN {at} > 4 THEN 2 * {at} - 9 ELSE 2 * {at} END"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (a, i) -> a + {twice}) % 10 = 0"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _check(kind: str) -> str:
    """SQL over a match ``m``."""
    if kind == "ip":
        return r"forall(split(m, '[.]'), x -> length(ltrim('0', x)) <= 3 AND cast(concat('0', right(ltrim('0', x), 3)) as int) <= 255)"
    if kind == "card":
        return f"length({_digits('m')}) BETWEEN 16 AND 19 AND {_luhn(_digits('m'))}"
    if kind == "phone":
        return f"length({_digits('m')}) BETWEEN 8 AND 15"
    return "true"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _placed(df: DataFrame, name: str, pattern: str, guard: str) -> DataFrame:
    """Adds ``name``: array of (start, end, m) of the pattern's matches in the text, in order."""
    t, q = f"{P}text", _quoted(pattern)
    df = df.withColumn(f"{name}_m", F.expr(f"CASE WHEN {guard} THEN regexp_extract_all({t}, {q}, 0) ELSE array() END"))
    # each match's length with that of the gap before it; starts are sums of these, by blocks so that many matches stay cheap
    df = df.withColumn(f"{name}_g", F.expr(f"CASE WHEN size({name}_m) > 0 THEN transform(split({t}, {q}, -1), x -> length(x)) ELSE array() END"))
    df = df.withColumn(f"{name}_l", F.expr(f"transform({name}_m, (m, i) -> get({name}_g, i) + length(m))"))
    sums = f"transform(sequence(0, (size({name}_l) - 1) div 256), b -> aggregate(slice({name}_l, 256 * b + 1, 256), 0, (a, x) -> a + x))"
    df = df.withColumn(f"{name}_b", F.expr(f"CASE WHEN size({name}_l) > 0 THEN {sums} ELSE array() END"))
    df = df.withColumn(f"{name}_s", F.expr(f"transform({name}_b, (x, b) -> aggregate(slice({name}_b, 1, b), 0, (a, y) -> a + y))"))
    end = f"get({name}_s, i div 256) + aggregate(slice({name}_l, 256 * (i div 256) + 1, i % 256 + 1), 0, (a, x) -> a + x)"
    spans = f"transform(transform({name}_m, (m, i) -> named_struct('m', m, 'end', {end})), x -> named_struct('start', x.end - length(x.m), 'end', x.end, 'm', x.m))"
    return df.withColumn(name, F.expr(spans)).drop(*(f"{name}_{k}" for k in "mglbs"))


def _features(kind: str) -> str:
    """SQL over a candidate ``c``: its span with the features."""
    m, d = "c.m", _digits("c.m")
    before = f"CASE WHEN c.start > 0 THEN substring({P}text, greatest(1, c.start - 29), least(c.start, 30)) ELSE '' END"
    values = {
        "size": f"length({m})",
        "digits": f"length({d})",
        "letters": rf"length(regexp_replace({m}, '[^A-Za-z]', ''))",
        "groups": rf"size(split({m}, '[^0-9A-Za-z]+'))",
        "luhn": f"CASE WHEN length({d}) > 0 AND {_luhn(d)} THEN 1 ELSE 0 END",
        "grouped": rf"CASE WHEN {m} RLIKE '^\\(?[0-9]{{3}}\\)?[ .-]{{1,2}}[0-9]{{3}}[ .-][0-9]{{4}}$' THEN 1 ELSE 0 END",
        "zero": f"CASE WHEN {d} LIKE '0%' THEN 1 ELSE 0 END",
        "kinds_of_digit": f"size(array_distinct(split({d}, '')))",
        "says": f"CASE WHEN {before} RLIKE {_quoted(CONTEXT[kind])} THEN 1 ELSE 0 END",
        "other": f"CASE WHEN {before} RLIKE {_quoted(CONTEXT['other'])} THEN 1 ELSE 0 END",
        "first": rf"length(regexp_extract({m}, '^[^0-9A-Za-z]*([0-9A-Za-z]*)', 1))",
        "last": rf"length(regexp_extract({m}, '([0-9A-Za-z]*)$', 1))",
        "spelled": rf"CASE WHEN {m} RLIKE '(?i)dot' THEN 1 ELSE 0 END",
    }
    fields = ", ".join(f"'{k}', cast({v} as double)" for k, v in values.items())
    return f"named_struct('start', c.start, 'end', c.end, {fields})"


def _measure(kind: str, before: str, m: str) -> dict[str, float]:
    """The features of :func:`_features`, for training."""
    import re

    d = re.sub(r"[^0-9]", "", m)
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d[::-1]))
    values = (
        len(m), len(d), len(re.sub(r"[^A-Za-z]", "", m)), len(re.split(r"[^0-9A-Za-z]+", m)), bool(d) and total % 10 == 0,
        bool(re.match(r"^\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$", m)), d[:1] == "0", len(set(d)) if d else 1,
        bool(re.search(CONTEXT[kind], before)), bool(re.search(CONTEXT["other"], before)), bool(re.search("(?i)dot", m)),
        len(re.match("[^0-9A-Za-z]*([0-9A-Za-z]*)", m)[1]), len(re.search("[0-9A-Za-z]*$", m)[0]),
    )
    return dict(zip(FEATURES, map(float, values), strict=True))


def measured(rows: list[tuple[str, str, int, int]], kind: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Features, labels and folds of examples."""
    found = [_measure(kind, before, m) for before, m, *_ in rows]
    return {f: np.array([v[f] for v in found]) for f in FEATURES}, np.array([r[2] for r in rows], float), np.array([r[3] for r in rows])


def unseen(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(probability, label) of all examples, each by trees that were trained without its family's fold."""
    x, y, fold = measured(examples(kind), kind)
    p = np.zeros(len(y))
    for k in range(FOLDS):
        own = fold == k
        p[own] = boosting.fit({f: v[~own] for f, v in x.items()}, y[~own]).probability({f: v[own] for f, v in x.items()})
    return p, y


@lru_cache(8)
def model(kind: str) -> tuple[boosting.Model, float]:
    """The trees of a kind, trained on all families, and its threshold."""
    x, y, _ = measured(examples(kind), kind)
    p, label = unseen(kind)
    score = [1.25 * label[p >= t].sum() / (0.25 * label.sum() + (p >= t).sum()) for t in LEVELS]
    return boosting.fit(x, y), LEVELS[int(np.argmax(score))]


_STRIDE = 64


def _reach(spans: str, value: str, after: bool = False) -> str:
    """SQL: for each of ``spans``, the largest ``value`` (over y) of those before it, or the least of those after it.

    Extremes of blocks of _STRIDE spans, then of the blocks before (after) each block, keep it far from quadratic.
    """
    least, pick, none = ("array_min", "least", "2147483647") if after else ("array_max", "greatest", "0")
    of = lambda part: f"coalesce({least}(transform({part}, y -> {value})), {none})"
    n = f"size({spans})"
    blocks = f"transform(sequence(0, ({n} - 1) div {_STRIDE}), b -> {of(f'slice({spans}, {_STRIDE} * b + 1, {_STRIDE})')})"
    rest = "slice(bs, b + 2, size(bs))" if after else "slice(bs, 1, b)"
    whole = f"transform(array({blocks}), bs -> transform(bs, (x, b) -> coalesce({least}({rest}), {none})))[0]"
    within = f"slice({spans}, i + 2, {_STRIDE} * (i div {_STRIDE} + 1) - i - 1)" if after else f"slice({spans}, {_STRIDE} * (i div {_STRIDE}) + 1, i % {_STRIDE})"
    each = f"transform(array({whole}), ws -> transform({spans}, (x, i) -> {pick}(ws[i div {_STRIDE}], {of(within)})))[0]"
    return f"CASE WHEN {n} > 0 THEN {each} ELSE array() END"


def spotted(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """``df``, which has ``__pii_text``, with ``__pii_base`` and ``__pii_all``: arrays of (kind number, start, end), in order."""
    df = df.withColumn(f"{P}any", F.expr(rf"{P}text RLIKE '[0-9@]|[(\\[{{<] ?(?i:at) ?[)\\]}}>]'"))
    base, more = [], []
    for k, kind in enumerate(KINDS):
        df = _placed(df, f"{P}b_{kind}", BASE[kind], f"{P}any")
        good = f"filter({P}b_{kind}, x -> exists(array(x.m), m -> {_check(kind)}))"
        base.append(f"transform({good}, x -> named_struct('start', x.start, 'end', x.end, 'k', {k}, 'p', 2D))")
        df = _placed(df, f"{P}c_{kind}", GENERATORS[kind], f"{P}any")
        df = df.withColumn(f"{P}f_{kind}", F.expr(f"transform({P}c_{kind}, c -> {_features(kind)})"))
        trees, least = model(kind)
        chosen = f"filter(transform({P}f_{kind}, f -> named_struct('start', f.start, 'end', f.end, 'k', {k}, 'p', {trees.sql('f')})), x -> x.p >= {least if threshold is None else threshold}D)"
        more.append(chosen)
    df = df.withColumn(f"{P}base0", F.expr(f"concat({', '.join(base)})")).withColumn(f"{P}more", F.expr(f"concat({', '.join(more)})"))
    df = df.withColumn(f"{P}sorted", F.expr(f"CASE WHEN size({P}more) > 0 THEN array_sort(concat({P}base0, {P}more)) ELSE array() END"))
    # how far base spans before each one reach, and where the next base span starts
    df = df.withColumn(f"{P}r1", F.expr(_reach(f"{P}sorted", "CASE WHEN y.p = 2D THEN y.end ELSE 0 END")))
    df = df.withColumn(f"{P}r2", F.expr(_reach(f"{P}sorted", "CASE WHEN y.p = 2D THEN y.start ELSE 2147483647 END", after=True)))
    df = df.withColumn(f"{P}clear", F.expr(f"filter({P}sorted, (x, i) -> x.p < 2D AND {P}r1[i] <= x.start AND {P}r2[i] >= x.end)"))
    better = "y.start < x.end AND y.end > x.start AND (y.p > x.p OR (y.p = x.p AND j < i))"
    near = f"exists(sequence(greatest(i - {NEAR}, 0), least(i + {NEAR}, size({P}clear) - 1)), j -> j <> i AND exists(array(get({P}clear, j)), y -> {better}))"
    df = df.withColumn(f"{P}added", F.expr(f"filter({P}clear, (x, i) -> NOT {near})"))
    order = "transform({0}, x -> named_struct('k', x.k, 'start', x.start, 'end', x.end))"
    df = df.withColumn(f"{P}base", F.expr(f"array_sort({order.format(f'{P}base0')})"))
    return df.withColumn(f"{P}all", F.expr(f"array_sort(concat({P}base, {order.format(f'{P}added')}))"))


def _listed(spans: str) -> Column:
    named = f"concat_ws(':', element_at(array({', '.join(repr(k) for k in KINDS)}), x.k + 1), cast(x.start as string), cast(x.end as string))"
    return F.expr(f"array_join(transform({spans}, x -> {named}), ',')")


def find(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float | None = None) -> DataFrame:
    """id, the number of base spans of each kind, ``base_sha256`` and ``spans`` of each row. ``threshold`` replaces the fitted ones."""
    out = spotted(df.select(F.col(id_col).alias(f"{P}id"), F.coalesce(F.col(text), F.lit("")).alias(f"{P}text")), threshold)
    counts = [F.expr(f"cast(size(filter({P}base, x -> x.k = {k})) as long)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(F.col(f"{P}id").alias(id_col), *counts, F.sha2(_listed(f"{P}base"), 256).alias("base_sha256"), _listed(f"{P}all").alias("spans"))


def redact(df: DataFrame, text: str = "text", threshold: float | None = None) -> DataFrame:
    """``df`` with its spans in ``text`` replaced by the kind in brackets; a span inside or over another goes with it."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(f"{P}row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(f"{P}text"))
    out = spotted(rows, threshold)
    by_start = f"array_sort(transform({P}all, x -> named_struct('start', x.start, 'end', x.end, 'k', x.k)))"
    out = out.withColumn(f"{P}o", F.expr(by_start))
    # how far the spans before each one reach: overlaps become one replacement, named after the first
    out = out.withColumn(f"{P}r", F.expr(_reach(f"{P}o", "y.end")))
    name = f"element_at(array({', '.join(repr(f'[{k.upper()}]') for k in KINDS)}), x.k + 1)"
    gap = f"CASE WHEN x.start >= {P}r[i] THEN concat(substring({P}text, {P}r[i] + 1, x.start - {P}r[i]), {name}) ELSE '' END"
    rest = f"substring({P}text, coalesce(array_max(transform({P}o, x -> x.end)), 0) + 1)"
    new = f"CASE WHEN size({P}o) = 0 THEN {P}row.`{text}` ELSE concat(array_join(transform({P}o, (x, i) -> {gap}), ''), {rest}) END"
    out = out.withColumn(f"{P}new", F.expr(new))
    return out.select(*(F.col(f"{P}new").alias(c) if c == text else F.col(f"{P}row.`{c}`").alias(c) for c in df.columns))
