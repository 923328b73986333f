"""Examples for the selection of added personal data: families of formats in carrier sentences.

A family is a way of writing something: national phone numbers, card numbers in groups, spelled-out addresses, IPv6, and
what looks like them: dates, ISBNs, ranges, scores, postal codes, counts, clock times, hashes. Families are dealt to FOLDS:
the threshold of each kind is fitted on examples whose families the trees that judge them have not seen.
"""

from __future__ import annotations

import random
from collections.abc import Callable

#: Sentences' openings (fixed values): those that announce personal data of a kind, neutral ones, and those of other numbers.
OPENINGS = {
    "phone": ("Call me at ", "My phone number is ", "Tel. ", "you can reach us by phone: ", "fax ", "Appelez le ", "téléphone : ", "Telefon: ", "Handy ", "Teléfono ", "text or call ", "Mobile: "),
    "card": ("Paid by card ", "my Visa is ", "credit card number ", "Karte ", "tarjeta ", "carte bancaire ", "charge the amex ", "MasterCard "),
    "email": ("Contact: ", "write to ", "e-mail me: ", "mail ", "Correo: ", "courriel : ", "schreib an "),
    "ip": ("connect from ", "the server at ", "IPv6 address ", "host ", "ping ", "Adresse ", "dirección "),
}
NEUTRAL = ("and then ", "as we said, ", "it was ", "voici ", "und ", "y luego ", "(", "", "see ", "they noted ")
OTHERS = ("Order no. ", "ISBN ", "on page ", "version ", "in the years ", "score ", "ID ", "invoice ", "part number ", "Rechnung ", "numéro de dossier ", "figure ", "between ", "dated ", "No. ")

Family = Callable[[random.Random], str]


def _d(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _n(r: random.Random, n: int) -> str:
    """Digits that don't start with 0 or 1."""
    return r.choice("23456789") + _d(r, n - 1)


def _word(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))


def _card(r: random.Random, size: int, good: bool = True) -> str:
    body = r.choice("3456") + _d(r, size - 2)
    total = sum(v if k % 2 else (2 * v - 9 if v > 4 else 2 * v) for k, v in enumerate(map(int, reversed(body))))
    return body + str((-total + (0 if good else r.randint(1, 9))) % 10)


def _grouped(c: str, sizes: tuple[int, ...], by: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(c[at : at + n])
        at += n
    return by.join(x for x in [*out, c[at:]] if x)


def _hex(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789abcdef") for _ in range(n))


GOOD: dict[str, dict[str, Family]] = {
    "phone": {
        "us_paren": lambda r: f"({_n(r, 3)}) {_n(r, 3)}-{_d(r, 4)}",
        "us_dash": lambda r: f"{_n(r, 3)}-{_n(r, 3)}-{_d(r, 4)}",
        "us_space": lambda r: f"{_n(r, 3)} {_n(r, 3)} {_d(r, 4)}",
        "us_dot": lambda r: f"{_n(r, 3)}.{_n(r, 3)}.{_d(r, 4)}",
        "uk": lambda r: f"0{_n(r, 2)} {_d(r, 4)} {_d(r, 4)}",
        "uk_area": lambda r: f"0{_n(r, 3)} {_d(r, 3)} {_d(r, 4)}",
        "fr": lambda r: f"0{r.choice('1234567')} {_d(r, 2)} {_d(r, 2)} {_d(r, 2)} {_d(r, 2)}",
        "fr_dot": lambda r: f"0{r.choice('1234567')}.{_d(r, 2)}.{_d(r, 2)}.{_d(r, 2)}.{_d(r, 2)}",
        "de": lambda r: f"0{_n(r, 3)} {_d(r, 5)}",
        "de_dash": lambda r: f"0{_n(r, 2)}-{_d(r, 5)}-{_d(r, 2)}",
    },
    "card": {
        "amex": lambda r: _card(r, 15),
        "amex_space": lambda r: _grouped(_card(r, 15), (4, 6), " "),
        "amex_dash": lambda r: _grouped(_card(r, 15), (4, 6), "-"),
        "diners": lambda r: _card(r, 14),
        "diners_space": lambda r: _grouped(_card(r, 14), (4, 6), " "),
        "short": lambda r: _card(r, 13),
    },
    "email": {
        "paren": lambda r: f"{_word(r)}.{_word(r)} (at) {_word(r)}.{r.choice(('com', 'org', 'net'))}",
        "square": lambda r: f"{_word(r)}[at]{_word(r)}.{r.choice(('de', 'fr', 'es'))}",
        "both": lambda r: f"{_word(r)}_{_d(r, 2)} [at] {_word(r)} [dot] {r.choice(('com', 'io'))}",
        "both_paren": lambda r: f"{_word(r)}(at){_word(r)}(dot){r.choice(('com', 'co', 'uk'))}",
        "upper": lambda r: f"{_word(r)}.{_word(r)} [AT] {_word(r)}.{_word(r)}.{r.choice(('edu', 'ac'))}",
        "angle": lambda r: f"{_word(r)} <at> {_word(r)} <dot> {r.choice(('org', 'net'))}",
    },
    "ip": {
        "full": lambda r: ":".join(f"{r.randrange(65536):x}" for _ in range(8)),
        "padded": lambda r: ":".join(_hex(r, 4) for _ in range(8)),
        "short": lambda r: f"{r.randrange(4096, 65536):x}:{r.randrange(65536):x}::{r.randrange(1, 65536):x}",
        "doc": lambda r: f"2001:db8:{r.randrange(65536):x}::{r.randrange(1, 255):x}",
        "local": lambda r: f"fe80::{_hex(r, 4)}:{_hex(r, 4)}:{_hex(r, 4)}:{_hex(r, 4)}",
    },
}
BAD: dict[str, dict[str, Family]] = {
    "phone": {
        "iso_date": lambda r: f"{r.choice(('19', '20'))}{_d(r, 2)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        "dot_date": lambda r: f"{r.randint(10, 28)}.{r.randint(10, 12)}.{r.choice(('19', '20'))}{_d(r, 2)}",
        "dash_date": lambda r: f"{r.randint(10, 28)}-{r.randint(10, 12)}-20{_d(r, 2)}",
        "years": lambda r: f"{r.choice(('18', '19', '20'))}{_d(r, 2)}-{r.choice(('19', '20'))}{_d(r, 2)}",
        "pages": lambda r: f"{_n(r, 2)}-{_n(r, 3)}",
        "scores": lambda r: f"{r.randint(10, 35)}-{r.randint(10, 35)} {r.randint(10, 35)}-{r.randint(10, 35)}",
        "isbn": lambda r: f"978-{r.randint(10, 99)}-{_d(r, 5)}-{_d(r, 2)}",
        "thousands": lambda r: f"{r.randint(10, 999)} {_d(r, 3)} {_d(r, 3)}",
        "zip": lambda r: f"{_d(r, 5)}-{_d(r, 4)}",
        "part": lambda r: f"{_d(r, 5)}-{_d(r, 5)}-{_d(r, 2)}",
        "decimals": lambda r: f"{_d(r, 2)}.{_d(r, 5)}",
        "version": lambda r: f"{r.randint(10, 99)}.{r.randint(10, 30)}.{_d(r, 3)}",
        "columns": lambda r: f"{_n(r, 2)} {_n(r, 2)} {_n(r, 2)}",
        "ssn_like": lambda r: f"{_d(r, 3)} {_d(r, 3)}",
    },
    "card": {
        "random": lambda r: _d(r, r.choice((13, 14, 15, 17, 18))),
        "near": lambda r: _card(r, r.choice((13, 14, 15)), False),
        "ean": lambda r: f"978{_d(r, 10)}",
        "groups": lambda r: f"{_d(r, 4)} {_d(r, 6)} {_d(r, 5)}",
        "stamp": lambda r: f"20{_d(r, 2)}{r.randint(10, 12)}{r.randint(10, 28)}{_d(r, 6)}",
    },
    "email": {
        "apart": lambda r: f"{_word(r)} <at> {_word(r)} . {_word(r)}",
        "sentence": lambda r: f"{_word(r)} (at) {_word(r)}. {_word(r).capitalize()}",
        "time": lambda r: f"{_word(r)} (at {r.randint(1, 12)}) {_word(r)}.{_word(r)}",
    },
    "ip": {
        "clock": lambda r: f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}",
        "frames": lambda r: f"{_d(r, 2)}:{_d(r, 2)}:{_d(r, 2)}:{_d(r, 2)}",
        "ratio": lambda r: f"{r.randint(1, 9)}:{r.randint(1, 9)}:{r.randint(1, 9)}",
        "mac": lambda r: ":".join(_hex(r, 2) for _ in range(6)),
        "verse": lambda r: f"{r.randint(1, 50)}:{r.randint(1, 40)}:{r.randint(1, 9)}:{r.randint(1, 9)}",
    },
}
FOLDS = 4


def examples(kind: str, n: int = 120, seed: int = 6) -> list[tuple[str, str, int, int]]:
    """(text before, candidate, label, fold): ``n`` of each family."""
    r = random.Random(f"{kind}{seed}")
    out = []
    for label, families in ((1, GOOD[kind]), (0, BAD[kind])):
        for k, make in enumerate(families.values()):
            for _ in range(n):
                said = r.random()
                opening = r.choice(OPENINGS[kind]) if said < (0.6 if label else 0.05) else r.choice(OTHERS) if said > (0.97 if label else 0.5) else r.choice(NEUTRAL)
                out.append((opening, make(r), label, k % FOLDS))
    r.shuffle(out)
    return out
