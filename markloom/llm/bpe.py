"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

An automaton with suffix links over the vocabulary reports, at every position of a piece, all tokens that end there.
BPE is context-free in one respect: the encoding of a prefix has exactly one last token. For each prefix the program
stores it: a token that ends at the prefix's end, starts where another prefix ends, and is compatible with that
prefix's last token. Two neighbouring tokens are compatible if replaying the merges of their facing edges never joins
across the border. Back-pointers from the end then give the ids, in time linear in the piece's length.

Pieces are those of the tokenizer's own split pattern; the strings of special tokens are cut out first. A worker keeps
the ids of recent pieces, up to CACHE of them. Whole texts are encoded, in stretches of at most STRETCH pieces at once.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated rows give repeated rows; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE, PAIRS, STRETCH, LONG = 400_000, 1_000_000, 200_000, 2_000_000
#: The split pattern of the byte-level tokenizer (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Pieces(dict):
    """Piece to its ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self.bpe.encode_piece(piece.encode("utf-8", "surrogatepass"))
        packed = pack(f"<{len(ids)}I", *ids)
        if len(piece) < 100:
            self[piece] = packed
        return packed


class Bpe:
    """A vocabulary read from a tokenizer file (JSON, byte-level BPE)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.token = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.size = {i: len(t) for i, t in self.token.items()}
        self.rank: dict[int, int] = {}  # of the merge that makes a token; bytes have none
        self.parts: dict[int, tuple[int, int]] = {}
        self.pair_rank: dict[tuple[int, int], int] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            a, b, ab = vocab[x], vocab[y], vocab[x + y]
            self.pair_rank[a, b] = k
            if ab not in self.parts:
                self.parts[ab], self.rank[ab] = (a, b), k
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.find = regex.compile(PATTERN)
        self.suffixes = ahocorasick.Automaton()
        for i, t in self.token.items():
            self.suffixes.add_word(t.decode("latin-1"), i)
        self.suffixes.make_automaton()
        self.edges: tuple[dict, dict] = ({}, {})
        self.known: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)
        self.bytes_of = self.token | {i: t.encode() for t, i in self.special.items()}

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of ``token`` (1: right, 0: left), each with the rank of the merge that takes it up."""
        found = self.edges[side].get(token)
        if found is None:
            found = [(token, NEVER)]
            while found[-1][0] in self.parts:
                whole = found[-1][0]
                found.append((self.parts[whole][side], self.rank[whole]))
            self.edges[side][token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between two neighbouring tokens alone.

        A merge across it happens if it is due while both of its tokens are still there. Equal pairs merge from the
        left: a tie with the left token's own merge is settled for that one, a tie with the right token's is not.
        """
        get, facing = self.pair_rank.get, self.edge(right, 0)
        ok = not any(
            (r := get((x, y))) is not None and r < x_gone and r <= y_gone
            for x, x_gone in self.edge(left, 1)
            for y, y_gone in facing
        )
        if len(self.known) >= PAIRS:
            self.known.clear()
        self.known[left, right] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        last: list[int] = [-1] * (len(piece) + 1)
        size, known, compatible = self.size, self.known.get, self.compatible
        for end, token in self.suffixes.iter(piece.decode("latin-1")):
            start = end + 1 - size[token]
            if start == 0:
                last[end + 1] = token
                continue
            before = last[start]
            ok = known((before, token))
            if compatible(before, token) if ok is None else ok:
                last[end + 1] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= size[last[at]]
        return ids[::-1]

    def encode(self, text: str) -> Iterator[bytes]:
        """The packed ids of a text, in stretches."""
        at = 0
        for m in [*self.cut.finditer(text), None]:
            part = text[at : m.start() if m else len(text)]
            if len(part) <= LONG:
                yield b"".join(map(self.pieces.__getitem__, self.find.findall(part)))
            else:
                found = (x[0] for x in self.find.finditer(part))
                while stretch := list(islice(found, STRETCH)):
                    yield b"".join(map(self.pieces.__getitem__, stretch))
            if m:
                yield pack("<I", self.special[m[0]])
                at = m.end()

    def decode(self, packed: bytes) -> bytes:
        """The bytes of the tokens of packed ids."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I")))


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            n, ids, texts = [], [], []
            for text in batch.column(1):
                count, h, back = 0, hashlib.sha256(), []
                for packed in bpe.encode(text.as_py() or ""):
                    count += len(packed) // 4
                    h.update(packed)
                    back.append(bpe.decode(packed))
                n.append(count), ids.append(h.hexdigest())
                text = b"".join(back).decode("utf-8", "replace")
                texts.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            ids = [list(memoryview(b"".join(bpe.encode(t.as_py() or ""))).cast("I")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            back = [b"".join(bpe.bytes_of[i] for i in (x.as_py() or ())).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], ["id", "text"])

    return run


def _mapped(df: DataFrame, fn, id_col: str, col: str, out: str) -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(col)).mapInArrow(fn, f"id {kind}, {out}").withColumnRenamed("id", id_col)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and ids (array of long) of each row; ``path`` is the tokenizer file, which every worker reads."""
    return _mapped(df, _encode(path), id_col, text, "ids array<long>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """id and text of each row of ids; bytes that aren't UTF-8 become U+FFFD."""
    return _mapped(df, _decode(path), id_col, ids, "text string")


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded and decoded again, without keeping either."""
    return _mapped(df, _round_trip(path), id_col, text, "n_tokens long, ids_sha256 string, decoded_sha256 string")
