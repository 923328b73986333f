"""Packing tokenized documents into sequences by first-fit decreasing.

1. One Arrow pass tokenizes the whole texts and cuts each document into pieces: full sequences, and a rest. Pieces carry
   the checksum of their ids; ids themselves are shuffled only if asked for. The pieces are written to the shared folder, each with a
   random number, so that later stages see the same groups however often a task runs again.
2. Pieces are dealt by that number to groups of about GROUP pieces, or half as many with their ids. Each group is packed on its own: pieces in order of
   decreasing length go to the first bin with room, which a tournament tree of bin capacities finds in log time. With
   ids, sequences are filled, and ids and checksums are read back from them.
Groups are of bounded size at any input size; the padding is that of first-fit decreasing plus one open bin a group.

Ids are those of the tokenizers library. Its normaliser and split pattern drop white space and never look across it, so
words are encoded one by one, and a worker keeps the ids of recent ones.

Defined cases: null and empty texts are a single id, END. Repeated rows are packed each. A null id stays null. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import random
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, released, released_group

LENGTH, END, GROUP = 4096, 2, 8192
#: Words whose ids a worker keeps in each of two generations, about.
WORDS = 300_000
#: Documents whose words are numbered together.
SLICE = 2000


#: Cut off a word's end where a letter or digit stands before: the tokenizer splits there.
_TAIL = ".,;:!?|#$%&*"


class WordIds:
    """Packed ids of words, by a tokenizer whose splitting drops white space.

    The tokenizer lower-cases, and splits letters and digits from what follows; so "Word", "word," and "WORD." share the
    ids of "word". Words are kept in two generations: when the young one is full, it becomes the old one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, words: list[str]) -> list[bytes]:
        if len(self.young) >= WORDS:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, words))
        new = []
        for k, v in enumerate(found):
            if v is None:
                w = words[k]
                if (v := self.old.get(w)) is None:
                    new.append(k)
                else:
                    found[k] = self.young[w] = v
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            got = self.tokenizer.encode_batch_fast([words[k] for k in part], add_special_tokens=False)
            for k, e in zip(part, got, strict=True):
                found[k] = self.young[words[k]] = array("I", e.ids).tobytes()
        return found

    def _packed(self, different: pa.Array) -> list[bytes]:
        """The packed ids of different words."""
        plain = pc.invert(pc.match_substring(different, "<|"))  # special tokens keep their case
        lowered = pc.if_else(plain, pc.ascii_lower(different), different)
        cut = pc.ascii_rtrim(lowered, characters=_TAIL)
        size = pc.binary_length(cut).to_numpy(zero_copy_only=False)
        data = np.frombuffer(cut.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(cut.buffers()[1], np.int32)[cut.offset + 1 : cut.offset + 1 + len(cut)]
        last = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(cut), np.uint8)
        alnum = ((last >= 48) & (last <= 57)) | ((last >= 97) & (last <= 122))
        ok = (size > 0) & alnum & (size < pc.binary_length(lowered).to_numpy(zero_copy_only=False))
        stems = pc.if_else(pa.array(ok), cut, lowered).dictionary_encode()
        packed = self.look_up(stems.dictionary.to_pylist())
        out = [packed[k] for k in stems.indices.to_pylist()]
        which = np.flatnonzero(ok)
        tails = lowered.take(pa.array(which)).to_pylist()
        known: dict[str, bytes] = {}
        for k, w, n in zip(which.tolist(), tails, pc.utf8_length(cut).take(pa.array(which)).to_pylist(), strict=True):
            tail = w[n:]
            ids = known.get(tail)
            if ids is None:
                ids = known[tail] = self.look_up([tail])[0]
            out[k] += ids
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids end).

        Words are numbered by Arrow's dictionary encoding; only different words are looked up, then their ids are
        gathered with array operations.
        """
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        packed = self._packed(coded.dictionary)
        flat = np.frombuffer(b"".join(packed), np.uint32)
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start = size.cumsum() - size
        word = coded.indices.to_numpy()
        n = size[word]
        ends = n.cumsum()
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(start[word] - (ends - n), n)
        text_ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        return flat[at], np.concatenate(([0], ends))[text_ends]


    def documents(self, texts: pa.Array) -> Iterator[bytes]:
        """The packed ids of each document, END included."""
        last = array("I", [END]).tobytes()
        for i in range(0, len(texts), SLICE):
            flat, ends = self.ids(texts.slice(i, SLICE))
            at = 0
            for end in ends.tolist():
                yield flat[at:end].tobytes() + last
                at = end


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _pieces(path: str, with_ids: bool):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        deal = random.Random()
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            which, rows = [], []
            for k, ids in enumerate(words.documents(batch.column(1))):
                n = len(ids) // 4
                for start in range(0, n, LENGTH):
                    piece = ids[4 * start : 4 * (start + LENGTH)]
                    which.append(k)
                    rows.append((start, len(piece) // 4, zlib.crc32(piece), n, deal.getrandbits(62), piece if with_ids else None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "deal", "ids"],
            )

    return run


class Tournament:
    """First bin with room for a piece: a binary tree whose nodes hold the largest free room below them."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(bin, room it had) of the first bin with ``size`` free, whose room then shrinks."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < size:
                at += 1
        found, had = at - self.leaves, free[at]
        free[at] = had - size
        while at > 1:
            at //= 2
            free[at] = max(free[2 * at], free[2 * at + 1])
        return found, had


def first_fit_decreasing(lengths: list[int], room: int = LENGTH) -> tuple[list[int], list[int]]:
    """(bin, offset in it) of each piece; ties go by position."""
    tree = Tournament(len(lengths), room)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        bins[k], had = tree.place(lengths[k])
        offsets[k] = room - had
    return bins, offsets


@released_group
def _pack(table: pa.Table) -> pa.Table:
    table = table.sort_by([("deal", "ascending"), ("id", "ascending"), ("start", "ascending")])
    bins, offsets = first_fit_decreasing(table.column("length").to_pylist())
    base = table.column("group")[0].as_py() << 32 if table.num_rows else 0
    out = table.select(["id", "start", "length", "ids_crc32", "doc_tokens"])
    out = out.append_column("sequence_id", pa.array([base + b for b in bins], pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
    ids = table.column("ids")
    if ids.null_count < len(ids):
        ids, checksums = _filled(ids, bins, offsets)
        out = out.set_column(3, "ids_crc32", checksums)
    return out.append_column("ids", ids)


def _filled(pieces: pa.ChunkedArray, bins: list[int], offsets: list[int]) -> tuple[pa.Array, pa.Array]:
    """The pieces' ids and their checksums, read back from the sequences that the pieces are put into."""
    sequences: dict[int, bytearray] = {}
    spans = []
    for b, at, piece in zip(bins, offsets, pieces, strict=True):
        data = piece.as_buffer()
        sequence = sequences.setdefault(b, bytearray())
        if len(sequence) < 4 * at + data.size:
            sequence.extend(bytes(4 * at + data.size - len(sequence)))
        sequence[4 * at : 4 * at + data.size] = memoryview(data)
        spans.append((b, 4 * at, 4 * at + data.size))
    found = [bytes(sequences[b][i:j]) for b, i, j in spans]
    return pa.array(found, pa.binary()), pa.array([zlib.crc32(x) for x in found], pa.int64())


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``with_ids`` also the packed ids.

    ``path`` is the tokenizer file, which every worker reads.
    """
    spark, scratch = df.sparkSession, scratch or Scratch(df.sparkSession, "packing")
    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, deal long, ids binary"
    pieces = scratch.write(texts.mapInArrow(_pieces(path, with_ids), made), "pieces")
    groups = max(1, round(pieces.count() / (GROUP // 2 if with_ids else GROUP)))  # ids need memory
    dealt = pieces.withColumn("group", F.pmod("deal", F.lit(groups)))
    out = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    packed = dealt.groupBy("group").applyInArrow(_pack, out)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    return packed.select(F.col("id").alias(id_col), *names)
