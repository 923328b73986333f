"""Media columns: texts as 8-bit audio, stored as deduplicated content-defined chunks, read back and measured.

A text's payload is its UTF-8 bytes, padded with bytes 0 to a positive multiple of UNIT; its stored form is a WAV file of
8-bit mono samples, one a byte, so the samples are the payload.

1. ``store``: one Arrow pass makes the WAV files and cuts them. A gear hash rolls over the bytes: the hash of a position
   covers the 32 bytes before it, and a chunk ends where its highest bits are 0, between LEAST and MOST bytes. Equal
   stretches of different texts so give equal chunks. Chunks are compressed and appended to packs in the shared folder; a
   task writes a chunk once. What Spark keeps is a row for each text: its ordered list of chunk digests and their places.
2. ``recipes``: texts are told apart by digest, and chunks by digest: the places of a chunk that several tasks wrote are
   grouped, pre-aggregated, and a join gives every list the first of them. Later copies stay in their packs, unreferenced.
3. ``restore``: lists are dealt by where their text was written and sorted, so a pack is read forward in ranges, and only
   chunks that another task wrote need a read elsewhere. Chunks stream through the rebuild, which parses the WAV header
   and holds one chunk at a time. Chunks, texts, order and header are verified; damage raises ValueError.
4. The results of the different texts join all rows by digest, hot texts in parts.

Bytes move once into the packs and once out of them; shuffles only move digests and places. Packs lie in the shared
folder, so they outlive executors: a task that runs again writes packs with new names, and only those of the attempt that
succeeds are referred to. They are written through pyarrow's file systems (file, hdfs, s3, gs).

Defined cases: a null text counts as empty, with a payload of UNIT zero bytes. Repeated rows and equal texts give equal
values. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join

UNIT, RATE = 64, 8000
LEAST, MOST, BITS = 4096, 65536, 13
#: Bytes of a pack at most, of a range that one read brings, and of the stretch of a pack that one group of lists covers;
#: chunks that a task remembers having written, and bytes of chunks from elsewhere that it keeps at hand.
PACK, RANGE, BLOCK, REMEMBER, AT_HAND = 256 << 20, 4 << 20, 32 << 20, 200_000, 32 << 20
HEADER = 44
_GEAR = np.random.default_rng(9).integers(0, 2**32, 256, np.uint64).astype(np.uint32)


def payload_of(text: bytes | None) -> bytes:
    data = text or b""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def wav_header(samples: int) -> bytes:
    """Header of a mono WAV file of 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + samples) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", samples & 0xFFFFFFFF)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for w in (1, 2, 4, 8, 16):  # from hashes of w bytes to hashes of 2 w
        older = h[:-w] << np.uint32(w)
        h = h.copy()
        h[w:] += older
    marks = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    ends, at = [], 0
    while n - at > LEAST:
        k = np.searchsorted(marks, at + LEAST)
        end = min(int(marks[k]) if k < len(marks) else n, at + MOST, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunk_digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


_PLACE = pa.struct([("pack", pa.string()), ("offset", pa.int64()), ("length", pa.int32())])
_CHUNK = pa.struct([("digest", pa.binary()), ("place", _PLACE)])
_PLACE_SQL = "struct<pack:string,offset:long,length:int>"
_CHUNK_SQL = f"struct<digest:binary,place:{_PLACE_SQL}>"


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, text) to (id, key, n_bytes, home, chunks); ``home`` is where the pack stood when the text came."""
        import zstandard

        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        z = zstandard.ZstdCompressor(3)
        out, name, at = None, "", 0
        known: dict[bytes, dict] = {}
        try:
            for batch in batches:
                keys, sizes, homes, lists = [], [], [], []
                for text in batch.column(1).to_pylist():
                    if out is None or at >= PACK:
                        if out is not None:
                            out.close()
                        name, at = uuid.uuid4().hex, 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    text = text or b""
                    payload = payload_of(text)
                    media, start, found = wav_header(len(payload)) + payload, 0, []
                    homes.append({"pack": name, "offset": at, "length": 0})
                    for end in cuts(media):
                        chunk = media[start:end]
                        start, digest = end, chunk_digest(chunk)
                        place = known.get(digest)
                        if place is None:
                            data = z.compress(chunk)
                            out.write(data)
                            if len(known) >= REMEMBER:
                                known.clear()
                            place = known[digest] = {"pack": name, "offset": at, "length": len(data)}
                            at += len(data)
                        found.append({"digest": digest, "place": place})
                    keys.append(hashlib.sha256(text).digest()), sizes.append(len(text)), lists.append(found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(homes, _PLACE), pa.array(lists, pa.list_(_CHUNK))],
                    ["id", "key", "n_bytes", "home", "chunks"],
                )
        finally:
            if out is not None:
                out.close()

    return run


class Rebuild:
    """Takes a media file's chunks in order; verifies, digests and measures it without holding it."""

    def __init__(self, key: bytes, n_bytes: int):
        self.key, self.n_bytes, self.size, self.head = key, n_bytes, 0, b""
        self.total = max(UNIT, -(-n_bytes // UNIT) * UNIT)
        self.payload, self.text, self.media = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.histogram, self.crossings, self.last, self.tail = np.zeros(256, np.int64), 0, None, b""

    def take(self, digest: bytes, chunk: bytes) -> None:
        if chunk_digest(chunk) != digest:
            raise ValueError("a stored chunk is damaged")
        self.media.update(chunk)
        if len(self.head) < HEADER:
            need = HEADER - len(self.head)
            self.head, chunk = self.head + chunk[:need], chunk[need:]
            if len(self.head) == HEADER and self.head != wav_header(self.total):
                raise ValueError("a stored header doesn't fit its text")
            if not chunk:
                return
        self.payload.update(chunk)
        self.text.update(chunk[: max(0, self.n_bytes - self.size)])
        samples = np.frombuffer(chunk, np.uint8)
        self.histogram += np.bincount(samples, minlength=256)
        high = samples >= 128
        self.crossings += int(np.count_nonzero(high[1:] != high[:-1])) + (self.last is not None and self.last != bool(high[0]))
        self.last = bool(high[-1])
        self.tail = (self.tail + chunk[-UNIT:])[-UNIT:]
        self.size += len(chunk)

    def feature(self) -> str:
        values = np.arange(256)
        n = self.size
        mean = float((self.histogram * values).sum()) / n - 128
        rms = (float((self.histogram * (values - 128) ** 2).sum()) / n) ** 0.5
        p = self.histogram[self.histogram > 0] / n
        used = np.flatnonzero(self.histogram)
        entropy = abs(float(-(p * np.log2(p)).sum()))
        return f"seconds={n / RATE:.3f};mean={mean:.4f};rms={rms:.4f};crossings={self.crossings};low={used[0]};high={used[-1]};entropy={entropy:.4f}"

    def done(self) -> tuple:
        if self.size != self.total or self.text.digest() != self.key:
            raise ValueError("a rebuilt payload doesn't have its digest")
        return (self.size, self.payload.hexdigest(), zlib.crc32(self.tail), HEADER + self.size, self.media.hexdigest(), self.feature())


_RESULT = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
_RESULT_SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class Packs:
    """Reads chunks by place: forward in ranges in the pack at hand, singly in others, where repeated ones are kept."""

    def __init__(self, root: str):
        self.store, self.base = fs.FileSystem.from_uri(root)
        self.name, self.file, self.start, self.data = "", None, 0, b""
        self.kept: OrderedDict[tuple[str, int], bytes] = OrderedDict()
        self.size = 0

    def home(self, name: str) -> None:
        if name != self.name:
            self.close()
            self.name, self.file, self.start, self.data = name, self.store.open_input_file(f"{self.base}/{name}"), 0, b""

    def get(self, pack: str, offset: int, length: int) -> bytes:
        if pack == self.name:
            if not self.start <= offset <= offset + length <= self.start + len(self.data):
                if offset < self.start:  # an earlier text's chunk
                    return self.file.read_at(length, offset)
                self.start, self.data = offset, self.file.read_at(max(RANGE, length), offset)
            data = self.data[offset - self.start : offset - self.start + length]
        elif (found := self.kept.get((pack, offset))) is not None:
            self.kept.move_to_end((pack, offset))
            return found
        else:
            with self.store.open_input_file(f"{self.base}/{pack}") as f:
                data = self.kept[pack, offset] = f.read_at(length, offset)
            self.size += length
            while self.size > AT_HAND and len(self.kept) > 1:
                self.size -= len(self.kept.popitem(last=False)[1])
        if len(data) != length:
            raise ValueError("a stored chunk is cut off")
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, n_bytes, home, places, digests), sorted by home, to the results."""
        import zstandard

        z, packs = zstandard.ZstdDecompressor(), Packs(root)
        try:
            for batch in batches:
                rows = []
                for key, n_bytes, home, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    packs.home(home["pack"])
                    media = Rebuild(key, n_bytes)
                    for c in chunks:
                        data = packs.get(c["place"]["pack"], c["place"]["offset"], c["place"]["length"])
                        try:
                            chunk = z.decompress(data)
                        except zstandard.ZstdError as e:
                            raise ValueError("a stored chunk is damaged") from e
                        media.take(c["digest"], chunk)
                    rows.append(media.done())
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_RESULT)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True))], ["key", *_RESULT])
        finally:
            packs.close()

    return run


def store(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Writes the packs: (table of id, key, n_bytes, home, chunks, with a row for each row of ``df``; the packs' folder)."""
    kind = df.schema[id_col].dataType.simpleString()
    root = scratch.path("packs")
    texts = df.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))
    made = texts.mapInArrow(_write(root), f"id {kind}, key binary, n_bytes long, home {_PLACE_SQL}, chunks array<{_CHUNK_SQL}>")
    return scratch.write(made, "lists"), root


def recipes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each different text: key, n_bytes, home, chunks, with one place for each different chunk."""
    first = rows.groupBy("key").agg(F.min(F.struct("home", "n_bytes", "chunks")).alias("x")).select("key", "x.*")
    first = scratch.write(first, "texts")
    parts = first.select("key", F.posexplode("chunks").alias("seq", "c")).select("key", "seq", "c.digest", "c.place")
    twice = parts.groupBy("digest").agg(F.min("place").alias("least"), F.max("place").alias("most")).filter("least <> most").select("digest", "least")
    twice = scratch.write(twice, "shared-chunks")
    moved = scratch.write(parts.select("key", "seq", "digest").join(twice.select("digest"), "digest", "left_semi"), "moved")
    own = salted_join(moved, twice, "digest", "key", scratch).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("seq", "least"))).alias("new"))
    place = lambda c, i: F.coalesce(F.try_element_at("new", i), c["place"])
    chunks = F.transform("chunks", lambda c, i: F.struct(c["digest"].alias("digest"), place(c, i).alias("place")))
    return first.join(own, "key", "left").select("key", "n_bytes", "home", F.when(F.col("new").isNull(), F.col("chunks")).otherwise(chunks).alias("chunks"))


def restore(lists: DataFrame, root: str) -> DataFrame:
    """Reads the packs: key and results of each list."""
    dealt = lists.repartition(F.col("home.pack"), F.floor(F.col("home.offset") / BLOCK)).sortWithinPartitions("home")
    return dealt.mapInArrow(_read(root), f"key binary, {_RESULT_SCHEMA}")


def media_round_trip(df: DataFrame, id_col: str = "doc_id", text: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each row."""
    scratch = scratch or Scratch(df.sparkSession, "media")
    rows, root = store(df, scratch, id_col, text)
    results = restore(recipes(rows, scratch), root)
    ids = rows.select("id", "n_bytes", "key", F.col("home.offset").alias("at"))
    out = salted_join(ids, results, "key", "at", scratch)
    return out.select(F.col("id").alias(id_col), "n_bytes", *_RESULT)
