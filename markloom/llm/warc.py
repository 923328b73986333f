"""WARC archives: index first, then coalesced byte-range reads.

Writing: the digests of all payloads are grouped (pre-aggregated) to find, for every payload of DEDUP bytes or more that
occurs more than once, the record that keeps it; the others become revisits. The decisions join the pages by id, so a
payload that a third of the pages share doesn't meet in one task; where digests meet, hot ones are split. Each task then writes gzip archives, one member a
record, and returns an index row for each record: archive, offset, length, URL, digest. The index is a table in the
shared folder.

Reading: the selected index rows, sorted by archive and offset, are read in ranges: neighbouring records whose gap is
at most GAP come with one read of at most RANGE bytes. Each record is parsed, and its payload checked against the digest.

Archives and index are the operator's product and stay; they lie in the shared folder, so they outlive executors; a task that runs again writes archives with new
names, and only those of the attempt that succeeds are in the index. Archives are written through pyarrow's file
systems (file, hdfs, s3, gs).

Defined cases: null html is an empty payload; a null URL becomes ``urn:page:ID``. Rows that share the largest id of a
payload are all responses; in a group of null ids only, all rows are. Other columns are ignored. An empty table gives an
empty index and no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salted_join

DEDUP, ARCHIVE, GAP, RANGE, BLOCK = 1000, 256 << 20, 64 << 10, 8 << 20, 32 << 20
DATE = "2024-01-01T00:00:00Z"
#: Field names and profile of the WARC 1.1 standard (fixed values).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _clean(url: str | None, page_id: object) -> str:
    return "".join(c if " " < c else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url, page_id)),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    fields += [("X-Page", "" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response")]
    return _record(fields, http if revisit else http + payload)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(fields, HTTP head, payload) of one record; raises ValueError if it is cut or malformed."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) < size:
        raise ValueError("a WARC record is cut off")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, http, payload


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


_INDEX = "id {id}, url string, record_type string, refers_to {id}, payload_digest string, payload_bytes long, archive string, offset long, length long"
_NAMES = [x.split()[0] for x in _INDEX.split(", ")]


def _write(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, url, payload, digest, refers_to, revisit) to index rows."""
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                places = []
                for i, url, payload, digest, to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= ARCHIVE:
                        if out is not None:
                            out.close()
                        name = f"pages-{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                        first = _gzip(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                        out.write(first)
                        at = len(first)
                    member = _gzip(page_record(i, url, payload, digest, to, revisit))
                    out.write(member)
                    places.append((name, at, len(member)))
                    at += len(member)
                cols = list(zip(*places, strict=True)) if places else [[]] * 3
                kinds = ["revisit" if x else "response" for x in batch.column(5).to_pylist()]
                sizes = [len(x) for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(kinds, pa.string()), batch.column(4), batch.column(3), pa.array(sizes, pa.int64()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                    _NAMES,
                )
        finally:
            if out is not None:
                out.close()

    return run


def write(df: DataFrame, scratch: Scratch, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row below the shared folder; the index table, with ``archive_root`` in every row."""
    kind = df.schema[id_col].dataType.simpleString()
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    pages = df.select(F.col(id_col).alias("id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = scratch.write(pages.filter(F.octet_length("payload") >= DEDUP).select("id", "digest"), "digests")
    many = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null")
    revisits = salted_join(large, scratch.write(many, "shared"), "digest", "id", scratch).filter("not id <=> refers_to").select("id", "digest", "refers_to").distinct()
    joined = pages.join(
        revisits.select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "refers_to"),
        F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")),
        "left",
    ).select("id", "url", "payload", "digest", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    root = scratch.path("archives")
    index = scratch.write(joined.mapInArrow(_write(root), _INDEX.format(id=kind)), "index")
    return index.withColumn("archive_root", F.lit(root))


def ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Slices of rows (archive, offset, length), in order, that one read brings."""
    start = 0
    for k in range(1, len(rows) + 1):
        if k < len(rows):
            (name, at, size), (before, b_at, b_size) = rows[k], rows[k - 1]
            if name == before and at - (b_at + b_size) <= GAP and at + size - rows[start][1] <= RANGE:
                continue
        yield start, k
        start = k


def _read(root: str, keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        name, file = None, None
        try:
            for batch in batches:
                rows = list(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True))
                out = []
                for a, b in ranges(rows):
                    if rows[a][0] != name:
                        if file is not None:
                            file.close()
                        name = rows[a][0]
                        file = store.open_input_file(f"{base}/{name}")
                    origin = rows[a][1]
                    data = file.read_at(rows[b - 1][1] + rows[b - 1][2] - origin, origin)
                    for _, at, size in rows[a:b]:
                        fields, http, payload = parse_record(zlib.decompress(data[at - origin : at - origin + size], 31))
                        digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
                        kind = fields["WARC-Type"]
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
                        full = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                        refers = fields.get("X-Refers-To-Page")
                        out.append((full, digest, kind, refers, payload if keep_payload and kind == "response" else None))
                cols = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
                    ["id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
                )
        finally:
            if file is not None:
                file.close()

    return run


def read(index: DataFrame, root: str, id_col: str = "page_id", keep_payload: bool = True) -> DataFrame:
    """The records of the selected index rows: id, payload_bytes, payload_digest, record_type, refers_to, payload.

    The payload of a revisit is null: it is that of the record it refers to.
    """
    kind = index.schema["id"].dataType.simpleString()
    places = index.select("id", "archive", "offset", "length").repartition("archive", F.floor(F.col("offset") / BLOCK))
    out = places.sortWithinPartitions("archive", "offset").mapInArrow(_read(root, keep_payload), f"id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return out.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), *(["payload"] if keep_payload else []))


def archive(df: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", keep_payload: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Write all rows, then read all records back."""
    scratch = scratch or Scratch(df.sparkSession, "warc")
    index = write(df, scratch, id_col, url, html)
    first = index.first()
    return read(index, first["archive_root"] if first else scratch.root, id_col, keep_payload)
