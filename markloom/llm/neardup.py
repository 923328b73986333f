"""Near-duplicate documents by MinHash.

1. One Arrow pass turns each whole text into its set of five-word shingles: the set's size and digest, BANDS band keys
   of ROWS universal hash minima each, and a signature of 16-bit minima.
2. Texts with equal sets collapse to the smallest id (a pre-aggregated group by the digest), so that exact copies cost one row.
3. In each band bucket every member is paired with the bucket's smallest id only: a star, linear in the bucket.
4. Pairs are checked on signatures, then on full sets. The links' components come from alternating stars.
5. Buckets that still hold several components are gone through again: their members outside the bucket's largest
   component meet the members of other components. So each pair of a bucket is either joined already or compared, and no
   link between different texts is lost, while a large group of near copies never meets itself. A bucket is dealt to
   tiles of about TILE shingles, in which overlaps are counted on full sets; only links leave a tile, never pairs.
At the threshold a link is missed by all bands with probability (1 - 0.85^6)^28, about 2e-6, and by the signature check
with 3e-8. Stages are written to the shared folder; nothing that grows is collected or broadcast.

Keys that hold many rows are split in every join (``common.salted_join``): a common set, a bucket and a hub of a large
group of near copies. The last pass over a bucket of m shingles in several components repeats its members for every tile
they meet: a bucket whose members are all unlinked costs m * (m / TILE) / 2 shingles read and as many compared, so it is
linear up to TILE shingles and quadratic in tiles beyond. README gives its measured cost.

Defined cases: null or empty texts and texts without words have 0 shingles and link with nothing. Texts with fewer than
five words are one shingle, their whole sequence. Rows with equal ids and texts count as one document; ``keep_first`` keeps,
of the rows with one id, that with the least text. A row with a null id joins
the component of the rows with an equal shingle set; without such rows its component_id is null and it is kept. Other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, released, released_group, salted_join
from .components import components
from .shingles import mix, shingle_set

BANDS, ROWS, SIGNATURE = 28, 6, 128
#: Shingles of a tile, about; candidate ids that are broadcast at most (about 64 MB as a hashed table), else joined by a shuffle.
TILE, BROADCAST = 1_000_000, 1_000_000
#: Least share of equal minima in the signatures of a pair that is compared in full: the threshold less 5.4 deviations.
SCREEN = 0.68
_rng = np.random.default_rng(20240117)
_A = _rng.integers(0, 2**32, BANDS * ROWS, np.uint64).astype(np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, np.uint64).astype(np.uint32)
_BLOCK, HASH = 512, 24


def minima(shingles: np.ndarray) -> np.ndarray:
    """Minima of multiply-shift hashes: the upper HASH bits of a * x + b mod 2^32, a odd, are universal up to a factor of 2.

    The least product has the least upper bits, so the shift comes last.
    """
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), _BLOCK):
        h = np.multiply.outer(x[i : i + _BLOCK], _A)
        h += _B
        np.minimum(least, h.min(axis=0), out=least)
    return least >> np.uint32(32 - HASH)


def _band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h + rows[:, k])
    return h.view(np.int64)


@released
def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, key, bands, sig = [], [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py())
            n.append(len(s))
            if not len(s):
                key.append(None), bands.append(None), sig.append(None)
                continue
            least = minima(s)
            key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            bands.append(_band_keys(least))
            sig.append((least[:SIGNATURE] & np.uint32(0xFFFF)).astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
            ["id", "n", "set_key", "bands", "sig"],
        )


@released
def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(x.as_py()).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])


@released
def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sig_a, sig_b): pairs whose signatures agree enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, SIGNATURE) for c in (batch.column(2), batch.column(3)))
        yield batch.filter(pa.array((a == b).mean(axis=1) >= SCREEN)).select([0, 1])


def _linked(percent: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(u, v, shingles_u, shingles_v): pairs with 100 * intersection >= percent * union."""
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    ok.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select([0, 1])

    return run


def _across(percent: int):
    @released_group
    def run(table: pa.Table) -> pa.Table:
        """(id, c, rest, shingles) of a tile: links between rows of ``rest`` and others of different components.

        The shingles are numbered within the tile; for each row of ``rest``, one lookup counts its overlap with all others
        at once. Of its links to one component, one is enough.
        """
        rest = np.asarray(table.column("rest").to_pylist(), bool)
        ids, comps = table.column("id"), np.asarray(table.column("c").to_pylist())
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        sizes = np.array([len(x) for x in sets])
        used, codes = np.unique(np.concatenate(sets), return_inverse=True)
        ends = sizes.cumsum()
        mark = np.zeros(len(used), bool)
        others = np.flatnonzero(~rest)
        columns = np.concatenate([codes[ends[k] - sizes[k] : ends[k]] for k in others]) if len(others) else codes[:0]
        starts = np.concatenate(([0], sizes[others].cumsum()[:-1])) if len(others) else others
        u, v = [], []
        for k in np.flatnonzero(rest) if len(others) else ():
            own = codes[ends[k] - sizes[k] : ends[k]]
            mark[own] = True
            both = np.add.reduceat(mark[columns], starts, dtype=np.int64)
            mark[own] = False
            ok = (100 * both >= percent * (sizes[others] + sizes[k] - both)) & (comps[others] != comps[k])
            _, first = np.unique(comps[others[ok]], return_index=True)
            for j in others[ok][first]:
                u.append(k), v.append(int(j))
        return pa.table({"u": ids.take(pa.array(u, pa.int64())), "v": ids.take(pa.array(v, pa.int64()))})

    return run


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 85, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id, kept.

    ``percent`` is the least Jaccard similarity of a link, 80 at least (the bands are set for such links).
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must lie between 80 and 100")
    spark, scratch = df.sparkSession, scratch or Scratch(df.sparkSession, "neardup")
    idt = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text).cast("binary").alias("text"))
    rows = scratch.write(texts.mapInArrow(_describe, f"id {idt}, n long, set_key binary, bands array<long>, sig binary"), "rows")
    sets = rows.filter("set_key is not null")
    # one row per different set
    reps = scratch.write(
        sets.groupBy("set_key").agg(F.min("id").alias("id"), F.first(F.struct("n", "bands", "sig")).alias("x")).filter("id is not null").select("id", "x.*"),
        "reps",
    )
    banded = reps.select("id", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("m")).filter("m > 1").select("key", "hub")
    banded = scratch.write(banded, "banded")
    members = scratch.write(salted_join(banded, scratch.write(buckets, "buckets"), "key", "id", scratch), "members")
    nodes = scratch.write(members.select("id").distinct(), "nodes")
    if nodes.count() <= BROADCAST:
        nodes = F.broadcast(nodes)
    full = scratch.write(texts.join(nodes, "id", "left_semi").mapInArrow(_full_sets, f"id {idt}, shingles binary"), "sets")
    sig = reps.select("id", "sig")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b), distinct, to links (u, v)."""
        left, right = (sig.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in ("a", "b"))
        screened = salted_join(pairs, right, "b", "a", scratch).join(left, "a").select("a", "b", "sig_a", "sig_b").mapInArrow(_alike, f"a {idt}, b {idt}")
        screened = scratch.write(screened, "screened")
        left, right = (full.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in ("a", "b"))
        whole = salted_join(screened, right, "b", "a", scratch).join(left, "a").select("a", "b", "set_a", "set_b")
        return whole.mapInArrow(_linked(percent), f"a {idt}, b {idt}").select(F.col("a").alias("u"), F.col("b").alias("v"))

    stars = members.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    stars = scratch.write(stars, "star-pairs")
    links = scratch.write(confirmed(stars), "star-links")
    first = components(links, scratch)

    placed = members.join(first.select(F.col("u").alias("id"), F.col("v").alias("c")), "id", "left").select("key", "id", "n", F.coalesce("c", "id").alias("c"))
    placed = scratch.write(placed, "placed")
    counts = placed.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    mixed = counts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("c", "m").alias("top"), F.sum("n").alias("all_n"), F.max_by("n", "m").alias("top_n"))
    tiles, chunks = (F.ceil(x / TILE).cast("int") for x in (F.col("all_n"), F.greatest(F.lit(1), F.col("all_n") - F.col("top_n"))))
    mixed = mixed.filter("parts > 1").select("key", "top", tiles.alias("tiles"), chunks.alias("chunks"))
    mixed = scratch.write(placed.join(mixed, "key"), "mixed")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inside = mixed.select("key", "id", "c", F.lit(False).alias("rest"), place("tiles").alias("tile"), every("chunks").alias("chunk"))
    rest = mixed.filter("c <> top").select("key", "id", "c", F.lit(True).alias("rest"), every("tiles").alias("tile"), place("chunks").alias("chunk"))
    tiled = inside.unionByName(rest).join(full, "id").select("key", "tile", "chunk", "id", "c", "rest", "shingles")
    more = scratch.write(tiled.groupBy("key", "tile", "chunk").applyInArrow(_across(percent), f"u {idt}, v {idt}").distinct(), "more-links")
    final = components(first.unionByName(more), scratch) if more.take(1) else first
    scratch.drop(members, placed, mixed, full, reps, links)

    # of each set its smallest id and that one's component
    least = sets.groupBy("set_key").agg(F.min("id").alias("rep"))
    least = least.join(final.select(F.col("u").alias("rep"), F.col("v").alias("c")), "rep", "left").select("set_key", F.coalesce("c", "rep").alias("component"))
    out = salted_join(rows.select("id", "n", "set_key"), scratch.write(least, "least"), "set_key", "id", scratch, "left")
    component = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def keep_first(df: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``df`` that stay: one for each component, the one with the smallest id, and of rows with equal ids one.

    Rows without an id can't be told apart by one and stay as they are.
    """
    kept = near_duplicates(df.filter(F.col(id_col).isNotNull()), id_col, text, percent).filter("kept").select(id_col)
    mine = df.join(kept, id_col, "left_semi")
    twice = mine.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").select(id_col)
    # rows that share an id are few or none: all columns of the one with the least text come along
    one = mine.join(twice, id_col, "left_semi").groupBy(id_col).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(F.col(text), F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)))).alias("__one")).select("__one.*")
    return mine.join(twice, id_col, "left_anti").unionByName(one).unionByName(df.filter(F.col(id_col).isNull()))
