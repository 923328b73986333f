"""Each stage of the pipeline against a plain version of it, on documents made for that; the last ones by round trip.

The quality stage is held in ``test_quality.py``.
"""

import collections
import random
import re
import zlib

import corpus_pipeline as P
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from markloom.llm import langid, pii

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, langs=None):
    return spark.createDataFrame([(k, t, (langs or {}).get(k), "s", len(t or "")) for k, t in texts.items()], COLUMNS)


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality rules", "language ID", "near-duplicates", "PII redaction", "packing"]


def test_near_duplicates(spark):
    r = random.Random(3)
    texts, k = {}, 0
    for _ in range(25):
        base = [f"w{r.randrange(5000)}" for _ in range(90)]
        for _ in range(r.randrange(1, 6)):
            w = list(base)
            for _ in range(r.randrange(3)):
                w[r.randrange(90)] = "new"
            texts[k] = " ".join(w)
            k += 7
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in ((k, t.lower().split()) for k, t in texts.items())}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    docs = table(spark, texts)
    kept = P.near_dedup(spark, docs.unionByName(docs.limit(3)), "").collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {k: texts[k] for k in texts if root(k) == k} and len(kept) < len(texts)
    assert len(kept) == len({r["doc_id"] for r in kept})


def test_language_id(spark):
    """Phrases by plain search in the samples decide, with the model's limits."""
    r = random.Random(4)
    words = {k: ["".join(r.choices(letters, k=r.randint(3, 8))) for _ in range(120)] for k, letters in (("aa", "abcdeeefgiklmnoo"), ("bb", "aabcdefghiikllmn"))}
    texts = {k: " ".join(r.choices(words["ab"[k % 2] * 2], k=30)) for k in range(80)}
    texts |= {100: "".join(r.choices("qvxz jwk", k=300)), 101: "12 !?", 102: " ".join(r.choices(words["aa"], k=4))}
    langs = {k: "ab"[k % 2] * 2 for k in range(80) if k % 5}
    docs = table(spark, texts, langs)
    model = langid.train(docs, ~langid.held_out(), limits=True)
    kept = {x["doc_id"]: x for x in P.language_id(spark, docs, "").collect()}
    assert set(kept) == set(range(80)) | {102}
    assert all(kept[k]["lang"] == "ab"[k % 2] * 2 for k in range(80)) and kept[102]["lang"] == "aa"
    assert all(kept[k]["text"] == texts[k] for k in kept) and len(model.limits) == 2


def test_redaction(spark):
    """Every span that ``find`` lists is gone, replaced by its kind once for spans that overlap; all else stays."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    extra = table(spark, {-1: "a@b.co and +1 (743) 555-3824, or (212) 736-5000.", -2: "nothing here", -3: None})
    docs = docs.unionByName(extra.withColumn("n_chars", F.col("n_chars").cast(docs.schema["n_chars"].dataType)))
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    changed = 0
    for r in P.redact_pii(spark, docs, "").collect():
        t, out, at = texts[r["doc_id"]], "", 0
        for a, b, kind in sorted((int(x.split(":")[1]), int(x.split(":")[2]), pii.KINDS.index(x.split(":")[0])) for x in filter(None, spans[r["doc_id"]].split(","))):
            if a >= at:
                out += t[at:a] + f"[{pii.KINDS[kind].upper()}]"
            at = max(at, b)
        want = t if t is None else out + t[at:]
        assert r["text"] == want and r["n_chars"] == (None if t is None else len(want))
        changed += want != t
    assert changed > 5


def test_packing(spark):
    texts = {k: " ".join(f"word{k * i % 91}" for i in range(n)) for k, n in enumerate([0, 5, 700, 1500, 4000])}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in P.pack(spark, table(spark, texts), "").collect():
        ids = memoryview(bytes(r["ids"])).cast("I").tolist()
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        found[r["doc_id"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t in texts.items():
        assert sum((ids for _, ids in sorted(found[k])), []) == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
    for s in sequences.values():
        assert sorted(o for o, _ in s) == [sum(n for _, n in sorted(s)[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 4096


def test_a_whole_run(spark):
    """Every stage sees only what the one before kept, and the last one's rows come from those that all kept."""
    docs, seen = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").collect(), docs.schema)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert all(a >= b for a, b in zip(seen, seen[1:])) and len(seen[0]) > len(seen[-1])
    out = P.run(spark, "/root/testdata/sf0.001").select("doc_id", "length").collect()
    assert {r["doc_id"] for r in out} == seen[-1]
    assert not any(re.search(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]+", r["text"]) for r in docs.collect())


def test_tables_without_n_chars(spark):
    docs = spark.createDataFrame([(1, "some words and a@b.co", "x")], "doc_id long, text string, __pii_text string")
    assert tuple(P.redact_pii(spark, docs, "").first()) == (1, "some words and [EMAIL]", "x")
