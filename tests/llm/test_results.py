"""Results against brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import os
import random
import re
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from markloom.llm import bpe, html_text, langid, licenses, media, neardup, packing, pii, quality, warc
from markloom.llm.common import Scratch
from markloom.llm.components import components
from markloom.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, SF).collect()}


def find(p, x):
    while p[x] != x:
        x = p[x]
    return x


def clusters(texts):
    sets = {}
    for k, t in texts.items():
        w = t.encode().lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    p = {k: k for k in texts}
    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 85 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 85 * (len(x) + len(y) - n):
                    u, v = find(p, a), find(p, b)
                    p[max(u, v)] = min(u, v)
    return {k: (len(sets[k]), find(p, k)) for k in texts}


def test_near_duplicates(spark, texts):
    got = rows(spark, "op2_minhash_near_dedup")
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == clusters(texts)
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items())


def test_large_group_of_near_copies(spark):
    """Copies whose links chain, many of them below the threshold with the group's first."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for k in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts[k] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(df).collect()}
    assert got == clusters(texts)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    p = {k: k for k in range(500)}
    for a, b in links:
        u, v = find(p, a), find(p, b)
        p[max(u, v)] = min(u, v)
    got = {x["u"]: x["v"] for x in components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()}
    assert all(got.get(k, k) == find(p, k) for k in range(500))


def test_quality_counts(spark, texts):
    got = rows(spark, "op4_quality_rules")
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        places = collections.defaultdict(list)
        for i in range(len(w) - 4):
            places[tuple(w[i : i + 5])].append(i)
        repeat = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeat))
        assert tuple(got[k][c] for c in quality.COUNTS) == want
        assert got[k]["base_failed"] == (len(w) < 10 or 100 * len(repeat) > 20 * len(w))


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    def ok(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 8 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, t) if ok(k, m[0])]


def test_pii(spark, texts):
    odd = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 300.1.1.1 0000255.1.1.1", "4111 1111 1111 1111x 4111111111111111 5", "+1 (743) 555-3824 4 +12 ++123456789", "é😀 a@b.co +49 30 1234567", "x" * 5000 + "@" + "y.z" * 50, "1 " * 3000, "9" * 4000]
    texts = texts | {10**6 + k: t for k, t in enumerate(odd)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in pii.find(df).collect():
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r["spans"].split(","))


def test_pii_added_and_redacted(spark):
    df = spark.createDataFrame([(1, "call (743) 555-3824 or john.doe (at) host (dot) com, not 2020-11-12 or 12:30:45")], "doc_id long, text string")
    assert pii.redact(df).first()["text"] == "call [PHONE] or [EMAIL], not 2020-11-12 or 12:30:45"


def test_language_held_out(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = [r for r in QUERIES["op7_language_id"](spark, SF).collect() if r["held_out"]]
    assert got and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in got)
    long = [r for r in got if (docs[r["doc_id"]]["n_chars"] or 0) >= 100]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in long) >= 0.95 * len(long)


def test_phrases_against_brute_force():
    model = langid.fit({"a": ["abcab cabca" * 20], "b": ["xyzzy xyx" * 20]})
    for k, lang in enumerate(model.languages):
        sample = {"a": "abcab cabca" * 20, "b": "xyzzy xyx" * 20}[lang][: round(2 ** model.logs[k])]
        for text in ("abcabcab", "zyx abc q", "cabcabc" * 10):
            n, i = 0, 0
            while i < len(text):
                j = i
                while j < len(text) and text[i : j + 1] in sample:
                    j += 1
                n, i = n + 1, max(j, i + 1)
            assert model.phrases([model.codes(text)])[0, k] == n


def test_packing(spark, texts):
    tokenizer = Tokenizer.from_file(WORD)
    ids = {k: tokenizer.encode(t, add_special_tokens=False).ids + [2] for k, t in texts.items()}
    seen, sequences = collections.Counter(), collections.defaultdict(list)
    for r in QUERIES["op8_packing"](spark, SF).collect():
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)), len(ids[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
        seen[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == {k: len(v) for k, v in ids.items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096


def test_first_fit_decreasing():
    r = random.Random(3)
    for _ in range(50):
        sizes = [r.randint(1, 100) for _ in range(r.randint(1, 60))]
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        free, want = [], {}
        for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            b = next((b for b, f in enumerate(free) if f >= sizes[k]), len(free))
            if b == len(free):
                free.append(100)
            want[k] = (b, 100 - free[b])
            free[b] -= sizes[k]
        assert {k: (bins[k], offsets[k]) for k in range(len(sizes))} == want


@pytest.mark.parametrize("path, letters", [(BYTE, "aaab bc  \n\t'stnrelvdm é漢字😀<|endoftext|>0123\x1c\xa0 zzzz!?.."), (WORD, "aAbÉéßÇ'sStdmrelv.,!-_#|0123<|endoftext|>́Σσς漢İ\xa0\x1c \n\t")])
def test_ids_of_odd_texts(path, letters):
    import pyarrow as pa

    r, tokenizer = random.Random(1), Tokenizer.from_file(path)
    encoder = bpe.Bpe(path) if path == BYTE else packing.WordIds(path)
    for k in range(2000):
        t = "".join(r.choices(letters, k=r.randrange(40))) + "<|endoftext|>x" * (k % 9 == 0)
        want = tokenizer.encode(t, add_special_tokens=False).ids
        got = b"".join(encoder.encode(t)) if path == BYTE else next(encoder.documents(pa.array([t])))[:-4]
        assert list(memoryview(got).cast("I")) == want


def test_bpe_round_trip(spark, texts):
    tokenizer = Tokenizer.from_file(BYTE)
    for k, r in rows(spark, "op10_bpe_round_trip").items():
        ids = tokenizer.encode(texts[k], add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_media(spark, texts):
    for k, r in rows(spark, "op9_media_chunks").items():
        p = media.payload_of(texts[k].encode())
        stored = media.wav_header(len(p)) + p
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(stored), hashlib.sha256(stored).hexdigest())


def test_chunks_follow_content():
    data = random.Random(1).randbytes(400_000)
    ends = media.cuts(data)
    assert ends[-1] == len(data) and all(b - a <= media.MOST for a, b in zip([0, *ends], ends))
    assert len({e + 7 for e in ends} & set(media.cuts(b"1234567" + data))) > 0.8 * len(ends)


def test_warc_revisits(spark):
    big = "<p>" + "x" * 2000
    data = [(1, "http://a/", big), (2, "http://b/ \n", big), (3, None, "small"), (4, "http://c/", "small"), (5, "http://d/", None), (9, "http://e/", big)]
    got = {r["page_id"]: r for r in warc.archive(spark.createDataFrame(data, "page_id long, url string, html string").repartition(2), keep_payload=True).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("revisit", 9), 2: ("revisit", 9), 3: ("response", None), 4: ("response", None), 5: ("response", None), 9: ("response", None)}
    assert all((r["payload_bytes"], r["payload_digest"]) == (len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for k, _, h in data for r in [got[k]])
    assert bytes(got[9]["payload"]).decode() == big and got[1]["payload"] is None


def test_html(spark):
    page = '<body><header><h1>Site</h1></header><div class="cookie-notice">We</div><main><article><h1>T</h1><p>One &amp; <i>t</i>wo<br>x<div class="adBox">Buy</div><ul><li>a<li>b</ul><form>f</form><table><tr><td>1<td>2</table><section id="comments"><article class="comment">bad</article></section></article></main><aside>s</aside><footer>x'
    assert html_text.main_text(page) == "T One & two x a b 1 2"
    assert html_text.main_text("plain <b>text</b><p>3 &lt; 5 < 6 <div cl") == "plain text 3 < 5 < 6"


def test_licenses(spark, texts):
    ix = licenses.index(spark)
    templates = {name: (set(s), ix.sizes[c]) for name, c, s, _ in ix.rows}
    grant = licenses.TEMPLATES["MIT-grant"].replace("files", "thing")
    texts = texts | {10**6: f"a b {grant} c", 10**6 + 1: "RELEASED under the mit license"}
    want = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[^\w\x20\x09-\x0D]|_", "", t.lower()))
        found = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)]
        for name, (s, size) in templates.items():
            best = max((len(s & set(found[a : a + size.window])) / len(s) for a in range(0, len(found), size.step)), default=0)
            if best >= 0.8:
                want[k, name] = best
    got = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["license"]): r["containment"] for r in got} == want
    assert (10**6, "MIT-grant") in want and (10**6 + 1, "MIT") in want
