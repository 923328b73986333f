"""Language identification where labels are skewed."""

import random

import pyarrow as pa
import pytest

from markloom.llm import langid

#: Invented words of two languages that share their letters.
R = random.Random(3)
WORDS = {k: ["".join(R.choices(letters, k=R.randint(3, 8))) for _ in range(150)] for k, letters in (("aa", "abcdeeefgiklmnoo"), ("bb", "aabcdefghiikllmn"))}


def text(lang, n=40):
    return " ".join(R.choices(WORDS[lang], k=n))


@pytest.mark.parametrize("rare", ["z", "kel imo", "mile gad noke libefa dinom kel", "mile gad noke libefa " * 10])
def test_rare_language_shortens_no_sample(rare):
    samples = {k: [text(k) for _ in range(100)] for k in WORDS}
    model = langid.fit(samples | {"rare": [rare]})
    want = [k for k in WORDS for _ in range(100)]
    named, _ = model.predict_all(pa.array([text(k) for k in want]))
    assert named == want
    assert len(model.tables[0][0]) > 20_000


def parsed(text, sample):
    """Greedy phrases of a text by plain search."""
    n = i = 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        n, i = n + 1, max(j - 1, i + 1)
    return n


def test_phrases_of_long_texts_against_brute_force():
    samples = {k: " ".join(R.choices(WORDS[k], k=300)) for k in WORDS}
    model = langid.fit({k: [t] for k, t in samples.items()})
    texts = [samples["aa"][100:2100], " ".join(R.choices(WORDS["bb"], k=700)), "".join(R.choices("abcdefgz ", k=2500)), "q", "", "zz zz", samples["bb"] + samples["aa"]]
    texts = [" ".join(t.split()) for t in texts] + [text("aa", n) for n in range(1, 120)]
    assert model.phrases([model.codes(t) for t in texts]).tolist() == [[parsed(t, samples[k]) for k in model.languages] for t in texts]
    assert model.phrases([model.codes(texts[0])])[0, 0] == 1  # one phrase, however long


@pytest.mark.parametrize("few", [0, 8, 1_000_000])
def test_phrases_of_texts_that_share_lanes(monkeypatch, few):
    samples = {k: " ".join(R.choices(WORDS[k], k=100)) for k in WORDS}
    model = langid.fit({k: [t] for k, t in samples.items()})
    monkeypatch.setattr(langid, "FEW", few)
    monkeypatch.setattr(langid, "LANES", 14)
    sizes = [300, 0, 1, 40, 41, 40, 2, 90] + [R.randint(0, 30) for _ in range(60)]
    texts = [" ".join(R.choices(WORDS[R.choice("aa bb".split())], k=n)) for n in sizes] + ["", "q", "q q", "a", samples["bb"]]
    assert model.phrases([model.codes(t) for t in texts]).tolist() == [[parsed(t, samples[k]) for k in model.languages] for t in texts]
    assert model.phrases([]).shape == (0, 2) and model.phrases([model.codes("")]).tolist() == [[0, 0]]


def test_all_letters_are_learned():
    han = [chr(0x4E00 + k) for k in range(3000)]
    han_text = lambda: "".join(R.choices(han, k=4000))
    own, other = han_text(), han_text()
    model = langid.fit({"own": [own], "other": [other], "aa": [text("aa")], "bb": [text("bb")]})
    assert len(set(model.alphabet)) > 2000 and sum(len(c) for _, c, _ in model.tables) < 60 * 9000
    assert model.predict([own[500:520], other[3000:3030], text("aa"), text("bb")])[0] == ["own", "other", "aa", "bb"]


def test_short_held_out_texts():
    samples = {k: [text(k) for _ in range(100)] for k in WORDS}
    model = langid.fit(samples)
    want = [k for k in WORDS for _ in range(200)]
    named, _ = model.predict([text(k, 5) for k in want])
    assert sum(a == b for a, b in zip(named, want)) >= 0.97 * len(want)


def test_many_languages_and_one_with_most_rows(spark):
    rows = [(7, text("aa"), "aa")] * 500 + [(1000 + k, text("bb", 3), f"x{k}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, langid.F.lit(True))
    assert len(model.languages) == 151
    assert langid.predict(docs, model).filter("lang_pred = 'aa'").count() >= 500


def test_stage_fills_null_languages(spark):
    rows = [(k, text(lang), lang if k % 3 else None) for k, lang in enumerate(["aa", "bb"] * 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = langid.keep_identified(docs, langid.train(docs, ~langid.held_out(), limits=True)).collect()
    assert len(kept) == 200 and all(r["lang"] == ("aa", "bb")[r["doc_id"] % 2] for r in kept)


def test_stage_keeps_learned_languages_and_rejects_others(spark):
    rows = [(k, text(lang), lang) for k, lang in enumerate(["aa", "bb"] * 100)]
    rows += [(1000 + k, "".join(R.choices("qrstuvwxyzhgf     ", k=300)), None) for k in range(5)] + [(2000, "12 34", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = langid.keep_identified(docs, langid.train(docs, ~langid.held_out(), limits=True)).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(200))


def test_stage_keeps_all_where_nothing_is_learned(spark):
    docs = spark.createDataFrame([(1, "some plain words", None), (2, "more of them", None)], "doc_id long, text string, lang string")
    assert langid.keep_identified(docs, langid.train(docs, ~langid.held_out(), limits=True)).count() == 2
