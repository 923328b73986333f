"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from markloom.llm import bpe, html_text, langid, licenses, media, neardup, packing, pii, quality, warc

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
OPERATORS = {
    "licenses": lambda d: licenses.scan(d),
    "neardup": lambda d: neardup.near_duplicates(d),
    "html": lambda d: html_text.extract(d, "doc_id", "source", "text"),
    "quality": lambda d: quality.judge(d),
    "warc": lambda d: warc.archive(d, "doc_id", "source", "text"),
    "pii": lambda d: pii.find(d),
    "langid": lambda d: langid.identify(d),
    "packing": lambda d: packing.pack(d, WORD),
    "media": lambda d: media.media_round_trip(d),
    "bpe": lambda d: bpe.round_trip(d, BYTE),
}


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(random.Random(1).choices("the of and word thing other".split(), k=30_000))
    texts = [None, "", " \n\t", "one", "a b c d e f g", "a b c d e f g", long, long, "x" * 50_000, "mail a@b.co +1 (743) 555-3824", "漢字 é 😀 ́"]
    rows = [(k, t, "en" if k % 2 else None, None if k == 3 else "http://x/", -1, "n", [1]) for k, t in enumerate(texts)]
    rows += [(None, "a b c d e f g", None, None, None, None, None), (4, "a b c d e f g", "en", "u", 1, "n", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, __row string, ids array<int>")


@pytest.mark.parametrize("name", OPERATORS)
def test_rows(docs, name):
    out = OPERATORS[name](docs).collect()
    if name == "licenses":
        assert out == []
    elif name == "packing":
        assert len(out) >= docs.count()
    else:
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(docs, name):
    assert OPERATORS[name](docs.filter("false")).collect() == []


def test_pipeline_stages(docs, spark):
    import corpus_pipeline

    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    for d in (docs, docs.filter("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, "")
            assert out.columns == d.columns, name
            assert out.count() <= d.count()
        corpus_pipeline.STAGES[-1][1](spark, d, "").collect()
