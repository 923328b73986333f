"""Keys that hold a large share of all rows: joins split them, results stay whole."""

import random

from pyspark.sql import functions as F

from markloom.llm import neardup, warc
from markloom.llm.common import PART, Scratch, salted_join


def test_salted_join(spark):
    left = spark.createDataFrame([(k, 1 if k % 3 else k) for k in range(5 * PART)] + [(10**6, None)], "id long, key long")
    right = spark.createDataFrame([(1, "one"), (3, "three"), (3, "drei"), (10**7, "none")], "key long, v string")
    scratch = Scratch(spark, "t")
    for how in ("inner", "left"):
        want = left.join(right, "key", how).select("id", "key", "v")
        got = salted_join(left, right, "key", "id", scratch, how).select("id", "key", "v")
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    hot = scratch.spark.read.parquet(f"{scratch.root}/1-hot").collect()
    assert [tuple(x) for x in hot] == [(1, 4)]


def test_common_sets_and_large_groups(spark):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**6)}"
    same, base = " ".join(word() for _ in range(30)), [word() for _ in range(200)]
    texts = [same] * (2 * PART + 5)
    for _ in range(PART + 300):
        w = list(base)
        w[r.randrange(200)] = word()
        texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(20)) for _ in range(40)]
    r.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(df).collect()}
    first = {}
    kind = lambda t: t if t == same else "near" if len(set(t.split()) & set(base)) > 180 else t
    for k, t in enumerate(texts):
        first.setdefault(kind(t), k)
    assert got == {k: first[kind(t)] for k, t in enumerate(texts)}


def test_equal_ids_with_different_texts(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta"
    df = spark.createDataFrame([(1, "b " + long, 1), (1, "a one two three four five", 2), (2, long + " iota", 3), (2, long + " iota", 3), (None, long, 4)], "doc_id long, text string, x int")
    for d in (df, df.orderBy(F.desc("x")).coalesce(1)):
        got = sorted(neardup.keep_first(d).collect(), key=str)
        assert [(r["doc_id"], r["x"]) for r in got if r["doc_id"] != 2] == [(1, 2), (None, 4)]


def test_a_payload_with_most_of_the_pages(spark):
    big = "<p>" + "x" * 1500
    df = spark.createDataFrame([(k, "http://a/", big) for k in range(2 * PART)] + [(10**6, "http://b/", "<p>")], "page_id long, url string, html string")
    got = warc.archive(df).groupBy("record_type", "refers_to").count().collect()
    assert {(r[0], r[1], r[2]) for r in got} == {("revisit", 2 * PART - 1, 2 * PART - 1), ("response", None, 2)}
