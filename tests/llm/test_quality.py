"""The pipeline's quality rules on clean texts without listed stop words."""

import random

from markloom.llm import quality


def test_stop_words_alone_reject_nothing(spark):
    r = random.Random(4)
    made = ["".join(r.choices("aeiouklmnprstw", k=r.randint(3, 9))) for _ in range(400)]
    texts = {
        1: "Quick brown foxes jump over lazy dogs while seven wizards watch quietly nearby.",
        2: " ".join(made[:150]),
        3: " ".join(w + ("#" if k % 5 == 0 else "") for k, w in enumerate(made[150:300])),
        4: "too short",
    }
    kept = quality.keep_good(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {x["doc_id"] for x in kept} == {1, 2}
    assert all(x["text"] == texts[x["doc_id"]] for x in kept)


def test_clashing_names_come_back(spark):
    text = "Quick brown foxes jump over lazy dogs while seven wizards watch quietly nearby."
    df = spark.createDataFrame([(1, text, 7, 8, 9)], f"doc_id long, text string, {quality.P}n_words int, {quality.P}text int, `a.b` int")
    assert tuple(quality.keep_good(df).first()) == (1, text, 7, 8, 9)
    assert quality.keep_good(df).columns == df.columns


def test_stage_against_brute_force(spark):
    """Which documents of the small table stay: the rules once more, in plain Python."""
    import collections
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stop = {x.lower() for x in quality.STOP_WORDS}

    def stays(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if len(w) < 10:
            return False
        places = collections.defaultdict(list)
        for i in range(len(w) - 4):
            places[tuple(w[i : i + 5])].append(i)
        if 100 * len({j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 5)}) > 20 * len(w):
            return False
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        share = lambda x, of: sum(map(bool, x)) / of
        m = {
            "n_words": len(w), "mean_word_chars": sum(map(len, w)) / len(w), "symbol_ratio": len(re.findall(r"[#*$%&|<>]", t)) / len(w),
            "shout_ratio": share((re.search(r"[!?][!?]$", x) for x in w), len(w)), "letter_word_ratio": share((any(map(str.isalpha, x)) for x in w), len(w)),
            "stop_word_ratio": share((x.lower() in stop for x in w), len(w)), "dup_line_ratio": 1 - len(set(lines)) / len(lines),
            "bullet_line_ratio": share((re.match(r"\s*[-*•‣●]", x) for x in lines), len(lines)), "ellipsis_line_ratio": share((re.search(r"(\.\.\.|…)\s*$", x) for x in lines), len(lines)),
            "longest_word_chars": max(map(len, w)),
        }
        breaks = lambda r: (r.low is not None and m[r.measure] < r.low) or (r.high is not None and m[r.measure] > r.high)
        weak = any(map(breaks, quality.WEAK))
        return not any(breaks(r) and (not r.least_words or (len(w) >= r.least_words and weak)) for r in quality.KEEP_RULES)

    want = {r["doc_id"] for r in docs.collect() if stays(r["text"])}
    assert {r["doc_id"] for r in quality.keep_good(docs).collect()} == want and 0 < len(want) < docs.count()


def test_repeated_windows(spark):
    texts = {1: "a b c d e " * 2, 2: "a b c d e f a b c d e g", 3: " ".join("xy"[k % 2] for k in range(40)), 4: "a b c d", 5: "one two three four five six"}
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.judge(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: 10, 2: 10, 3: 40, 4: 0, 5: 0}
