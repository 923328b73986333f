"""Stored media: what is read back comes from the packs, and damage shows."""

import os
import random
import re

import numpy as np
import pytest

from markloom.llm import media
from markloom.llm.common import PART, Scratch


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.fixture
def texts():
    r = random.Random(2)
    shared = "".join(r.choices("abcdefgh ij", k=60_000))
    return ["", None, "é😀", "same", "same", shared, "x" * 777 + shared, shared + "tail", "".join(r.choices("xyz ", k=9000))]


def test_round_trip_and_shared_chunks(spark, texts):
    scratch = Scratch(spark, "t")
    rows, root = media.store(table(spark, texts), scratch)
    lists = media.recipes(rows, scratch).collect()
    stored = {(c["place"]["pack"], c["place"]["offset"]): c["digest"] for r in lists for c in r["chunks"]}
    assert len(lists) == len({t or "" for t in texts})
    assert len(stored) == len(set(stored.values()))  # one place for each different chunk
    assert len(stored) < sum(len(r["chunks"]) for r in lists)  # and texts share some
    assert os.listdir(root.removeprefix("file://"))


def test_values(spark, texts):
    got = {r["doc_id"]: r for r in media.media_round_trip(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        p = np.frombuffer(media.payload_of(data), np.uint8)
        assert got[k]["n_bytes"] == len(data) and got[k]["payload_bytes"] == len(p)
        share = np.bincount(p) / len(p)
        want = {
            "seconds": len(p) / 8000, "mean": p.mean() - 128, "rms": np.sqrt(((p - 128.0) ** 2).mean()), "low": p.min(), "high": p.max(),
            "crossings": np.count_nonzero(np.diff((p >= 128).astype(int))), "entropy": -(share[share > 0] * np.log2(share[share > 0])).sum(),
        }
        found = {a: float(b) for a, b in re.findall(r"(\w+)=([-\d.]+)", got[k]["feature"])}
        assert found == pytest.approx(want, abs=1e-3)
    assert got[3]["feature"] == got[4]["feature"] and got[0]["media_sha256"] == got[1]["media_sha256"]


@pytest.mark.parametrize("damage", ["flip", "cut", "lose"])
def test_damage_is_seen(spark, texts, damage):
    scratch = Scratch(spark, "t")
    rows, root = media.store(table(spark, texts), scratch)
    lists = scratch.write(media.recipes(rows, scratch), "recipes")
    place = max((c["place"] for r in lists.collect() for c in r["chunks"]), key=lambda x: x["length"])
    path = f"{root.removeprefix('file://')}/{place['pack']}"
    data = bytearray(open(path, "rb").read())
    if damage == "lose":
        os.remove(path)
    else:
        data[place["offset"] + place["length"] // 2] ^= 64
        open(path, "wb").write(data if damage == "flip" else data[: place["offset"] + place["length"] - 1])
    with pytest.raises(Exception, match="damaged|cut off|digest|No such file|Failed to open"):
        media.restore(lists, root).collect()


def test_a_text_with_most_of_the_rows(spark):
    texts = ["hot"] * (3 * PART) + [f"t{k}" for k in range(50)]
    got = media.media_round_trip(table(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    assert len({r["payload_sha256"] for r in got}) == 51
