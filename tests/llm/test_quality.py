"""Quality figures against plain counts, and the estimates on made votes."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from sentifold.llm import quality

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(covered),
    )


def test_figures(spark):
    rng = random.Random(1)
    parts = ["a", "b", "é", "日本", " ", "\n", "\t", "\x0b", "\xa0", "#", "<b>", "||", "\x1c"]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(60)))) for i in range(200)]
    rows += [(None, None), (500, ""), rows[0], rows[0], (501, "x y z " * 300), (502, "word " + "v" * 100_000)]
    out = quality.judged(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", *quality.BASE[1:])) for r in out), key=str)
    assert got == sorted(((i, *plain(t)) for i, t in rows), key=str)
    for r in out:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["posterior"] >= 0.5)


def test_empty_table(spark):
    assert quality.judged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_estimates_find_planted_accuracies():
    rng = np.random.default_rng(2)
    n, m = 20_000, len(quality.RULES)
    good = rng.random(n) < 0.8
    chance = np.where(good[:, None, None], [[[0.03, 0.17, 0.8]]], [[[0.5, 0.3, 0.2]]]).repeat(m, 1)
    votes = (rng.random((n, m, 1)) > chance.cumsum(2)).sum(2) - 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    v = quality.estimate(patterns, counts)
    assert v.good == pytest.approx(0.8, abs=0.02)
    assert np.array(v.on_good) == pytest.approx(np.array([[0.03, 0.17, 0.8]] * m), abs=0.02)
    assert np.array(v.on_bad) == pytest.approx(np.array([[0.5, 0.3, 0.2]] * m), abs=0.03)


def test_rows_weigh_as_their_number():
    rng = np.random.default_rng(3)
    votes = rng.integers(-1, 2, (500, len(quality.RULES)))
    one = quality.estimate(votes, np.ones(500))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    assert quality.estimate(patterns, counts).good == pytest.approx(one.good)


def test_against_labels(spark):
    """Clean documents stay, and what the labels call bad goes."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    out = quality.judged(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id").collect()
    clean = [r for r in out if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in out if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.98 * len(clean)
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)
