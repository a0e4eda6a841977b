"""Collocations against counting every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from sentifold.llm import phrases

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "lang", "words", "score")])
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, keep):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = f.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(_LOWER)):
            words = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(words)
            own.update(words[i : i + k] for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        often = {p: c for p, c in own.items() if c >= 100}
        inside = {(p[i : i + m], c) for p, c in often.items() for m in range(2, len(p)) for i in range(len(p) - m + 1)}
        left = []
        for p, a in often.items():
            if len(p) > 1 and (p, a) not in inside:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                left.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(left)[:keep], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def check(spark, rows, keep):
    df = spark.createDataFrame([(t, g, "clash", "clash") for t, g in rows], SCHEMA).repartition(3)
    out = phrases.mined(df, keep=keep)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {f.dataType.simpleString() for f in out.schema} == {"string", "bigint"}
    got = sorted(tuple(r) for r in out.collect())
    assert got == plain(rows, keep)
    return got


def corpus(seed, n=1500):
    rng = random.Random(seed)
    common, rare = ["the", "of", "À", "Und", "#", "a\x1cb"], ["r%d" % i for i in range(60)]
    fixed = [" ".join(rng.choices(common + rare, k=k)) for k in (2, 3, 4, 5, 6, 7)] + ["Once upon a time", "time once upon"]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 12)):
            parts.append(rng.choice(fixed) if rng.random() < 0.4 else rng.choice(common if rng.random() < 0.6 else rare))
            parts.append(rng.choice([" "] * 8 + [". ", ",", "\n", "\t ", " ; "]))
        rows.append(("".join(parts), rng.choice(["en", "en", "de", None, "und"])))
    rows += [(None, "en"), ("", "xx"), (" .;\t", "yy"), ("Ha ha " * 30_000, "de"), ("only once here", "zz")] + [("tie one", "ti"), ("tie two", "ti"), ("a tie", "ti")] * 100
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("keep", [1, 7, 2000])
def test_equals_counting_every_phrase(spark, keep):
    got = check(spark, corpus(keep), keep)
    assert {r[0] for r in got} == {"en", "de", "und", "ti"}


def test_table_of_many_keys_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FEW_KEYS", 3)
    check(spark, corpus(5, 600), 30)


def test_empty_table(spark):
    assert check(spark, [], 10) == []


def test_blocks_and_combined_rows():
    """Coding in many blocks, and rows combined in several steps, count as one pass does."""
    coder = phrases._Coder("en", 0)
    texts = [t.encode() for t, _ in corpus(3, 50) if t]
    words, seen = [], Counter()
    for t in texts:
        coder.add(t)
        hashes, ids = (np.frombuffer(x, k) for x, k in zip(coder.block(), (np.uint64, np.uint32)))
        words += hashes[ids].tolist()
        seen.update(w for w in phrases.cut(t) if w != b".")
    assert Counter(w for w in words if w) == Counter({phrases.xxhash.xxh64_intdigest(w, coder.seed): c for w, c in seen.items()})
    names = list(coder.numbers)
    assert {names[i]: c for i, c in enumerate(coder.counts.tolist()) if i} == dict(seen)
