"""Scores against a model written as a plain walk over a dictionary trie."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from sentifold.llm import ppm

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType())])


def held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def plain(rows):
    """(held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    texts = [(i, (t or "").encode().lower()) for i, t in rows]
    words, trie = Counter(), defaultdict(Counter)
    for i, t in texts:
        if held_out(i):
            continue
        words.update([*t.split(), None])
        symbols = [ppm.BEFORE] * ppm.ORDER + list(t) + [ppm.END]
        for p in range(ppm.ORDER, len(symbols)):
            for k in range(ppm.ORDER + 1):
                trie[tuple(symbols[p - k : p])][symbols[p]] += 1
    n_all, n_kinds = sum(words.values()), len(words)
    for i, t in texts:
        tokens = [*t.split(), None]
        base = sum(math.log10((words[w] + 0.1) / (n_all + 0.1 * (n_kinds + 1))) for w in tokens)
        symbols = [ppm.BEFORE] * ppm.ORDER + list(t) + [ppm.END]
        score = 0.0
        for p in range(ppm.ORDER, len(symbols)):
            excluded = set()
            for k in range(ppm.ORDER, -1, -1):
                seen = {s: n for s, n in trie.get(tuple(symbols[p - k : p]), {}).items() if s not in excluded}
                if not seen:
                    continue
                chances = sum(seen.values()) + len(seen)
                if symbols[p] in seen:
                    score += math.log10(seen[symbols[p]] / chances)
                    break
                score += math.log10(len(seen) / chances)
                excluded |= set(seen)
            else:
                score -= math.log10(ppm.ALPHABET - len(excluded))
        yield held_out(i), len(tokens), sum(words[w] > 0 for w in tokens), n_all, base, score


def check(spark, rows, **sizes):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    got = sorted(map(tuple, ppm.scored(df, **sizes).collect()), key=repr)
    want = sorted(((i, *x) for (i, _), x in zip(rows, plain(rows), strict=True)), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_random_texts(spark):
    rng = random.Random(3)
    words = ["the", "The", "of", "river", "éè", "x\ty", "\n", "end", "aaaa"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(80)]
    rows += [(200, "wholly Other zq"), (None, None), (7, None), (5, ""), (rows[3]), (rows[3]), (300, "long " * 3000)]
    check(spark, rows)


def test_small_blocks_and_steps_change_nothing(spark):
    rng = random.Random(4)
    check(spark, [(i, "".join(rng.choices("ab \n", k=rng.randrange(60)))) for i in range(60)], block_bytes=300, step_bytes=100)


def test_nothing_to_learn_from(spark):
    out = next(i for i in range(100) if held_out(i))
    check(spark, [(out, "only held out")])


def test_empty_table(spark):
    assert ppm.scored(spark.createDataFrame([], SCHEMA)).collect() == []
