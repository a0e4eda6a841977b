"""Correlated pairs and the choice among them against loops over all pairs."""

import datetime as dt

import numpy as np
import pytest

from sentifold.plans import correlation

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(n) for n in range(61)]


@pytest.fixture(scope="module")
def market(spark):
    """240 symbols that follow six factors closely or not, some with gaps, one flat, one short, one without a close."""
    rng = np.random.default_rng(3)
    factors = rng.normal(size=(6, 60))
    rows, returns = [], {}
    for n in range(240):
        move = 0.01 * (factors[n % 6] * rng.uniform(0, 3) + rng.normal(size=60))
        close = 100 * np.concatenate([[1], np.cumprod(1 + move)])
        gaps = set(rng.choice(60, size=int(rng.integers(0, 3)), replace=False) + 1)
        kept = [(DAYS[i], float(close[i])) for i in range(61) if i not in gaps]
        rows += [(f"s{n:03}", d, c) for d, c in kept]
        returns[f"s{n:03}"] = {d: c / b - 1 for (_, b), (d, c) in zip(kept, kept[1:])}
    rows += [("flat", d, 5.0) for d in DAYS] + [("short", d, float(k)) for k, d in enumerate(DAYS[-9:], 1)] + [("none", DAYS[0], None)]
    bars = spark.createDataFrame(rows, "symbol string, day date, close double").repartition(5)
    v = {s: np.array([r.get(d, 0.0) for d in DAYS[1:]]) for s, r in returns.items()}
    return bars, v


def brute(v, limit):
    names = sorted(v)
    c = np.corrcoef([v[s] for s in names])
    return {(names[i], names[j]): c[i, j] for i in range(len(names)) for j in range(i + 1, len(names)) if c[i, j] > limit}


@pytest.mark.parametrize(("limit", "per_block"), [(0.7, 2000), (0.7, 7), (0.85, 2000), (-0.2, 50)])
def test_every_pair_is_found(market, limit, per_block):
    bars, v = market
    vectors = correlation.return_vectors(bars, bars.select("symbol").distinct(), 60)
    got = {(r["symbol_a"], r["symbol_b"]): r["correlation"] for r in correlation.close_pairs(vectors, limit, per_block).collect()}
    wanted = brute(v, limit)
    assert len(wanted) > 20 and got.keys() == wanted.keys()
    assert all(abs(got[k] - wanted[k]) < 1e-9 for k in wanted)


def test_no_rows(spark, market):
    bars, _ = market
    nobody = bars.select("symbol").limit(0)
    assert correlation.correlated_pairs(bars, nobody).isEmpty()
    assert correlation.correlated_pairs(bars.limit(0), nobody).isEmpty()
    with pytest.raises(ValueError):
        correlation.correlated_pairs(bars, nobody, limit=1.0)


def greedy(ranks, pairs):
    stay = []
    for s in sorted(ranks, key=lambda s: (ranks[s] is None, -(ranks[s] or 0), s)):
        if not any((min(s, t), max(s, t)) in pairs for t in stay):
            stay.append(s)
    return set(stay)


def test_choice(spark):
    rng = np.random.default_rng(4)
    names = [f"s{k:02}" for k in range(60)]
    pairs = {tuple(sorted(rng.choice(names, 2, replace=False).tolist())) for _ in range(150)} | {("s00", "zz")}
    ranks = {s: None if k % 11 == 0 else float(rng.integers(0, 8)) for k, s in enumerate(names)}
    links = spark.createDataFrame([(*p, 0.9) for p in sorted(pairs)], "symbol_a string, symbol_b string, correlation double")
    rows = [(s, p) for s, p in ranks.items()]
    candidates = spark.createDataFrame([*rows, rows[0]], "symbol string, confidence double")
    got = [r["symbol"] for r in correlation.uncorrelated(candidates, links, "confidence").collect()]
    wanted = greedy(ranks, pairs)
    assert set(got) == wanted and len(got) == len(wanted) + ("s00" in wanted)
    free = {r["symbol"] for r in correlation.uncorrelated(candidates, links).collect()}
    inside = {p for p in pairs if p[1] != "zz"}
    assert not any(a in free and b in free for a, b in inside)
    assert all(any(s in p and set(p) - {s} <= free for p in inside) for s in set(names) - free)
