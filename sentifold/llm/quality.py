"""Quality rules as weak supervision.

Each rule votes bad (-1), good (+1) or abstains (0).  Expectation-maximisation over the histogram of all vote
patterns estimates how each rule votes on good and on bad documents; the posterior probability of a good
document decides.  The histogram has at most 3 ** len(RULES) rows whatever the corpus, so it may visit the
driver; features and posterior are computed where the documents are.

Defined cases: a null text counts as empty (no words, base rules fail); repeated rows get equal results; an empty
table gives no rows and leaves the prior; other columns are carried along, and those that clash with a result
column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest_batches, utf8, written

FEATURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_lower",
    "n_bang",
    "n_bar",
    "n_symbol_words",
    "n_top_word",
)
BASE = FEATURES[:5]
FEATURE_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in FEATURES])

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
# Bytes that start no code point of a word: white space and UTF-8 continuation bytes.
_NOT_IN_WORDS = SPACE + bytes(range(0x80, 0xC0))


def _repeated(ids: np.ndarray, n_ids: int) -> int:
    """Words covered by a 3-word window that occurs twice or more."""
    if len(ids) < 4:
        return 0
    pair = ids[:-1] * n_ids + ids[1:]
    if n_ids > 2_000_000:  # keep three ids within 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, counts = np.unique(pair[:-1] * n_ids + ids[2:], return_inverse=True, return_counts=True)
    again = counts[at] >= 2
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= again
    return int(covered.sum())


def features_of(text: bytes) -> tuple[int, ...]:
    """The figures of one whole text, in the order of FEATURES."""
    words = text.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(text)
    return (
        len(words),
        len(text.translate(None, _NOT_IN_WORDS)),
        size - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(ids, len(known)),
        len(lines),
        size - len(text.translate(None, _UPPER)),
        size - len(text.translate(None, _LOWER)),
        text.count(b"!!"),
        words.count(b"|"),
        sum(w[-1] in SYMBOLS for w in words),
        int(np.bincount(ids).max()) if len(ids) else 0,
    )


@F.pandas_udf(FEATURE_TYPE)
def _features(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([features_of(bytes(t)) for t in batch], columns=list(FEATURES), dtype="int64")


def _share(part: str, of: Column) -> Column:
    return F.col(part) / F.greatest(of, F.lit(1))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Each rule's vote, from the feature columns."""
    n = F.col("n_words")
    letters = F.col("n_upper") + F.col("n_lower")
    mean_chars = _share("word_chars", n)
    return {
        "length": _vote(n < 50, n >= 120),
        "symbols": _vote(_share("n_symbols", n) > 0.25, _share("n_symbols", n) < 0.02),
        "symbol_words": _vote(_share("n_symbol_words", n) > 0.1, _share("n_symbol_words", n) < 0.01),
        "lines": _vote(
            (F.col("n_dup_lines") >= 3) & (_share("n_dup_lines", F.col("n_lines")) > 0.3),
            (F.col("n_dup_lines") == 0) & (F.col("n_lines") > 1),
        ),
        "windows": _vote(_share("n_repeat_words", n) > 0.3, _share("n_repeat_words", n) < 0.1),
        "top_word": _vote(_share("n_top_word", n) > 0.2, _share("n_top_word", n) < 0.12),
        "capitals": _vote(_share("n_upper", letters) > 0.3, _share("n_upper", letters) < 0.08),
        "shouting": _vote(_share("n_bang", n) > 0.1, F.col("n_bang") == 0),
        "table": _vote(_share("n_bar", n) > 0.05, F.col("n_bar") == 0),
        "word_length": _vote((mean_chars < 2.5) | (mean_chars > 12), (mean_chars >= 3.5) & (mean_chars <= 9)),
    }


RULES = ("length", "symbols", "symbol_words", "lines", "windows", "top_word", "capitals", "shouting", "table", "word_length")


@dataclass(frozen=True)
class Voting:
    """Estimates: share of good documents, and each rule's chances of (-1, 0, +1) on bad and on good documents."""

    good: float
    on_bad: tuple[tuple[float, float, float], ...]
    on_good: tuple[tuple[float, float, float], ...]

    def posterior(self) -> Column:
        """Probability that a document is good, from its vote columns."""
        odds = F.lit(math.log(self.good) - math.log1p(-self.good))
        for rule, bad, good in zip(RULES, self.on_bad, self.on_good, strict=True):
            ratio = [math.log(g) - math.log(b) for b, g in zip(bad, good, strict=True)]
            vote = F.col(f"vote_{rule}")
            odds += F.when(vote < 0, ratio[0]).when(vote > 0, ratio[2]).otherwise(ratio[1])
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 20.0) -> Voting:
    """Expectation-maximisation over (vote pattern, number of documents).

    The classes are named by the start: a document starts as bad as the share of bad votes among its votes says,
    and pseudo-counts (`prior` documents per class and rule) hold every rule to voting bad more often on bad
    documents, so that the two classes cannot change places and no chance reaches 0 or 1.
    """
    n_rules = len(RULES)
    votes = np.asarray(patterns, dtype=np.int64).reshape(-1, n_rules)
    weight = np.asarray(counts, dtype=float)
    n_bad, n_good = (votes < 0).sum(1), (votes > 0).sum(1)
    start = 1 / (1 + np.exp(-(n_good - 4.0 * n_bad)))
    hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    base_bad, base_good = prior * np.array([0.6, 0.3, 0.1]), prior * np.array([0.02, 0.28, 0.7])
    p = start
    for _ in range(rounds):
        good = (weight @ p + 0.8 * prior) / (weight.sum() + prior)
        on = []
        for share, base in ((1 - p, base_bad), (p, base_good)):
            table = np.einsum("i,irv->rv", weight * share, hot) + base
            on.append(table / table.sum(1, keepdims=True))
        odds = math.log(good / (1 - good)) + np.einsum("irv,rv->i", hot, np.log(on[1]) - np.log(on[0]))
        new = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        moved, p = np.abs(new - p).max(initial=0), new
        if moved < 1e-12:
            break
    return Voting(float(good), tuple(map(tuple, on[0].tolist())), tuple(map(tuple, on[1].tolist())))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with feature and vote columns."""
    modest_batches(docs.sparkSession)
    own = {*FEATURES, *(f"vote_{r}" for r in RULES), "posterior", "base_failed", "kept", "figures_"}
    out = docs.drop(*[c for c in docs.columns if c in own and c != text])
    out = out.withColumn("figures_", _features(utf8(F.col(text))))
    out = out.withColumns({n: F.col(f"figures_.{n}") for n in FEATURES}).drop("figures_")
    return out.withColumns({f"vote_{r}": v for r, v in rules().items()})


def fit(voted: DataFrame) -> Voting:
    """Estimates from the votes on all rows."""
    names = [f"vote_{r}" for r in RULES]
    rows = voted.groupBy(*names).count().orderBy(*names).collect()  # at most 3 ** len(RULES)
    return estimate(np.array([r[:-1] for r in rows]), np.array([r["count"] for r in rows]))


def judged(docs: DataFrame, text: str = "text", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """The rows (or their columns `carry`) with features, votes, posterior, `base_failed` and `kept`.

    The votes are needed twice.  With `carry`, narrow rows are written in between; whole rows are counted and voted on
    twice instead, as a copy of all texts costs more than that.
    """
    voted = with_features(docs, text)
    if carry is not None:
        voted = written(voted.drop(*[c for c in docs.columns if c not in carry]), "votes")
    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    return (
        voted.withColumn("posterior", fit(voted).posterior())
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= threshold))
    )
