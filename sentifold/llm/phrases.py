"""Collocations per language by best-first branch-and-bound growth of phrases.

Texts in lower-case A-Z are cut into pieces at `[.,;:!?` and line ends `]`, pieces into words at blanks and tabs.  A candidate is a
phrase of 2 to `LONGEST` words that occurs `LEAST` times or more inside pieces.  Cutting it in two gives
floor(1000 * a * n / (l * r)), its counts against those of its parts; its lowest cut is its score.  A candidate inside a longer
candidate that occurs as often is dropped.  Each language keeps its first `KEEP`.

Bound.  A phrase that starts with word w has l = f(w) at its first cut and r >= a, so no phrase below the prefix w scores
more than floor(1000 * n / f(w)): rare first words come first.  The frontier is expanded in slices of falling bounds, the first
holding about 1/8 of a language's words; a phrase grows a word at a time from frequent prefixes only.  Once a language has `KEEP` survivors,
its next slice ends where the bound falls below the last of them, ties included, and nothing below it can enter.

One pass over the texts writes them as blocks of word numbers, later passes read those.  A pass knows what to count from bit tables of
2 ** 27 bits at most (a false hit is counted in vain, joins on the exact keys leave it out).  Counts are combined in the task
before they are shuffled; a phrase is known by 128 bits made of its words' 64-bit hashes.  Word hashes of frequent words are checked to differ.

Survival needs no further counting: if all occurrences of a phrase have the same frequent word before them, or behind them, that longer
phrase occurs as often, and only then; the least and greatest neighbour tell.

Defined cases: null texts are empty, a null language is `und`; repeated rows count each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import bit_table, is_set
from .common import modest_batches, utf8, written

LEAST, LONGEST, KEEP = 100, 5, 2000
# Words of a block; words that a task numbers before it starts anew; grams that a task combines at once.
BLOCK_WORDS, TASK_WORDS, COMBINED = 500_000, 400_000, 2_000_000
FIRST_SHARE, GROWTH = 1 / 8, 8
# Keys that reach the driver as they are; more come as a bit table of 2 ** MOST_BITS bits at most.
FEW_KEYS, MOST_BITS = 100_000, 27
# Parts of a language whose best are found apart.
SALTS = 64

_STOP = b"."
_CUT = bytes(b if b not in b".,;:!?\n\x0b\x0c\r" else _STOP[0] for b in bytes(range(256)).lower())
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SHIFTS = ((31, 29), (33, 27))


def cut(text: bytes) -> list[bytes]:
    """The words of a text, pieces ended by `.`, which no word contains."""
    out = text.translate(_CUT).replace(_STOP, b" . ").split()
    out.append(_STOP)
    return out


class _Numbers(dict):
    """Numbers for words, from 1 in order of appearance; 0 ends a piece."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Coder:
    """One language's words within a task."""

    def __init__(self, lang: str, seed: int):
        self.lang, self.seed = lang, xxhash.xxh64_intdigest(lang.encode(), seed)
        self.start()

    def start(self) -> None:
        self.numbers, self.counts, self.waiting, self.hashes = _Numbers({_STOP: 0}), np.zeros(1, np.int64), [], np.zeros(1, np.uint64)

    def add(self, text: bytes) -> int:
        words = cut(text)
        self.waiting.append(np.fromiter(map(self.numbers.__getitem__, words), np.uint32, len(words)))
        return len(words)

    def block(self) -> tuple[bytes, bytes] | None:
        """(hashes of the block's words, the block's words as numbers of these), as bytes."""
        if not self.waiting:
            return None
        ids, self.waiting = np.concatenate(self.waiting), []
        known = list(self.numbers)[len(self.hashes) :]
        new = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in known), np.uint64, len(known))
        self.hashes = np.concatenate([self.hashes, new])
        seen = np.bincount(ids, minlength=len(self.numbers))
        seen[0] = max(seen[0], 1)  # piece ends come first in every block
        self.counts = np.pad(self.counts, (0, len(seen) - len(self.counts))) + seen
        used = np.flatnonzero(seen)
        place = np.zeros(len(seen), np.uint32)
        place[used] = np.arange(len(used), dtype=np.uint32)
        return self.hashes[used].tobytes(), place[ids].tobytes()


_CODED = ["lang", "word", "w", "n", "hashes", "ids"]


def _coded(docs: DataFrame, lang: str, text: str, seed: int) -> DataFrame:
    """Two kinds of rows: words with their counts per task (lang, word, w, n), and blocks (hashes, ids); written."""

    def rows(columns: list) -> pa.RecordBatch:
        kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        n = next(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _CODED)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[str, _Coder] = {}
        waiting = 0

        def flushed(done: bool) -> Iterator[pa.RecordBatch]:
            blocks = [b for c in coders.values() if (b := c.block())]
            if blocks:
                yield rows([None, None, None, None, [b[0] for b in blocks], [b[1] for b in blocks]])
            if done or sum(len(c.numbers) for c in coders.values()) > TASK_WORDS:
                for c in coders.values():
                    words = list(c.numbers)[1:]
                    if words:
                        yield rows([[c.lang] * len(words), words, c.hashes[1:].view(np.int64), c.counts[1:], None, None])
                coders.clear()

        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                coder = coders.get(own) or coders.setdefault(own, _Coder(own, seed))
                waiting += coder.add(data)
                if waiting >= BLOCK_WORDS:
                    yield from flushed(False)
                    waiting = 0
        yield from flushed(True)

    cells = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), utf8(F.col(text)).alias("text"))
    return written(cells.mapInArrow(make, "lang string, word binary, w long, n long, hashes binary, ids binary"), "phrase-blocks", "zstd")


def chained(key: np.ndarray, word: np.ndarray, half: int) -> np.ndarray:
    """One half of a phrase's key, from that of the phrase without its last word."""
    a, b = _SHIFTS[half]
    x = key * _MIX[half] + word
    x = (x ^ (x >> np.uint64(a))) * _MIX[1 - half]
    return x ^ (x >> np.uint64(b))


def key_of(words: np.ndarray, half: int) -> np.ndarray:
    """Keys of phrases, one column per word."""
    key = np.full(len(words), 7, np.uint64)
    for k in range(words.shape[1]):
        key = chained(key, words[:, k], half)
    return key


class Table:
    """Which keys may be meant: all that are, and a few that are not."""

    def __init__(self, keys: DataFrame, column: str):
        n = keys.count()
        self.empty = n == 0
        self.bits = min(max(int(n).bit_length() + 5, 16), MOST_BITS)
        if n > FEW_KEYS:
            self.words = bit_table(keys.select(F.col(column).bitwiseAND((1 << self.bits) - 1).alias("at")), "at", self.bits)
            return
        own = keys.select(column).toPandas()[column].to_numpy(np.int64) & ((1 << self.bits) - 1)
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        np.bitwise_or.at(self.words, own >> 6, np.uint64(1) << (own & 63).astype(np.uint64))

    def has(self, keys: np.ndarray) -> np.ndarray:
        return is_set(self.words, (keys & np.uint64((1 << self.bits) - 1)).astype(np.int64))


def _blocks(batches: Iterator[pa.RecordBatch], frequent: Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, ids) of each block; infrequent words end a piece as its end does, with hash 0."""
    for batch in batches:
        for hashes, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(hashes, np.uint64).copy()
            own[1:][~frequent.has(own[1:])] = 0
            yield own, np.frombuffer(ids, np.uint32)


class _Combined:
    """Rows (key halves, other columns) that become one per key before they leave the task."""

    def __init__(self, folds: list):
        self.folds, self.waiting, self.n = folds, [], 0

    def add(self, columns: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
        self.waiting.append(columns)
        self.n += len(columns[0])
        if self.n >= COMBINED:
            yield from self.out(self.n // 2)

    def out(self, keep: int = 0) -> Iterator[list[np.ndarray]]:
        """All rows combined; up to `keep` of them stay for more."""
        if not self.waiting:
            return
        columns = [np.concatenate(c) for c in zip(*self.waiting, strict=True)]
        order = np.argsort(columns[0])
        columns = [c[order] for c in columns]
        a, b = columns[:2]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.empty(0, np.int64)
        columns = [f.reduceat(c, first) if f is not None and len(first) else c[first] for f, c in zip(self.folds, columns, strict=True)]
        self.waiting, self.n = [], 0
        if len(first) <= keep:
            self.waiting, self.n = [columns], len(first)
        else:
            yield columns


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names)


def _grown(blocks: DataFrame, frequent: Table, starts: Table, prefixes: Table, length: int) -> DataFrame:
    """(pa, pb, w, n): counts of phrases of `length` words, by the key of their prefix and their last word."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((frequent, starts, prefixes))
    names = ["pa", "pb", "w", "n"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, starts, prefixes = shared.value
        combined = _Combined([None, None, None, None, np.add])
        for hashes, ids in _blocks(batches, frequent):
            first = starts.has(key_of(hashes[:, None], 0)) & (hashes != 0)
            at = np.flatnonzero(first[ids[: len(ids) - length + 1]]) if len(ids) >= length else np.empty(0, np.int64)
            words = hashes[ids[at]]
            a, b = key_of(words[:, None], 0), key_of(words[:, None], 1)
            for k in range(1, length - 1):
                words = hashes[ids[at + k]]
                some = words != 0
                at, words, a, b = at[some], words[some], a[some], b[some]
                a, b = chained(a, words, 0), chained(b, words, 1)
            last = hashes[ids[at + length - 1]]
            some = last != 0
            if length > 2:
                some &= prefixes.has(a)
            a, b, last = a[some], b[some], last[some]
            rows = [chained(a, last, 0), a, b, last, np.ones(len(a), np.int64)]
            for out in combined.add(rows):
                yield _batch(out[1:], names)
        for out in combined.out():
            yield _batch(out[1:], names)

    return blocks.mapInArrow(make, "pa long, pb long, w long, n long").groupBy("pa", "pb", "w").agg(F.sum("n").alias("f"))


_AROUND = ["a", "b", "n", "before_least", "before_most", "behind_least", "behind_most"]


def _around(blocks: DataFrame, frequent: Table, wanted: Table) -> DataFrame:
    """Counts of the wanted phrases of 2 to LONGEST - 1 words, and the least and greatest word before and behind them."""
    shared = blocks.sparkSession.sparkContext.broadcast((frequent, wanted))
    schema = ", ".join(f"{c} long" for c in _AROUND)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, wanted = shared.value
        combined = _Combined([None, None, np.add, np.minimum, np.maximum, np.minimum, np.maximum])
        for hashes, ids in _blocks(batches, frequent):
            x = np.concatenate([[np.uint64(0)], hashes[ids], [np.uint64(0)]])
            at = np.flatnonzero(x)
            a, b = key_of(x[at, None], 0), key_of(x[at, None], 1)
            for k in range(1, LONGEST - 1):
                words = x[at + k]
                some = words != 0
                at, words, a, b = at[some], words[some], a[some], b[some]
                a, b = chained(a, words, 0), chained(b, words, 1)
                hit = np.flatnonzero(wanted.has(a))
                before, behind = x[at[hit] - 1].view(np.int64), x[at[hit] + k + 1].view(np.int64)
                for out in combined.add([a[hit], b[hit], np.ones(len(hit), np.int64), before, before, behind, behind]):
                    yield _batch(out, _AROUND)
        for out in combined.out():
            yield _batch(out, _AROUND)

    folds = [F.sum("n").alias("n"), *[(F.min if c.endswith("least") else F.max)(c).alias(c) for c in _AROUND[3:]]]
    return blocks.mapInArrow(make, schema).groupBy("a", "b").agg(*folds)


def _with_keys(rows: DataFrame, column: str = "words") -> DataFrame:
    """The rows with the key halves `a` and `b` of the phrase in `column` (an array of at most LONGEST word hashes)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.names.index(column)).to_pylist()
            halves = np.zeros((2, len(lists)), np.uint64)
            for size in {len(x) for x in lists}:
                at = [i for i, x in enumerate(lists) if len(x) == size]
                own = np.array([lists[i] for i in at], np.int64).view(np.uint64)
                halves[:, at] = [key_of(own, 0), key_of(own, 1)]
            halves = [pa.array(h.view(np.int64)) for h in halves]
            yield pa.RecordBatch.from_arrays([*batch.columns, *halves], [*batch.schema.names, "a", "b"])

    return rows.mapInArrow(make, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", a long, b long")


def _expanded(blocks: DataFrame, frequent: Table, words: DataFrame, start: DataFrame) -> DataFrame:
    """Survivors (lang, words, f, l, r, total, score) among the phrases that start with a word of `start`, written."""
    starts = Table(start, "a")
    level = start.select("a", "b", "lang", "total", F.array("w").alias("words"), "f", F.array().cast("array<long>").alias("lefts"))
    found = []
    for length in range(2, LONGEST + 1):
        prefixes = starts if length == 2 else Table(level, "a")
        if prefixes.empty:
            break
        grams = _grown(blocks, frequent, starts, prefixes, length).filter(F.col("f") >= LEAST).withColumnRenamed("f", "own")
        grown = grams.join(level, (grams["pa"] == level["a"]) & (grams["pb"] == level["b"]))
        grown = grown.select("lang", "total", F.concat("words", F.array("w")).alias("words"), F.col("own").alias("f"), F.concat("lefts", F.array("f")).alias("lefts"))
        level = written(_with_keys(grown), "phrases")
        found.append(level)
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    cuts = phrases.select("lang", "total", "f", F.col("a").alias("ka"), F.col("b").alias("kb"), F.col("words").alias("phrase"), F.posexplode("lefts").alias("k", "l"))
    right = F.expr("slice(phrase, k + 2, size(phrase) - k - 1)")
    cuts = written(_with_keys(cuts.withColumn("words", right).withColumn("k", F.col("k") + 1)), "phrase-cuts")
    wanted = cuts.filter(F.size("words") > 1).select("a").union(phrases.filter(F.size("words") < LONGEST).select("a")).distinct()
    around = written(_around(blocks, frequent, Table(written(wanted, "phrase-keys"), "a")), "phrase-neighbours")
    counts = around.select("a", "b", F.col("n").alias("r")).unionByName(words.select("a", "b", F.col("f").alias("r")))
    score = F.expr("cast((1000 * cast(f as decimal(19,0)) * cast(total as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as bigint)")
    scored = cuts.join(counts, ["a", "b"]).withColumn("score", score)
    lowest = scored.groupBy("ka", "kb").agg(F.min(F.struct("score", "k", "l", "r", "lang", "total", "f", "phrase")).alias("x"))
    same = lambda side: (F.col(f"{side}_least") == F.col(f"{side}_most")) & (F.col(f"{side}_least") != 0)
    longer = around.filter(same("before") | same("behind")).select(F.col("a").alias("ka"), F.col("b").alias("kb"), F.lit(True).alias("longer"))
    left = lowest.join(longer, ["ka", "kb"], "left").filter(F.col("longer").isNull() | (F.size("x.phrase") == LONGEST))
    return written(left.select("x.lang", F.col("x.phrase").alias("words"), "x.f", "x.l", "x.r", "x.total", "x.score"), "phrases-left")


def _best(rows: DataFrame, keep: int, order: list, salt) -> DataFrame:
    """Each language's first `keep` rows with their rank; parts of a language are cut first, so no task ranks all of it."""
    apart = Window.partitionBy("lang", "salt").orderBy(*order)
    rows = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(apart)).filter(F.col("rank") <= keep).drop("rank", "salt")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= keep)


def _words(coded: DataFrame) -> DataFrame:
    """(lang, word, w, a, b, f, total): frequent words, and how many words their language has; written."""
    counted = coded.filter("word is not null").groupBy("lang", "word", "w").agg(F.sum("n").alias("f"))
    counted = written(counted, "phrase-words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("total"))
    often = counted.filter(F.col("f") >= LEAST).join(totals, "lang")
    return written(_with_keys(often.withColumn("words", F.array("w"))).drop("words"), "frequent-words")


def mined(docs: DataFrame, lang: str = "lang", text: str = "text", keep: int = KEEP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score), numbers long: each language's first `keep` by score, then count, then phrase."""
    modest_batches(docs.sparkSession)
    for seed in count():
        coded = _coded(docs, lang, text, seed)
        words = _words(coded)
        if words.groupBy("w").count().filter("count > 1").isEmpty():
            break
    blocks = coded.filter("ids is not null").select("hashes", "ids")
    frequent = Table(words, "w")
    # Words of a language by the power of two their count reaches: 64 rows a language at most.
    sizes = words.groupBy("lang", "total", F.floor(F.log2("f")).alias("power")).agg(F.sum("f").alias("mass"))
    sizes = sizes.withColumn("mass", F.sum("mass").over(Window.partitionBy("lang").orderBy("power")))
    sizes = written(sizes.withColumn("upto", F.expr("cast(shiftleft(2L, cast(power as int)) - 1 as bigint)")), "phrase-sizes")
    reached, survivors, share, settled = None, None, FIRST_SHARE, None
    while True:
        limits = sizes.groupBy("lang", "total").agg(
            F.coalesce(F.max(F.when(F.col("mass") <= share * F.col("total"), F.col("upto"))), F.min("upto")).alias("upto")
        )
        if settled is not None:  # no first word above this count can start a phrase that enters
            bound = F.expr("cast((1000 * cast(total as decimal(19,0))) div score as bigint)")
            limits = limits.join(settled, "lang", "left").withColumn("upto", F.when(F.col("score") > 0, bound).otherwise(F.col("upto"))).drop("score")
        limits = written(limits.select("lang", "upto"), "phrase-limits")
        start = words.join(limits, "lang").filter("f <= upto").drop("upto")
        if reached is not None:
            start = start.join(reached.withColumnRenamed("upto", "before"), "lang").filter("f > before").drop("before")
        start = written(start, "phrase-starts")
        if start.isEmpty():
            if share >= 1 or survivors is None:
                break
        else:
            new = _expanded(blocks, frequent, words, start)
            survivors = new if survivors is None else survivors.unionByName(new)
            found = _best(survivors.select("lang", "words", "score"), keep, [F.col("score").desc()], F.pmod(F.xxhash64("words"), F.lit(SALTS)))
            settled = written(found.filter(F.col("rank") == keep).select("lang", "score"), "phrase-settled")
        reached = limits if reached is None else written(
            limits.unionByName(reached).groupBy("lang").agg(F.max("upto").alias("upto")), "phrase-limits"
        )
        share *= GROWTH
    names = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"
    if survivors is None:
        return docs.sparkSession.createDataFrame([], names)
    top = survivors.join(settled.withColumnRenamed("score", "least"), "lang", "left").filter(F.col("least").isNull() | (F.col("score") >= F.col("least")))
    top = written(top.drop("least").withColumn("id", F.monotonically_increasing_id()), "top-phrases")
    spelled = top.select("id", F.posexplode("words").alias("k", "w")).join(words.select("w", "word"), "w")
    spelled = spelled.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", F.col("word").cast("string").alias("word")))).alias("x"))
    spelled = spelled.select("id", F.concat_ws(" ", "x.word").alias("phrase"))
    out = top.join(spelled, "id").select("lang", "phrase", F.col("f").alias("a"), "l", "r", F.col("total").alias("n"), "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = _best(written(out, "spelled-phrases"), keep, order, F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
