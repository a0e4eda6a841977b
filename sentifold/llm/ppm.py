"""Scoring texts by prediction by partial matching, and by counts of words.

The model is a trie of byte contexts: a node is a context of up to `ORDER` bytes with the counts of what followed it
in the training texts, its parent the context without its first byte.  A byte is coded at the longest context
that has seen it; every context passed on the way costs an escape (as many chances as it has different followers),
and the followers of a longer context are excluded at the next shorter one.  As contexts are nested, what is
excluded there depends on the longer context only, so three sums per context (`total`, `kinds`, and `shared`: the
counts that its followers have at its parent) give every probability, and the code length of a byte is a function of
the last `ORDER` + 1 bytes, its gram.

So the work is on distinct grams and words, not on positions.  Documents are dealt into blocks of some megabytes; a block
gives its distinct grams and words with training counts, these are summed over blocks, grams get their log
probability by joins along the trie, and every block gets back the entries it needs.  Neither the trie nor the
vocabulary is held anywhere as a whole.

Defined cases: a null text is empty and consists of the end alone; a null id counts as the empty text where ids
are hashed; a repeated row is learned and scored as often as it occurs; with no training text every byte is
equally likely; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest_batches, utf8, written

ORDER = 4
# Bytes that UTF-8 never uses: the end of a text, and what stands before its first byte.
END, BEFORE = 0xFE, 0xFF
# Symbols that may be coded: all bytes but BEFORE.
ALPHABET = 255
# Bytes of text per block, and per step of the work on a block.
BLOCK, STEP = 16_000_000, 2_000_000


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, held_out) in blocks, each a compressed Arrow stream."""
    task = TaskContext.get().partitionId()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    part, size, n = [], 0, 0

    def closed() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part[0].schema, options=options) as stream:
            for x in part:
                stream.write_batch(x)
        return pa.RecordBatch.from_arrays(
            [pa.array([task << 32 | n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "docs"]
        )

    for batch in batches:
        at = 0
        while at < batch.num_rows:  # a batch of long texts may go to several blocks
            sizes = np.cumsum([len(t) + 16 for t in batch.column(1).slice(at).to_pylist()])
            take = int(np.searchsorted(sizes, block_bytes - size)) + 1
            part.append(batch.slice(at, take))
            size += int(sizes[min(take, len(sizes)) - 1])
            at += take
            if size >= block_bytes:
                yield closed()
                part, size, n = [], 0, n + 1
    if part:
        yield closed()


def _steps(table: pa.Table, step_bytes: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, lower-case texts) of consecutive rows of about `step_bytes`."""
    texts = [t.lower() for t in table.column("text").to_pylist()]
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= step_bytes or i + 1 == len(texts):
            yield first, i + 1, texts[first : i + 1]
            first, size = i + 1, 0


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All grams of some texts, and where each text's begin."""
    before, end = bytes([BEFORE] * ORDER), bytes([END])
    octets = np.frombuffer(b"".join(before + t + end for t in texts), dtype=np.uint8)
    n = len(octets) - ORDER
    grams = np.zeros(max(n, 0), dtype=np.int64)
    for k in range(ORDER + 1):
        grams = (grams << 8) | octets[k : n + k]
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return grams[octets[ORDER:] != BEFORE], np.cumsum(sizes) - sizes


def _opened(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _keys(batches: Iterator[pa.RecordBatch], step_bytes: int) -> Iterator[pa.RecordBatch]:
    """Each block's distinct words and grams with the number of times its training texts have them."""
    for batch in batches:
        for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            table = _opened(blob)
            held = table.column("held_out").to_numpy()
            words: Counter[bytes] = Counter()
            others: set[bytes] = set()
            grams, counts = np.empty(0, np.int64), np.empty(0, np.int64)
            for i, j, texts in _steps(table, step_bytes):
                for t, out in zip(texts, held[i:j], strict=True):
                    others.update(t.split()) if out else words.update(t.split())
                for out in (False, True):
                    some = [t for t, h in zip(texts, held[i:j], strict=True) if h == out]
                    if some:
                        new, n = np.unique(grams_of(some)[0], return_counts=True)
                        merged, at = np.unique(np.concatenate([grams, new]), return_inverse=True)
                        summed = np.zeros(len(merged), np.int64)
                        np.add.at(summed, at, np.concatenate([counts, 0 * n if out else n]))
                        grams, counts = merged, summed
            names = [*words, *others.difference(words)]
            times = np.zeros(len(names), np.int64)
            times[: len(words)] = list(words.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(names) + len(grams), block)),
                    pa.array(names + [None] * len(grams), pa.binary()),
                    pa.array(np.concatenate([np.zeros(len(names), np.int64), grams])),
                    pa.array(np.concatenate([times, counts])),
                ],
                ["block", "word", "gram", "n"],
            )


def _suffix(gram: str, order: int) -> Column:
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def log_probabilities(grams: DataFrame) -> DataFrame:
    """(gram, log10 probability) for every counted gram, also those never seen in training (n = 0)."""
    counted = {ORDER: grams.filter("n > 0")}
    for k in range(ORDER - 1, -1, -1):
        below = counted[k + 1].groupBy(_suffix("gram", k).alias("gram")).agg(F.sum("n").alias("n"))
        counted[k] = written(below, f"order-{k}")
    contexts = {}
    for k in range(ORDER, -1, -1):
        rows = counted[k].withColumn("context", F.shiftright("gram", 8))
        if k:
            up = counted[k - 1].select(F.col("gram").alias("lower"), F.col("n").alias("n_lower"))
            rows = rows.withColumn("lower", _suffix("gram", k - 1)).join(up, "lower")
        else:
            rows = rows.withColumn("n_lower", F.lit(0))
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("n_lower").alias("shared"))
        contexts[k] = written(sums, f"contexts-{k}")
    here = contexts[ORDER].withColumnRenamed("context", "context_")
    known = counted[ORDER].join(here, F.shiftright("gram", 8) == F.col("context_"))
    known = known.select("gram", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("log_p"))

    unseen = grams.filter("n = 0").select("gram")
    for k in range(ORDER, -1, -1):
        if k < ORDER:  # nothing was seen at the highest order
            seen = counted[k].select(F.col("gram").alias("key_"), F.col("n").alias(f"n_{k}"))
            unseen = unseen.join(seen, _suffix("gram", k) == F.col("key_"), "left").drop("key_")
        node = contexts[k].select(F.col("context").alias("key_"), *[F.col(c).alias(f"{c}_{k}") for c in ("total", "kinds", "shared")])
        unseen = unseen.join(node, F.shiftright(_suffix("gram", k), 8) == F.col("key_"), "left").drop("key_")
    log_p, out_n, out_kinds, done = F.lit(0.0), F.lit(0), F.lit(0), F.lit(False)
    for k in range(ORDER, -1, -1):
        there = F.col(f"total_{k}").isNotNull()
        kinds = F.col(f"kinds_{k}") - out_kinds
        chances = F.col(f"total_{k}") - out_n + kinds
        hit = F.col(f"n_{k}").isNotNull() if k < ORDER else F.lit(False)
        cost = F.when(done, 0.0)
        if k < ORDER:
            cost = cost.when(hit, F.log10(F.col(f"n_{k}") / chances))
        log_p = log_p + cost.when(there & (kinds > 0), F.log10(kinds / chances)).otherwise(0.0)
        out_n = F.when(there, F.col(f"shared_{k}")).otherwise(0)
        out_kinds = F.when(there, F.col(f"kinds_{k}")).otherwise(0)
        done = done | hit
    log_p = log_p - F.when(done, 0.0).otherwise(F.log10(F.lit(ALPHABET) - out_kinds))
    return written(known.unionByName(unseen.select("gram", log_p.alias("log_p"))), "log-probabilities")


def _score(n_train: int, n_kinds: int, n_ends: int, step_bytes: int, fields: list[str]):
    all_chances = n_train + 0.1 * (n_kinds + 1)

    def score(docs: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        parts = []
        is_word = entries["word"].notna().to_numpy()
        back = entries[is_word]
        totals = dict(zip(back["word"], back["n"], strict=True))
        at_gram = entries[~is_word].sort_values("gram")
        grams, log_p = at_gram["gram"].to_numpy(), at_gram["value"].to_numpy()
        for blob in docs["docs"]:
            table = _opened(bytes(blob))
            held = table.column("held_out").to_numpy()
            local: Counter[bytes] = Counter()
            for i, j, texts in _steps(table, step_bytes):
                for t, out in zip(texts, held[i:j], strict=True):
                    if not out:
                        local.update(t.split())
            local.update({w: n - local[w] for w, n in totals.items()})  # all counts are now those of all blocks
            for i, j, texts in _steps(table, step_bytes):
                found, starts = grams_of(texts)
                scores = np.add.reduceat(log_p[np.searchsorted(grams, found)], starts)
                rows = []
                for t in texts:
                    counts = np.array([*[local.get(w, 0) for w in t.split()], n_ends], dtype=float)
                    rows.append((len(counts), int((counts > 0).sum()), float(np.log10((counts + 0.1) / all_chances).sum())))
                n_tokens, n_known, base = zip(*rows, strict=True)
                parts.append(
                    pd.DataFrame(
                        {
                            "doc_id": table.column("doc_id").slice(i, j - i).to_pandas(integer_object_nulls=True),
                            "held_out": held[i:j],
                            "n_tokens": n_tokens,
                            "n_known": n_known,
                            "train_tokens": n_train,
                            "base_score": base,
                            "score": scores,
                        }
                    )
                )
        return pd.concat(parts) if parts else pd.DataFrame(columns=fields)

    return score


def scored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK, step_bytes: int = STEP) -> DataFrame:
    """One row per document with its base score and its log10 probability under the model."""
    modest_batches(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType
    held = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0
    source = docs.select(F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("text"), held.alias("held_out"))
    blocks = written(source.mapInArrow(lambda x: _blocks(x, block_bytes), "block long, docs binary"), "blocks")
    keys = written(blocks.mapInArrow(lambda x: _keys(x, step_bytes), "block long, word binary, gram long, n long"), "keys")

    by_word = Window.partitionBy("word")
    words = keys.filter("word IS NOT NULL").select("block", "word", "n", F.sum("n").over(by_word).alias("total"))
    words = written(words.withColumn("first", F.row_number().over(by_word.orderBy("block")) == 1), "words")
    n_words, n_kinds = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("first") & (F.col("total") > 0)).cast("long")), F.lit(0))
    ).first()
    n_ends = source.filter("NOT held_out").count()

    grams = keys.filter("word IS NULL").select("block", "gram", "n")
    summed = written(grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    values = log_probabilities(summed)
    entries = words.filter("total != n").select("block", "word", F.lit(0).cast("long").alias("gram"), F.col("total").alias("n"), F.lit(0.0).alias("value"))
    entries = entries.unionByName(
        grams.join(values, "gram").select(
            "block", F.lit(None).cast("binary").alias("word"), "gram", F.lit(0).cast("long").alias("n"), F.col("log_p").alias("value")
        )
    )
    names = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kinds = (T.BooleanType(), *[T.LongType()] * 3, *[T.DoubleType()] * 2)
    result = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    score = _score(n_words + n_ends, n_kinds + (n_ends > 0), n_ends, step_bytes, result.fieldNames())
    return blocks.groupBy("block").cogroup(entries.groupBy("block")).applyInPandas(score, result)
