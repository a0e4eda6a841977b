"""Packing documents into as few token sequences as possible, by bin completion.

Pieces of equal length are interchangeable, so the search works on the histogram of lengths, at most `capacity`
numbers whatever the corpus.  It looks for a multiset of fillings, each with a number of repeats; the pieces are
then dealt to the places of the fillings by their rank among the pieces of their length.  Ranks come from counts
per (task, length), so no length, however common, is gathered anywhere.

Search: the largest remaining length opens a sequence; the undominated fillings of the rest are tried in order of
waste; a branch whose waste exceeds what a solution better than the incumbent may have is left.  Best-fit
decreasing over what remains gives incumbents at every node, and reaching the lower bound ends the search.
`nodes` bounds the work; the incumbent is a whole packing at any time.

Defined cases: a null text is empty and has only the end id; a repeated row is packed as often as it occurs; a null id is
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest_batches, written
from .tokens import encoder, public_path

CAPACITY = 1024
END_ID = 2
NODES = 400
# Fillings tried at a node, and steps spent on finding them.
WIDTH, STEPS = 12, 3000

Filling = tuple[int, ...]
Plan = list[tuple[Filling, int]]


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all are full but the first, which may be shorter."""
    first = (n_ids - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n_ids, capacity)]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, by groups of sequences that have the same room left."""
    room: dict[int, list[list]] = {}
    done: Plan = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = [r for r in room if r >= length]
            if fits:
                r = min(fits)
                filling, n = room[r].pop()
                take = min(left, n)
                if n > take:
                    room[r].append([filling, n - take])
                if not room[r]:
                    del room[r]
                added = [(filling + (length,), take)]
                left -= take
            else:
                each = capacity // length
                full, over = divmod(left, each)
                added = [((length,) * each, full)] * (full > 0) + [((length,) * over, 1)] * (over > 0)
                left = 0
            for filling, n in added:
                rest = capacity - sum(filling)
                if rest:
                    room.setdefault(rest, []).append([filling, n])
                else:
                    done.append((filling, n))
    return done + [(f, n) for groups in room.values() for f, n in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: total length, and what fits beside pieces of over half a sequence."""
    lengths = sorted(counts)
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    for k in [1, *[x for x in lengths if 2 * x <= capacity]]:
        alone = sum(counts[x] for x in lengths if x > capacity - k)
        large = [x for x in lengths if capacity // 2 < x <= capacity - k and 2 * x > capacity]
        n_large = sum(counts[x] for x in large)
        beside = n_large * capacity - sum(x * counts[x] for x in large)
        small = sum(x * counts[x] for x in lengths if k <= x and 2 * x <= capacity)
        best = max(best, alone + n_large + max(0, -(-(small - beside) // capacity)))
    return best


def _dominated(filling: Filling, gap: int, available: list[int]) -> bool:
    """Whether some other length could replace a part of the filling that is no larger than it."""
    slack = gap - sum(filling)
    sums = 1  # bit s: some part of the filling has length s
    for x in filling:
        sums |= sums << x
    own = set(filling)
    for x in available:
        low = max(0, x - slack)
        if x not in own and (sums >> low) & ((1 << (x - low + 1)) - 1):
            return True
    return False


def fillings(gap: int, counts: dict[int, int], most_waste: int) -> list[Filling]:
    """Undominated ways to fill the gap, least waste first."""
    available = sorted((x for x in counts if x <= gap), reverse=True)
    found: set[Filling] = set()
    steps = 0

    def extend(chosen: Filling, left: int, at: int) -> None:
        nonlocal steps
        grown = False
        for i in range(at, len(available)):
            x = available[i]
            if x > left or counts[x] <= chosen.count(x):
                continue
            steps += 1
            if steps > STEPS or len(found) >= 4 * WIDTH:
                return
            grown = True
            extend(chosen + (x,), left - x, i)
        if not grown and left <= most_waste and (chosen or not available or available[-1] > left):
            found.add(chosen)

    extend((), gap, 0)
    kept = [f for f in found if not _dominated(f, gap, [x for x in available if counts[x] > f.count(x)])]
    return sorted(kept, key=lambda f: (gap - sum(f), len(f)))[:WIDTH]


def pack(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Fillings with their repeats that hold every counted length once."""
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    size = lambda plan: sum(n for _, n in plan)
    total = sum(x * n for x, n in counts.items())
    best, floor = best_fit(counts, capacity), lower_bound(counts, capacity)
    stack: list[tuple[dict[int, int], Plan]] = [(counts, [])]
    while stack and nodes and size(best) > floor:
        nodes -= 1
        rest, made = stack.pop()
        wasted = sum((capacity - sum(f)) * n for f, n in made)
        allowed = (size(best) - 1) * capacity - total - wasted
        if allowed < 0:
            continue
        whole = made + best_fit(rest, capacity)
        if size(whole) < size(best):
            best = whole
        if not rest:
            continue
        largest = max(rest)
        others = dict(rest)
        others[largest] -= 1
        others = {x: n for x, n in others.items() if n}
        branches = []
        for filling in fillings(capacity - largest, others, allowed):
            used = Counter((largest, *filling))
            times = min(rest[x] // n for x, n in used.items())
            waste = capacity - sum(x * n for x, n in used.items())
            if waste:
                times = min(times, allowed // waste)
            if times < 1:
                continue
            left = {x: n - times * used.get(x, 0) for x, n in rest.items()}
            branches.append(({x: n for x, n in left.items() if n}, made + [((largest, *filling), times)]))
        stack.extend(reversed(branches))
    return best


def _places(plan: Plan) -> tuple[np.ndarray, ...]:
    """For runs of ranks of a length: sort key, first rank, first sequence and offset in it."""
    used: Counter[int] = Counter()
    rows, base = [], 0
    for filling, n in plan:
        offset = 0
        for length in filling:
            rows.append((length, used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return table[:, 0] << 48 | table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def _piece_type(id_type: T.DataType) -> T.StructType:
    names = ("piece", "start", "length", "ids_crc32", "task", "nth")
    kinds = (T.IntegerType(), *[T.LongType()] * 3, T.IntegerType(), T.LongType())
    return T.StructType([T.StructField("doc_id", id_type), *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its checksum, the task that made it and its number among that task's pieces of its length."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for i, ids in enumerate(enc.encode(batch.column(1).to_pylist())):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(columns[0], pa.int64())), *map(pa.array, columns[1:], kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    modest_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(make, _piece_type(source.schema["doc_id"].dataType))


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, nodes: int = NODES, **columns: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    made = written(pieces(docs, tokenizer or public_path("byte_bpe_50k.json"), capacity, end_id, **columns), "pieces")
    per_task = made.groupBy("task", "length").agg(F.count("*").alias("n_pieces"))
    histogram = per_task.groupBy("length").agg(F.sum("n_pieces").alias("n")).collect()  # at most `capacity` rows
    keys, firsts, bases, offsets = _places(pack({r["length"]: r["n"] for r in histogram}, capacity, nodes))

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rank = rank.to_numpy()
        at = np.searchsorted(keys, length.to_numpy() << 48 | rank, side="right") - 1
        return pd.DataFrame({"sequence_id": bases[at] + rank - firsts[at], "offset": offsets[at]})

    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_task.withColumn("before", F.coalesce(F.sum("n_pieces").over(before), F.lit(0))).drop("n_pieces")
    out = made.join(ranks, ["task", "length"]).withColumn("place_", place("length", F.col("before") + F.col("nth")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "place_.sequence_id", "place_.offset")
