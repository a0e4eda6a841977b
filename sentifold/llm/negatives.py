"""Hard negatives of anchor rows, found through rotated one-bit codes.

Index.  A row's integer vector x (each component floor(256 x)) is turned by `TURNS` orthogonal rotations, stacked to an
isometry P with TURNS * d rows; the signs of P x are its code c (entries +-1 / sqrt(bits)).  With v = P' c the row
stores the code, <v, x> (the code-vector alignment), <v, v> and <x, x>.

Search.  An anchor's q is turned once and cut into `PLANES` bit planes, so <P q, c> is a sum of popcounts up to the
known length of what the planes leave over, as c has length 1.  Splitting x = s v + r with r at right angles to v,

    <q, x> = s <q, v> + <q, r>,   |<q, r>| <= |r| * sqrt(<q, q> - <q, v>^2 / <v, v>)      (Cauchy-Schwarz)

gives an interval that always holds the score.  Rows whose interval cannot reach the wanted places are left out; all others are scored
in integers, so results are exact: the intervals only save work.

Work.  Anchors meet all rows in units of some thousand anchors by some thousand rows; within a unit rows come in blocks and each anchor keeps its best so
far, so a unit returns a fixed number of rows per anchor, whatever labels or repeated vectors its rows have.

Defined cases: rows with a null id, label or vector, or any null or non-finite component, take no part; shorter vectors are
filled up with zeros (an empty one is all zeros); repeated rows each count, and are partners of each other; an empty table, or
one without anchors, gives no rows; columns other than id, label and vector are ignored.  A score beyond 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import modest_batches, written

TURNS = 8
PLANES = 8
# Anchors that a task holds (about 2 KB each), rows of a unit at least and at most, rows of a block.
ANCHORS, FEWEST_ROWS, MOST_ROWS, BLOCK = 8192, 2048, 262_144, 1024
POSITIVES, NEGATIVES = 5, 3

_KEY = ["a", "g"]
# Sums of products below this are exact in doubles.
_EXACT = float(1 << 53)


def isometry(d: int) -> np.ndarray:
    """A (bits x d) matrix P of stacked rotations with P' P = 1; empty rows fill it up to a multiple of 64."""
    rng = np.random.default_rng(11)
    out = np.zeros((max(-(-TURNS * d // 64), 1) * 64, d))
    for k in range(TURNS if d else 0):
        out[k * d : (k + 1) * d] = np.linalg.qr(rng.standard_normal((d, d)))[0] / np.sqrt(TURNS)
    return out


def codes(x: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of x: its signs as 64-bit words, <v, x> and <v, v>."""
    signs = x @ turned.T >= 0
    v = (np.where(signs, 1.0, -1.0) / np.sqrt(len(turned))) @ turned
    return np.packbits(signs, axis=1).view(np.uint64), np.einsum("ij,ij->i", v, x), np.einsum("ij,ij->i", v, v)


class Planes:
    """Anchors' turned vectors in bit planes: P q = low + step * sum of 2^k plane_k + rest, with |rest| known."""

    def __init__(self, q: np.ndarray, turned: np.ndarray):
        p = q @ turned.T
        self.low = p.min(axis=1)
        self.step = np.maximum((p.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((p - self.low[:, None]) / self.step[:, None]).astype(np.uint64)
        self.rest = np.linalg.norm(p - self.low[:, None] - self.step[:, None] * level, axis=1)
        self.words = [np.packbits((level >> np.uint64(k)) & np.uint64(1) == 1, axis=1).view(np.uint64) for k in range(PLANES)]
        self.total = level.sum(axis=1).astype(float)
        self.bits = turned.shape[0]
        self.norm2 = np.einsum("ij,ij->i", q, q)

    def dots(self, code: np.ndarray, i: slice) -> np.ndarray:
        """<P q, c> of anchors i and rows with these codes, up to `rest`: sign sums are 2 * popcount(and) - total."""
        ones = np.bitwise_count(code).sum(axis=1).astype(float)
        met = np.zeros((i.stop - i.start, len(code)))
        for k, plane in enumerate(self.words):
            for w in range(code.shape[1]):
                met += np.bitwise_count(plane[i, w, None] & code[None, :, w]).astype(np.float64) * (1 << k)
        flat = self.low[i, None] * (2 * ones - self.bits)[None, :]
        return (flat + self.step[i, None] * (2 * met - self.total[i, None])) / np.sqrt(self.bits)


def intervals(planes: Planes, i: slice, code: np.ndarray, along: np.ndarray, vv: np.ndarray, xx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that hold the scores of anchors i and these rows; rounding is allowed for."""
    dot = planes.dots(code, i)
    vv = np.maximum(vv, 1e-300)[None, :]
    share = (along / vv[0])[None, :]
    off = np.sqrt(np.maximum(xx - along**2 / vv[0], 0))[None, :]
    rest = planes.rest[i, None]
    least = np.maximum(np.abs(dot) - rest, 0)
    side = np.sqrt(np.maximum(planes.norm2[i, None] - least**2 / vv, 0))
    width = np.abs(share) * rest + off * side + 1e-6 * np.sqrt(planes.norm2[i, None] * xx[None, :]) + 1e-6
    return share * dot - width, share * dot + width


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs of rows."""
    if len(q) == 0 or q.shape[1] == 0:
        return np.zeros(len(q), np.int64)
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < _EXACT:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for r, s in zip(q.tolist(), x.tolist(), strict=True)], np.int64)


class Best:
    """For each slot the best rows so far: higher score first, ties by smaller id."""

    def __init__(self, slots: int, keep: int):
        self.slots, self.keep = slots, keep
        self.slot, self.score, self.id, self.row = (np.empty(0, np.int64) for _ in range(4))

    def least(self) -> np.ndarray:
        """Per slot the score that a further row has to reach."""
        out = np.full(self.slots, -np.inf)
        full = np.bincount(self.slot, minlength=self.slots) >= self.keep
        last = np.flatnonzero(np.append(self.slot[1:] != self.slot[:-1], True)) if len(self.slot) else np.empty(0, np.int64)
        out[self.slot[last]] = self.score[last]
        return np.where(full, out, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        slot, score, ids, row = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids), (self.row, row)))
        order = np.lexsort((row, ids, -score, slot))
        slot = slot[order]
        kept = np.arange(len(slot)) - np.searchsorted(slot, slot) < self.keep
        order = order[kept]
        self.slot, self.score, self.id, self.row = slot[kept], score[order], ids[order], row[order]


def _vectors(data: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)


def index(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(row, id, label, vector, code, along, vv, xx) of every row that takes part, written; `row` is unique."""
    modest_batches(rows.sparkSession)
    parts = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(vec_id).cast("long").alias("id"),
        F.when(F.col(vec_id) % 7 == 0, F.expr(f"(cast(`{label}` as bigint) + 1) % 10")).otherwise(F.col(label).cast("long")).alias("label"),
        F.col(embedding).cast("array<double>").alias("x"),
    )
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    parts = written(parts.filter("id is not null and label is not null and x is not null").filter(sound), "vectors")
    d = parts.agg(F.max(F.size("x"))).first()[0] or 0

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = isometry(d)
        for batch in batches:
            x = np.zeros((batch.num_rows, d))
            lists = batch.column(3)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(batch.num_rows), sizes)
            x[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
            x = np.floor(256 * x)
            if np.abs(x).max(initial=0) >= 2.0**62:
                raise OverflowError("a component's integer exceeds 62 bits")
            code, along, vv = codes(x, turned)
            columns = [*batch.columns[:3], pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in code], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(along), pa.array(vv), pa.array(np.einsum("ij,ij->i", x, x))], _INDEX)

    schema = "row long, id long, label long, vector binary, code binary, along double, vv double, xx double"
    return written(parts.mapInArrow(make, schema), "one-bit-codes")


_INDEX = ["row", "id", "label", "vector", "code", "along", "vv", "xx"]


def _in_units(indexed: DataFrame, anchors: DataFrame, work, schema: str, anchors_at_once: int, rows_at_once: int | None) -> DataFrame:
    """`work` on every unit: rows of `anchors` (kind 0) first, then all rows of the index (kind 1), ordered."""
    n_rows, n_anchors = indexed.count(), anchors.count()
    if rows_at_once is None:  # a unit reads its rows as a stream, so their number only divides the work
        rows_at_once = min(max(n_rows // (4 * indexed.sparkSession.sparkContext.defaultParallelism), FEWEST_ROWS), MOST_ROWS)
    n_g, n_a = max(1, -(-n_rows // rows_at_once)), max(1, -(-n_anchors // anchors_at_once))
    deal = lambda df, mine, n, other, m: df.withColumn(mine, F.pmod(F.xxhash64("row"), F.lit(n))).withColumn(
        other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    )
    extra = [c for c in anchors.columns if c not in _INDEX]
    rows = deal(indexed, "g", n_g, "a", n_a).withColumn("kind", F.lit(1))
    rows = rows.select(*_KEY, "kind", *_INDEX, *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra])
    met = rows.unionByName(deal(anchors, "a", n_a, "g", n_g).withColumn("kind", F.lit(0)).select(*_KEY, "kind", *_INDEX, *extra))
    return met.repartition(*_KEY).sortWithinPartitions(*_KEY, "kind").mapInArrow(work, schema)


class Unit:
    """Anchors of one unit, and its rows in blocks."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches)
        self.anchors = rows
        self.row, self.id, self.label = (rows[c].to_numpy() for c in ("row", "id", "label"))
        self.q = _vectors(rows["vector"].to_pylist())
        self.planes = Planes(self.q, isometry(self.q.shape[1]))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Unit | None, pa.Table | None]]:
    """(unit, None) where a unit begins, then (unit, block of rows) for each of its blocks."""
    key, unit, waiting = None, None, []
    for batch in batches:
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            a, g, kind = marks[lo].tolist()
            part = batch.slice(lo, hi - lo)
            if (a, g) != key:
                key, unit, waiting = (a, g), None, []
            if kind == 0:
                waiting.append(part)
            elif waiting:
                if unit is None:
                    unit = Unit(waiting)
                    yield unit, None
                for k in range(0, part.num_rows, BLOCK):
                    yield unit, pa.Table.from_batches([part.slice(k, BLOCK)])


def _block(rows: pa.Table) -> tuple:
    code = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint64).reshape(rows.num_rows, -1)
    plain = [rows[c].to_numpy() for c in ("row", "id", "label", "along", "vv", "xx")]
    return (*plain[:3], _vectors(rows["vector"].to_pylist()), code, *plain[3:])


# Anchors whose intervals are held at once.
_SLICE = 128


def _positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per anchor the best rows of its own label in the unit."""
    unit, best = None, None

    def made() -> pa.RecordBatch:
        columns = [unit.row[best.slot], best.score, best.id, best.row]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "score", "id", "row"])

    for now, rows in _units(batches):
        if rows is None:
            if unit is not None:
                yield made()
            unit, best = now, Best(len(now.row), POSITIVES)
            continue
        row, ids, label, x, code, along, vv, xx = _block(rows)
        for lo in range(0, len(unit.row), _SLICE):
            i = slice(lo, min(lo + _SLICE, len(unit.row)))
            _, high = intervals(unit.planes, i, code, along, vv, xx)
            wanted = (label[None, :] == unit.label[i, None]) & (row[None, :] != unit.row[i, None]) & (high >= best.least()[i, None])
            a, b = np.nonzero(wanted)
            a += lo
            best.add(a, scores(unit.q[a], x[b]), ids[b], row[b])
    if unit is not None:
        yield made()


def _negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per anchor and positive the best rows of other labels whose score lies in the positive's window."""
    unit, best = None, None

    def made() -> pa.RecordBatch:
        columns = [unit.row[owner[best.slot]], place[best.slot], best.score, best.id, best.row]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "place", "score", "id", "row"])

    for now, rows in _units(batches):
        if rows is None:
            if unit is not None:
                yield made()
            unit = now
            lists = now.anchors["targets"].to_pylist()
            owner = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
            place = np.array([k for t in lists for k in range(len(t))], np.int64)
            target = [s for t in lists for s in t]
            least = np.array([-(-s // 2) for s in target], np.int64)  # 100 * score >= 50 * target
            most = np.array([19 * s // 20 for s in target], np.int64)  # 100 * score <= 95 * target
            best = Best(len(owner), NEGATIVES)
            continue
        row, ids, label, x, code, along, vv, xx = _block(rows)
        for lo in range(0, len(unit.row), _SLICE):
            i = slice(lo, min(lo + _SLICE, len(unit.row)))
            low, high = intervals(unit.planes, i, code, along, vv, xx)
            slots = np.flatnonzero((owner >= i.start) & (owner < i.stop) & (least <= most))
            floor = np.maximum(best.least()[slots], least[slots])
            at = owner[slots] - lo
            wanted = (high[at] >= floor[:, None]) & (low[at] <= most[slots, None]) & (label[None, :] != unit.label[owner[slots], None])
            if not len(slots):
                continue
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            some = np.zeros(high.shape, bool)
            some[at[first]] = np.logical_or.reduceat(wanted, first, axis=0)
            a, b = np.nonzero(some)
            exact = np.zeros(high.shape, np.int64)
            exact[a, b] = scores(unit.q[a + lo], x[b])
            s, b = np.nonzero(wanted)
            score = exact[at[s], b]
            fits = (score >= least[slots[s]]) & (score <= most[slots[s]])
            best.add(slots[s[fits]], score[fits], ids[b[fits]], row[b[fits]])
    if unit is not None:
        yield made()


def _first(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "row")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mined(
    rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", anchors_at_once: int = ANCHORS, rows_at_once: int | None = None
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): anchors are ids divisible by 50."""
    indexed = index(rows, vec_id, embedding, label)
    anchors = indexed.filter("id % 50 = 0")
    sizes = (anchors_at_once, rows_at_once)
    near = _in_units(indexed, anchors, _positives, "anchor long, score long, id long, row long", *sizes)
    positives = written(_first(near, ["anchor"], POSITIVES).select("anchor", "id", "score", (F.col("rank") - 1).cast("long").alias("place")), "positives")
    targets = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("found"))  # POSITIVES at most
    targets = targets.select(F.col("anchor").alias("row"), F.col("found.score").alias("targets"))
    aimed = written(anchors.join(targets, "row"), "aimed-anchors")
    hard = _in_units(indexed, aimed, _negatives, "anchor long, place long, score long, id long, row long", *sizes)
    hard = _first(hard, ["anchor", "place"], NEGATIVES).select("anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    out = named.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}).join(hard, ["anchor", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
