"""Near-duplicates by SimHash, linked through counts of set bits.

A fingerprint has 64 bits.  It is embedded as the number of set bits in each of 32 segments of two bits.  A bit
that differs changes one count by at most one, so the Manhattan distance of two embeddings is a lower bound of
the number of differing bits.  The grid: the segments lie in `GROUPS` groups, and two embeddings at distance 3 or
less agree on all but three groups at most; so they share a cell of the grid over some `GROUPS - 3` groups.
Within a cell a range over the total count, again a lower bound, leaves the pairs whose bits are compared.

Only distinct fingerprints are joined.  Cells of more than `block` fingerprints are cut into blocks, and every
pair of blocks is a unit of work of its own.  A unit returns no pairs but a spanning forest of the links it found, so the
rows it makes are at most those it read; connected components follow from the forests.

Defined cases: null and empty texts have fingerprint zero and are linked like any other; a null id never names a
component unless the whole component has none; repeated rows are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import modest_batches, unused, utf8, written
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
GROUPS = 6
BLOCK = 1024
# Rows that one step of the verification takes from its sorted input.
ROWS_AT_ONCE = 50_000

_SLOT = np.arange(8, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PAIRS = 0x5555555555555555


def fingerprint(text: bytes) -> int:
    """The fingerprint of one whole text as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - SHINGLE + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    seen = np.bincount((octets + _SLOT).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = np.packbits(2 * seen > len(hashes), axis=1, bitorder="little")
    return int(bits.reshape(8).view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(bytes(t)) for t in batch], dtype="int64")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    modest_batches(docs.sparkSession)
    return docs.withColumn(name, _fingerprints(utf8(F.col(text))))


def _masks() -> list[int]:
    """For every choice of GROUPS - RADIUS groups, the bits of their segments."""
    cuts = [round(i * 32 / GROUPS) for i in range(GROUPS + 1)]
    masks = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(masks, GROUPS - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: Column) -> Column:
    """32 counts of set bits, in two bits each."""
    other, lows = F.shiftrightunsigned(fp, 1), F.lit(_PAIRS)
    both, one = fp.bitwiseAND(other).bitwiseAND(lows), fp.bitwiseXOR(other).bitwiseAND(lows)
    return F.shiftleft(both, 1).bitwiseOR(one)


def _cells(fps: DataFrame) -> DataFrame:
    cells = F.array(
        *[
            F.struct(F.lit(j).alias("grid"), F.col("counts").bitwiseAND(F.lit(_signed(m))).alias("cell"))
            for j, m in enumerate(_masks())
        ]
    )
    out = fps.select("fp", embedding(F.col("fp")).alias("counts")).select("fp", F.explode(cells).alias("at"))
    return out.select("fp", "at.grid", "at.cell")


def _forest(fps: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each unit (equal numbers, adjacent), what is within RADIUS bits."""
    total = np.bitwise_count(fps).astype(np.int64)
    order = np.lexsort((total, unit))
    fps, unit, total = fps[order], unit[order], total[order]
    n = len(fps)
    parent = np.arange(n)
    at = np.arange(n)
    for step in range(1, n):
        at = at[at + step < n]
        at = at[(unit[at + step] == unit[at]) & (total[at + step] - total[at] <= RADIUS)]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= RADIUS]
        while len(near):
            a, b = parent[near], parent[near + step]
            apart = a != b
            near, a, b = near[apart], a[apart], b[apart]
            np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
            while (parent[parent] != parent).any():
                parent = parent[parent]
    moved = np.flatnonzero(parent != np.arange(n))
    return fps[moved], fps[parent[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by unit; a unit that may go on in the next batch is carried over."""

    def made(rows: np.ndarray) -> pa.RecordBatch:
        new = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
        a, b = _forest(rows[:, 4].view(np.uint64), np.concatenate([[0], np.cumsum(new)]))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    rest, more, n_more = np.empty((0, 5), np.int64), [], 0
    for batch in batches:
        more.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
        n_more += batch.num_rows
        if n_more < ROWS_AT_ONCE:
            continue
        rest, more, n_more = np.concatenate([rest, *more]), [], 0
        last = int(np.flatnonzero((rest[:, :4] != rest[-1, :4]).any(axis=1)).max(initial=-1)) + 1
        if last:
            yield made(np.ascontiguousarray(rest[:last]))
            rest = rest[last:]
    rest = np.concatenate([rest, *more])
    if len(rest):
        yield made(np.ascontiguousarray(rest))


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct `fp` at RADIUS or fewer differing bits."""
    cells = _cells(fps)
    # Written, so that adaptive execution may split the join on a full cell.
    sizes = written(cells.groupBy("grid", "cell").count().filter("count > 1"), "cells")
    met = cells.join(sizes, ["grid", "cell"])
    n_blocks = F.ceil(F.col("count") / block).cast("long")
    met = met.withColumn("n_blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n_blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    units = met.select(
        F.col("grid").cast("long").alias("grid"), "cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp"
    )
    keys = ["grid", "cell", "low", "high"]
    return units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links, "a long, b long").distinct()


def grouped(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows with a column `fp` get `component_id`, the smallest id reachable over links; `rows` must be stored."""
    fps = written(rows.groupBy("fp").agg(F.min(doc_id).alias("least_")), "fingerprints")
    roots = components(links(fps))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least_", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "rooted")
    names = written(rooted.groupBy("root").agg(F.min("least_").alias("component_id")), "component-names")
    named = rooted.join(names, "root").select("fp", "component_id", "root")
    clash = [c for c in ("component_id", "root") if c in rows.columns]
    return rows.drop(*clash).join(named, "fp")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, that come first in their group: smallest id, null ids last."""
    number = unused(docs, "row_")
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered", "zstd")
    rows = numbered.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(number).alias("row"))
    rows = written(with_fingerprint(rows).drop("text"), "doc-fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    firsts = grouped(rows).groupBy("root").agg(F.min(place).alias("first")).select(F.col("first.row").alias(number))
    return numbered.join(firsts, number, "left_semi").select(*docs.columns)
