"""Near-duplicates by the Jaccard similarity of sets of five-word shingles.

Words are runs of characters other than ASCII white space, compared in lower-case A-Z; a text of fewer than `SHINGLE` words
is one shingle.  Two texts are linked at `SIMILARITY` or more; groups are what links connect.

1. Texts with equal sets are one; the first of them goes on.
2. Each set gives `BANDS` keys of `ROWS` minima (MinHash).  A pair at the threshold has no key in common with
   probability (1 - SIMILARITY ** ROWS) ** BANDS, 3 in a million, and less above it.  Everyone with a key is linked to the
   first one with it, which gives candidate groups without a row per pair.
   Texts whose SimHash fingerprints differ by `simhash.RADIUS` bits or fewer are candidates likewise, by the links of `simhash`.
3. Within a candidate group, pairs with a common key or such fingerprints are verified on the shingle sets themselves.  Groups of
   more than `BLOCK_BYTES` of text are cut into blocks, and every pair of blocks is a unit of work of its own; a unit
   returns a spanning forest of the links it found.

Defined cases: null and empty texts are copies of each other; a null id comes last; repeated rows are copies; an empty table
gives no rows; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import modest_batches, unused, utf8, written
from .components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
BLOCK_BYTES = 4 << 20
# Words whose minima are taken at once.
AT_ONCE = 500_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.random.default_rng(5).integers(1 << 63, size=(BANDS * ROWS, 2), dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes) -> np.ndarray:
    """Hashes of a text's distinct shingles, in order."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = hashes[:n]
    for k in range(1, SHINGLE):
        out = _mixed(out * _ODD + hashes[k : n + k])
    return np.unique(out)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The keys (one row each) of sets that are not empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for mask, factor in _SALTS[band * ROWS : (band + 1) * ROWS]:
            key = _mixed(key * _ODD + np.minimum.reduceat((flat ^ mask) * (factor | np.uint64(1)), starts))
        out[:, band] = key
    return out


def _prints(docs: DataFrame) -> DataFrame:
    """(row, doc_id, fp, set_a, set_b, keys): each text's fingerprint, two hashes of its set and its keys."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, keys, some, n = [], [], [], 0
            texts = batch.column(3).to_pylist()
            for k, text in enumerate(texts):
                own = shingles(text)
                some.append(own)
                n += len(own)
                if n >= AT_ONCE or k == len(texts) - 1:
                    for s in some:
                        both = [xxhash.xxh64_intdigest(s.tobytes(), seed) for seed in (1, 2)] if len(s) else [0, 0]
                        hashes.append(np.array(both, np.uint64).view(np.int64).tolist())
                    full = iter(band_keys([s for s in some if len(s)]).view(np.int64).tolist() if n else [])
                    keys += [next(full) if len(s) else [] for s in some]
                    some, n = [], 0
            a, b = list(zip(*hashes, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["row", "doc_id", "fp", "set_a", "set_b", "keys"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = simhash.with_fingerprint(docs).select("row", "doc_id", "fp", "text")
    return marked.mapInArrow(make, f"row long, doc_id {kind}, fp long, set_a long, set_b long, keys array<long>")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= SIMILARITY * (len(a) + len(b) - common) - 1e-9


def _forest(sets: list[np.ndarray], keys: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what verified pairs connect; whoever is reached is compared with nobody reached before."""
    sizes = np.array([len(s) for s in sets])
    left, out = np.arange(len(sets)), []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            near = np.minimum(sizes[left], sizes[i]) >= SIMILARITY * np.maximum(sizes[left], sizes[i]) - 1e-9
            at = left[near]
            near[near] = (keys[at] == keys[i]).any(axis=1) | (np.bitwise_count(fps[at] ^ fps[i]) <= simhash.RADIUS)
            near[near] = [similar(sets[i], sets[j]) for j in left[near].tolist()]
            found = left[near].tolist()
            out += [(i, j) for j in found]
            reached += found
            left = left[~near]
    return out


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, low, high, row, keys, fp, text) arrive sorted by unit."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        at = [r[3] for r in rows]
        links = _forest([shingles(r[6]) for r in rows], np.array([r[4] for r in rows], np.int64), np.array([r[5] for r in rows], np.int64).view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array([at[i] for i, _ in links], pa.int64()), pa.array([at[j] for _, j in links], pa.int64())], ["a", "b"])

    unit, rows = None, []
    for batch in batches:
        for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if r[:3] != unit:
                if len(rows) > 1:
                    yield made(rows)
                unit, rows = r[:3], []
            rows.append(r)
    if len(rows) > 1:
        yield made(rows)


def _near_fingerprints(sets: DataFrame) -> DataFrame:
    """(row, least) that connect rows whose fingerprints `simhash` links."""
    named = written(sets.groupBy("fp").agg(F.min("row").alias("least")), "set-fingerprints")
    apart = simhash.links(named.select("fp"))
    ends = [named.select(F.col("fp").alias(x), F.col("least").alias(y)) for x, y in (("a", "row"), ("b", "least"))]
    same = sets.select("row", "fp").join(named, "fp").filter("row > least")
    return same.select("row", "least").unionByName(apart.join(ends[0], "a").join(ends[1], "b").select("row", "least"))


def links(sets: DataFrame, docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) that connect similar rows of `sets` (row, fp, keys), whose texts are in `docs` (row, text)."""
    keyed = sets.select("row", F.explode("keys").alias("key"))
    # Written, so that adaptive execution may split the join on a common key.
    shared = written(keyed.groupBy("key").agg(F.min("row").alias("least"), F.count("*").alias("n")).filter("n > 1").select("key", "least"), "shared-keys")
    near = _near_fingerprints(sets.filter(F.size("keys") > 0))  # a text without words is like no other
    roots = components(keyed.join(shared, "key").select("row", "least").unionByName(near), "row", "least")
    members = written(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "row"), "candidates")
    members = written(members.join(docs.select("row", "text"), "row").join(sets.select("row", "keys", "fp"), "row"), "candidate-texts", "zstd")
    sizes = written(members.groupBy("root").agg(F.ceil(F.sum(F.octet_length("text")) / block_bytes).alias("n_blocks")), "candidate-sizes")
    n_blocks = F.greatest("n_blocks", F.lit(1).cast("long"))
    met = members.join(sizes.withColumn("n_blocks", n_blocks), "root").withColumn("own", F.pmod(F.xxhash64("row"), F.col("n_blocks")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    unit = ["root", "low", "high"]
    units = met.select("root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "row", "keys", "fp", "text")
    return units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_verified, "a long, b long").distinct()


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows, with all their columns, that come first in their group: smallest id, null ids last."""
    modest_batches(docs.sparkSession)
    number = unused(docs, "row_")
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered", "zstd")
    rows = numbered.select(F.col(number).alias("row"), F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("text"))
    prints = written(_prints(rows), "shingle-prints")
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    firsts = written(prints.groupBy("set_a", "set_b").agg(F.min(place).alias("first")).select("first.row"), "first-of-sets")
    sets = written(prints.join(firsts, "row", "left_semi").select("row", "doc_id", "fp", "keys"), "sets")
    roots = components(links(sets, rows, **options))
    rooted = sets.join(roots, sets["row"] == roots["node"], "left").withColumn("root", F.coalesce("root", "row"))
    kept = rooted.groupBy("root").agg(F.min(place).alias("first")).select(F.col("first.row").alias(number))
    return numbered.join(kept, number, "left_semi").select(*docs.columns)
