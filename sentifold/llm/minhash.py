"""Near-duplicates by MinHash: universal hash minima, banding, signature verification, connected components.

Words are runs of characters other than ASCII white space, compared in lower-case A-Z.  A document's set holds its
distinct five-word shingles; a document of fewer words has its whole sequence as its only shingle, a document without
words or text an empty set, linked with nothing.  Two documents are linked where 100 * intersection >= 85 * union.

1. A pass over the texts gives each document its set's size, two hashes of the set, `BANDS` keys of `ROWS` minima
   each, and a byte of every minimum as the signature.  The hash functions are strongly universal (pair-multiply-shift).
   Two sets at the threshold share no key with probability (1 - 0.85 ** ROWS) ** BANDS, 9 in ten million.
2. Equal sets become one node, so copies cost nothing from here on.
3. Stars: each node of a bucket (nodes with a key in common) meets the bucket's first node, which makes at most one pair
   per node and key.  Signatures verify the pair first, then the sets themselves; links give components by alternating
   large-star and small-star.
4. The rest, exactly: buckets that still hold several components.  Their nodes are dealt into blocks, a large component's into
   blocks of its own; two blocks meet in a unit of work unless one component fills both.  A unit compares signatures and
   returns which nodes have a partner in another component and what these connect; within what they connect, units
   of the same kind compare the sets and return a spanning forest of the links they confirm.  No step makes a row per pair.

A signature refuses a pair at the threshold with a probability under one in a million (`LEAST_EQUAL`).

Defined cases: a null id never names a component unless the whole component has none; repeated rows are copies of each
other and keep a row each; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import modest_batches, utf8, written
from .components import components

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 36, 7
# Nodes, and bytes of sets, of which one block holds a few more at most.
BLOCK_ROWS = 128
BLOCK_BYTES = 4 << 20
# Pairs of one pivot that one unit confirms.
STAR_ROWS = 256
# Shingles whose minima are taken at once.
AT_ONCE = 500_000
# Node ids that a task may hold as a broadcast: 8 bytes each.
BROADCAST_IDS = 250_000

_UNIT = ["bucket", "low_root", "low", "high_root", "high"]
_MINIMA = BANDS * ROWS
_ODD = np.uint64(0x9E3779B97F4A7C15)
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)
_UNIVERSAL = np.random.default_rng(12).integers(1 << 64, size=(_MINIMA, 3), dtype=np.uint64)


def _least_equal(chance: float = 1e-6) -> int:
    """Equal bytes of a signature below which a pair at the threshold lies with less than `chance`."""
    p, below, k = PERCENT / 100, 0.0, 0
    while True:
        below += math.comb(_MINIMA, k) * p**k * (1 - p) ** (_MINIMA - k)
        if below > chance:
            return k
        k += 1


LEAST_EQUAL = _least_equal()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes) -> np.ndarray:
    """64-bit hashes of a text's distinct shingles, in order."""
    words = text.lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 12)] if words else [], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    out = hashes[:n]
    for k in range(1, SHINGLE):
        out = _mixed(out * _ODD + hashes[k : n + k])
    return np.unique(out)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """For sets that are not empty, a row each: the minimum of every universal hash function, 32 bits."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    high, low = flat >> _HALF, flat & _LOW
    out = np.empty((len(sets), _MINIMA), np.uint64)
    for k, (a, b, c) in enumerate(_UNIVERSAL):
        out[:, k] = np.minimum.reduceat(((high + a) * (low + b) + c) >> _HALF, starts)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    rows = least.reshape(len(least), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = _mixed(key * _ODD + rows[:, :, k])
    return key.view(np.int64)


def _set_hashes(own: np.ndarray) -> tuple[int, int]:
    data = own.tobytes()
    return tuple(np.array([xxhash.xxh64_intdigest(data, 1), xxhash.xxh3_64_intdigest(data, 2)], np.uint64).view(np.int64).tolist())


def prints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(seq, doc_id, n_shingles, set_a, set_b, keys, marks), a row per document, written; `seq` is unique."""
    spark = docs.sparkSession
    modest_batches(spark)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes, keys, marks, some, n = [], [], [], [], [], 0
            texts = batch.column(2).to_pylist()
            for k, data in enumerate(texts):
                own = shingles(data)
                some.append(own)
                n += len(own)
                if n < AT_ONCE and k < len(texts) - 1:
                    continue
                sizes += map(len, some)
                hashes += map(_set_hashes, some)
                full = [s for s in some if len(s)]
                least = minima(full) if full else np.empty((0, _MINIMA), np.uint64)
                own_keys, own_marks = iter(band_keys(least).tolist()), iter(least.astype(np.uint8))
                for s in some:
                    keys.append(next(own_keys) if len(s) else [])
                    marks.append(next(own_marks).tobytes() if len(s) else b"")
                some, n = [], 0
            a, b = [h[0] for h in hashes], [h[1] for h in hashes]
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
            columns += [pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["seq", "doc_id", "n_shingles", "set_a", "set_b", "keys", "marks"])

    rows = docs.select(F.monotonically_increasing_id().alias("seq"), F.col(doc_id).alias("doc_id"), utf8(F.col(text)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"seq long, doc_id {kind}, n_shingles long, set_a long, set_b long, keys array<long>, marks binary"
    return written(rows.mapInArrow(make, schema), "minhash-prints")


def _full_sets(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, set) of `nodes` (node, doc_id, set_a, set_b), the sets as bytes, made again from the texts; written."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column(0).to_pylist()]
            hashes = [_set_hashes(s) for s in sets]
            columns = [pa.array([h[k] for h in hashes], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for s in sets], pa.binary())], ["set_a", "set_b", "set"])

    ids = nodes.select(F.col("doc_id").alias("wanted")).distinct()
    if nodes.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(doc_id).alias("id"), utf8(F.col(text)).alias("text"))
    found = rows.join(ids, F.col("id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    made = found.mapInArrow(make, "set_a long, set_b long, set binary")
    # A repeated row gives its set once, combined before the shuffle.
    return written(made.join(nodes, ["set_a", "set_b"]).select("node", "set").dropDuplicates(["node"]), "minhash-sets")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < PERCENT * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """The rows of each unit (equal in the first `n_keys` columns, adjacent)."""
    unit, rows = None, []
    for batch in batches:
        for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if r[:n_keys] != unit:
                if rows:
                    yield rows
                unit, rows = r[:n_keys], []
            rows.append(r[n_keys:])
    if rows:
        yield rows


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _confirmed_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, part, kind, node, set) arrive sorted; kind 0 is the pivot's own set."""
    pivot, part, own, a, b = None, None, None, [], []
    for batch in batches:
        for p, s, kind, node, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if kind == 0:
                pivot, part, own = p, s, np.frombuffer(data, np.uint64)
            elif (p, s) == (pivot, part) and similar(own, np.frombuffer(data, np.uint64)):
                a.append(node)
                b.append(p)
        yield _pairs(a, b)
        a, b = [], []


def _equal_enough(marks: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which rows of a unit lie in different components and have signatures that allow a link."""
    out = root[:, None] != root[None, :]
    for i in range(len(marks) - 1):
        out[i, i + 1 :] &= (marks[i + 1 :] == marks[i]).sum(axis=1) >= LEAST_EQUAL
        out[i + 1 :, i] = out[i, i + 1 :]
    return out


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of rows (node, root, marks): (node, root, to) for nodes with a promising partner; `to` are roots thus connected."""
    node, root, to = [], [], []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (node, root, to)], ["node", "root", "to"])

    for rows in _runs(batches, 5):
        roots = np.array([r[1] for r in rows], np.int64)
        if (roots == roots[0]).all():
            continue
        allowed = _equal_enough(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1), roots)
        label = roots.copy()
        hit = np.flatnonzero(allowed.any(axis=1))
        for i in hit.tolist():
            met = np.append(label[allowed[i]], label[i])
            label[np.isin(label, met)] = met.min()
            node.append(rows[i][0])
            root.append(rows[i][1])
        to += label[hit].tolist()
        if len(node) > 10_000:
            yield made()
            node, root, to = [], [], []
    yield made()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units of rows (node, root, marks, set): links that connect what confirmed pairs of the unit connect."""
    for rows in _runs(batches, 5):
        roots = np.array([r[1] for r in rows], np.int64)
        if (roots == roots[0]).all():
            continue
        allowed = np.triu(_equal_enough(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1), roots))
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        label, a, b = roots.copy(), [], []
        for i, j in np.argwhere(allowed).tolist():
            if label[i] != label[j] and similar(sets[i], sets[j]):
                label[label == label[i]] = label[j]
                a.append(rows[i][0])
                b.append(rows[j][0])
        yield _pairs(a, b)


def _units(members: DataFrame, weight: Column) -> DataFrame:
    """`members` (bucket, node, root) with the units they meet in: (bucket, low_root, low, high_root, high, node, root).

    A root with more than a block of nodes in a bucket gets blocks of its own, the others share blocks; pairs of
    blocks that one root fills are left out.  `weight` is a node's share of a block.
    """
    weighed = members.withColumn("weight", weight)
    per_root = weighed.groupBy("bucket", "root").agg(F.sum("weight").alias("size"), F.count("*").alias("n"))
    per_root = per_root.withColumn("blocks", F.ceil("size").cast("long")).withColumn("large", (F.col("blocks") > 1) & (F.col("n") > 1))
    pool = per_root.filter(~F.col("large")).groupBy("bucket").agg(F.greatest(F.lit(1), F.ceil(F.sum("size"))).cast("long").alias("pool"))
    of_root = written(per_root.join(pool, "bucket", "left").select("bucket", "root", "large", "blocks", "pool"), "minhash-blocks")
    dealt = weighed.drop("weight").join(of_root, ["bucket", "root"])
    own = F.when(F.col("large"), F.pmod(F.xxhash64("node"), "blocks")).otherwise(F.pmod(F.xxhash64("root"), "pool"))
    filler = F.when(F.col("large"), F.col("root")).otherwise(F.lit(-1))
    dealt = written(dealt.select("bucket", "node", "root", filler.alias("filler"), own.alias("own")), "minhash-dealt")
    blocks = written(dealt.select("bucket", "filler", "own").distinct(), "minhash-block-list")
    other = blocks.select(F.col("bucket").alias("at"), F.col("filler").alias("filler2"), F.col("own").alias("own2"))
    apart = (F.col("filler") != F.col("filler2")) | (F.col("filler") == -1)
    met = blocks.join(other, (F.col("bucket") == F.col("at")) & apart).drop("at")
    here, there = F.struct("filler", "own"), F.struct(F.col("filler2").alias("filler"), F.col("own2").alias("own"))
    met = written(met.select("bucket", "filler", "own", F.least(here, there).alias("low"), F.greatest(here, there).alias("high")), "minhash-met")
    met = met.select("bucket", "filler", "own", F.col("low.filler").alias("low_root"), F.col("low.own").alias("low"), F.col("high.filler").alias("high_root"), F.col("high.own").alias("high"))
    return dealt.join(met, ["bucket", "filler", "own"]).select(*_UNIT, "node", "root")


def _by_unit(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    return rows.repartition(*_UNIT).sortWithinPartitions(*_UNIT).mapInArrow(work, schema)


def _stars(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among `pairs` (node, pivot) whose sets are similar."""
    parts = written(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / STAR_ROWS).cast("long").alias("parts")), "minhash-pivots")
    spread = pairs.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    rows = spread.join(sets, "node").select("pivot", "part", F.lit(1).alias("kind"), "node", "set")
    own = parts.join(sets, parts["pivot"] == sets["node"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.unionByName(own.select("pivot", "part", F.lit(0).alias("kind"), "node", "set"))
    return rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "kind").mapInArrow(_confirmed_stars, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b), written, that connect all similar `nodes` (node, doc_id, set_a, set_b, keys, marks)."""
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    # Written, so that adaptive execution may split the join on a common key.
    shared = written(keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1"), "minhash-buckets")
    met = written(keyed.join(shared.select("key", "pivot"), "key"), "minhash-met")

    marks = nodes.select("node", "marks")
    pairs = met.filter("node != pivot").select("node", "pivot").distinct()
    both = pairs.join(marks, "node").join(marks.select(F.col("node").alias("pivot"), F.col("marks").alias("pivot_marks")), "pivot")
    pairs = written(both.mapInArrow(_allowed, "node long, pivot long"), "minhash-pairs")
    ends = pairs.select("node").union(pairs.select("pivot")).distinct()
    named = nodes.select("node", "doc_id", "set_a", "set_b")
    sets = _full_sets(docs, written(named.join(ends, "node", "left_semi"), "minhash-wanted"), doc_id, text)
    found = written(_stars(pairs, sets), "minhash-links")

    roots = written(components(found), "minhash-roots")
    rooted = met.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "minhash-rooted")
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).filter("least != most")
    open_keys = written(open_keys.select("key", "n"), "minhash-open")
    rest = written(rooted.join(open_keys, "key").select(F.col("key").alias("bucket"), "node", "root", "n"), "minhash-rest")
    zero = [F.lit(0).cast("long").alias(c) for c in _UNIT[1:]]
    small = rest.filter(F.col("n") <= block_rows).select("bucket", *zero, "node", "root")
    large = _units(rest.filter(F.col("n") > block_rows).drop("n"), F.lit(1 / block_rows))
    rows = small.unionByName(large).join(marks, "node").select(*_UNIT, "node", "root", "marks")
    promising = written(_by_unit(rows, _promising, "node long, root long, to long"), "minhash-promising")

    groups = components(promising.select("root", "to"), "root", "to").select(F.col("node").alias("root"), F.col("root").alias("bucket"))
    active = promising.select("node", "root").distinct().join(groups, "root", "left")
    active = written(active.select("node", "root", F.coalesce("bucket", "root").alias("bucket")), "minhash-active")
    more = _full_sets(docs, written(named.join(active, "node", "left_semi"), "minhash-wanted"), doc_id, text)
    sized = written(active.join(more.select("node", F.octet_length("set").alias("bytes")), "node"), "minhash-sized")
    units = _units(sized, F.greatest(F.lit(1 / block_rows), F.col("bytes") / block_bytes))
    rows = units.join(marks, "node").join(more, "node").select(*_UNIT, "node", "root", "marks", "set")
    return written(found.unionByName(_by_unit(rows, _confirmed, "a long, b long")), "minhash-links")


def _allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, node, marks, pivot_marks): the pairs whose signatures allow a link."""
    for batch in batches:
        names = batch.schema.names
        x, y = (np.frombuffer(b"".join(batch.column(names.index(c)).to_pylist()), np.uint8).reshape(-1, _MINIMA) for c in ("marks", "pivot_marks"))
        keep = pa.array((x == y).sum(axis=1) >= LEAST_EQUAL)
        yield batch.select([names.index("node"), names.index("pivot")]).filter(keep)


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest id of its component), kept (it names its component)."""
    marked = prints(docs, doc_id, text)
    equal = marked.filter("n_shingles > 0").groupBy("set_a", "set_b")
    firsts = written(equal.agg(F.min("seq").alias("node"), F.min("doc_id").alias("least")), "minhash-firsts")
    kept = firsts.select(F.col("node").alias("seq"))
    nodes = written(marked.join(kept, "seq", "left_semi").withColumnRenamed("seq", "node").drop("n_shingles"), "minhash-nodes")
    roots = components(links(docs, nodes, doc_id, text, **options))
    rooted = written(firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "minhash-rooted")
    names = written(rooted.groupBy("root").agg(F.min("least").alias("name")), "minhash-names")
    named = written(rooted.join(names, "root").select("set_a", "set_b", "name"), "minhash-named")
    rows = marked.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("name")).otherwise(F.col("doc_id"))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"))
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
