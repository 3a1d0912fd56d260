"""Near-duplicates by SimHash fingerprints, found with tables of distances to reference fingerprints.

A fingerprint is the bitwise majority of the hashes of a text's shingles.  Two link if they differ in at
most ``MAX_BITS`` bits.  The references are the zero fingerprint and one for each disjoint block of bits; the
Hamming distances of every distinct fingerprint to them form its row of the table.  From these follow the
set bits in each block, so two fingerprints that link agree exactly in all blocks but ``MAX_BITS``: blocks
are dealt into groups, and every pair that links shares the distances of all but ``MAX_BITS`` groups.
Fingerprints that share such a part meet; a pair is discarded when any coordinate of its rows differs by
more than ``MAX_BITS``, and survivors are verified.  A part that many fingerprints share is cut into chunks
that are compared pairwise.  Of its links a chunk pair returns a spanning forest, which is all that
components need, so no step returns the pairs of a group.

Null, empty and blank texts have fingerprint zero, and link like others.  Equal fingerprints are compared
once.  Repeated rows stay rows.  A null id never names a component if its members have another id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from .common import hot_join, map_texts, spread, store

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
BLOCK_BITS = 2  # bits of a block: 32 blocks and references
GROUPS = 4  # of blocks: 6 parts of two groups each
CHUNK = 1024  # fingerprints compared with as many others at once

REFERENCES = [0] + [((1 << BLOCK_BITS) - 1) << at for at in range(0, 64, BLOCK_BITS)]


def fingerprints(texts: list[str], words_in_shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """Fingerprint of each whole text (uint64)."""
    digest = xxhash.xxh64_intdigest
    hashes: list[int] = []
    count = np.zeros(len(texts), dtype=np.int64)
    out = np.zeros(len(texts), dtype=np.uint64)
    first = 0

    def settle(last: int) -> None:
        part = count[first:last]
        some = np.flatnonzero(part)
        if len(some):
            out[first + some] = _majority(np.array(hashes, dtype=np.uint64), part[some])
        hashes.clear()

    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
        if len(words) >= words_in_shingle:
            shingles = map(b" ".join, zip(*(words[k:] for k in range(words_in_shingle))))
        else:
            shingles = [b" ".join(words)] if words else []
        before = len(hashes)
        hashes.extend([digest(s, SEED) for s in shingles])
        count[i] = len(hashes) - before
        if len(hashes) > 200_000:
            settle(i + 1)
            first = i + 1
    settle(len(texts))
    return out


def _majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bits that more than half of each run of hashes have set."""
    ends = np.cumsum(count)
    begins = ends - count
    # Eight counters to a word: runs are cut so that none passes 255.
    pieces = -(-count // 255)
    owner = np.repeat(np.arange(len(count)), pieces)
    start = begins[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    first_piece = np.cumsum(pieces) - pieces
    out = np.zeros(len(count), dtype=np.uint64)
    lanes = np.uint64(0x0101010101010101)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & lanes, start)
        counters = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first_piece, axis=0)
        for byte in range(8):
            over = (2 * counters[:, byte] > count).astype(np.uint64)
            out |= over << np.uint64(8 * byte + bit)
    return out


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fp`` (long) in place of ``text``."""
    return map_texts(spread(docs.drop("fp")), lambda texts: {"fp": fingerprints(texts).view(np.int64)}, "fp long")


def _distance(fp: Column, reference: int) -> Column:
    signed = reference - (1 << 64) if reference >= 1 << 63 else reference
    return F.bit_count(fp.bitwiseXOR(F.lit(signed).cast("long")))


def parts(fp: Column) -> list[Column]:
    """For every choice of groups: a number that holds the distances of ``fp`` to their references."""
    zero = _distance(fp, 0)
    # Set bits of a block: distances to zero and to the block's reference decide them.
    blocks = [((zero - _distance(fp, r) + BLOCK_BITS) / 2).cast("long") for r in REFERENCES[1:]]
    groups = [blocks[g::GROUPS] for g in range(GROUPS)]
    out = []
    for kept in combinations(range(GROUPS), GROUPS - MAX_BITS):
        key = F.lit(0).cast("long")
        for block in [b for g in kept for b in groups[g]]:
            key = key * (BLOCK_BITS + 1) + block
        out.append(key)
    return out


def _forest(close: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of a symmetric boolean matrix."""
    left = np.ones(len(close), dtype=bool)
    edges = []
    for root in range(len(close)):
        if not left[root]:
            continue
        left[root] = False
        todo = [root]
        while todo:
            at = todo.pop()
            fresh = np.flatnonzero(close[at] & left)
            left[fresh] = False
            edges += [(at, f) for f in fresh.tolist()]
            todo += fresh.tolist()
    return edges


def _linked(fp: np.ndarray, table: np.ndarray, side: np.ndarray, crossed: bool) -> list[tuple[int, int]]:
    """Links among the fingerprints of a part: all pairs, or those between two chunks of it."""
    near = np.ones((len(fp), len(fp)), dtype=bool)
    if crossed:
        near = side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    for column in table.T:
        near &= np.abs(column[:, None] - column[None, :]) <= MAX_BITS
        if not near.any():
            return []
    a, b = np.nonzero(np.triu(near))
    true = np.bitwise_count(fp[a] ^ fp[b]) <= MAX_BITS
    if true.sum() <= 3:
        return list(zip(a[true].tolist(), b[true].tolist()))
    near[:] = False
    near[a[true], b[true]] = near[b[true], a[true]] = True
    return _forest(near)


def _compare(batches):
    """Rows sorted by (part, key, chunk pair): links of each run.  A run may span batches."""
    names = ["part", "key", "p", "q", "chunk", "fp"]
    kept = None
    for batch in _chain(batches):
        rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names} if batch is not None else None
        if kept is not None and rows is not None:
            rows = {n: np.concatenate([kept[n], rows[n]]) for n in names}
        rows = kept if rows is None else rows
        if rows is None or not len(rows["fp"]):
            continue
        keys = np.stack([rows[n] for n in names[:4]])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        bounds = [0, *cut.tolist(), len(rows["fp"])]
        if batch is not None:  # the last run may go on
            kept = {n: v[bounds[-2] :] for n, v in rows.items()}
            bounds.pop()
        fp = rows["fp"].view(np.uint64)
        low, high = [], []
        for lo, hi in zip(bounds, bounds[1:]):
            if hi - lo < 2:
                continue
            run = fp[lo:hi]
            table = np.stack([np.bitwise_count(run ^ np.uint64(r)).astype(np.int8) for r in REFERENCES], 1)
            for i, j in _linked(run, table, rows["chunk"][lo:hi], rows["p"][lo] != rows["q"][lo]):
                low.append(rows["fp"][lo + i])
                high.append(rows["fp"][lo + j])
        yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["a", "b"])


def _chain(batches):
    yield from batches
    yield None


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between the rows of ``distinct`` (a column ``fp``): enough for their components."""
    keyed = distinct.select(
        "fp", F.posexplode(F.array(*parts(F.col("fp")))).alias("part", "key")
    )
    crowds = keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = (
        keyed.join(crowds, ["part", "key"])
        .withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "part", "key", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"), "chunk", "fp"
        )
    )
    dealt = met.repartition("part", "key", "p", "q").sortWithinPartitions("part", "key", "p", "q")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def components(fingerprinted: DataFrame) -> DataFrame:
    """Rows of ``doc_id`` and ``fp`` with ``component_id`` and ``group``, which is never null."""
    rows = store(fingerprinted.select("doc_id", "fp"), "simhash-rows")
    distinct = store(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    found = connected_components(store(links(distinct.select("fp")), "simhash-links"))
    placed = store(
        distinct.join(found.withColumnRenamed("id", "fp"), "fp", "left").select(
            "fp", "low", F.coalesce("component", "fp").alias("component")
        ),
        "simhash-placed",
    )
    # A component may hold most fingerprints, and a fingerprint most documents.
    lowest = store(placed.groupBy("component").agg(F.min("low").alias("component_id")), "simhash-lowest")
    of_fp = hot_join(placed, lowest, "component").select("fp", "component_id", F.col("component").alias("group"))
    return hot_join(rows, store(of_fp, "simhash-named"), "fp")


def op7(documents: DataFrame) -> DataFrame:
    out = components(with_fingerprint(documents.select("doc_id", "text")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
