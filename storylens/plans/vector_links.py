"""Exact links between similar vectors, enough to find connected components.

Vectors are dealt into blocks of bounded size, and every two blocks are compared once as a matrix
product: half of all pairs, whatever the threshold.  (Cells around pivots prune nothing at the low
thresholds and many dimensions of text vectors; they only made copies.)  A block alone returns a
star for each of its components, and a pair of blocks only links between such components: the links
are linear in the rows, whatever the density, and those of pairs are few where components are large.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit
from .lineage import cut
from .set_scores import stars

BLOCK_ROWS, MAX_BLOCK_ROWS = 1000, 65_536
TASKS = 4  # pairs of blocks for each core at least, while blocks are above the smallest size
TILE = 1024


def spanning_links(vectors: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) whose components equal those of all pairs with cosine >= threshold.

    ``vectors`` has ``id`` (string) and ``embedding``.  Copies of one vector are tied to
    the lowest id and only that one is compared.
    """
    units = vectors.filter(F.size("embedding") > 0).select("id", unit("embedding").alias("u"))
    units = units.filter(F.exists("u", lambda x: x != 0))
    keyed = cut(units.withColumn("h", F.md5(F.to_json(F.struct("u")))))
    unique = keyed.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copies = (
        keyed.join(unique.filter("n > 1"), "h").filter("id <> rep")
        .select(F.col("rep").alias("a"), F.col("id").alias("b"))
    )
    distinct = cut(
        keyed.join(unique.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "u")
    )
    links = _compare_blocks(distinct, distinct.count(), threshold)
    return links.unionByName(copies).distinct()


def _compare_blocks(distinct: DataFrame, count: int, threshold: float) -> DataFrame:
    """Links of all blocks: first each block alone, then pairs of blocks, which know what their rows belong to already."""
    pairs = 2 * TASKS * distinct.sparkSession.sparkContext.defaultParallelism
    rows = min(max(math.ceil(count / math.sqrt(pairs)), BLOCK_ROWS), MAX_BLOCK_ROWS)
    blocks = max(1, -(-count // rows))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")

    def alone(table: pa.Table) -> pa.Table:
        u, ids = _matrix(table), table.column("id").to_numpy(zero_copy_only=False)
        least = _joined(u, u, np.arange(len(ids)), threshold)
        return table.append_column("root", pa.array(ids[least], type=pa.string()))

    own = distinct.select("id", "u", block.alias("block"))
    rooted = cut(own.groupBy("block").applyInArrow(alone, "id string, u array<double>, block int, root string"))
    links = rooted.filter("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b"))
    if blocks == 1:
        return links

    def across(table: pa.Table) -> pa.Table:
        left, right = (table.filter(pc.equal(table.column("block"), table.column(c)[0])) for c in ("p", "q"))
        roots = np.concatenate([t.column("root").to_numpy(zero_copy_only=False) for t in (left, right)])
        names, first, at = np.unique(roots, return_index=True, return_inverse=True)
        least = _joined(_matrix(left), _matrix(right), first[at], threshold)
        nodes = np.flatnonzero(least[first] != first)
        return pa.table({"a": pa.array(roots[least[first[nodes]]], type=pa.string()), "b": pa.array(names[nodes], type=pa.string())})

    met = rooted.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).filter("other <> block").select(
        F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "u", "root"
    )
    # A pair of blocks is a task's work, however few bytes it has: coalescing would put many of them into one task.
    tasks = met.repartition(min(4 * pairs, 4 * blocks * blocks), "p", "q")
    return links.unionByName(tasks.groupBy("p", "q").applyInArrow(across, "a string, b string"))


def _matrix(table: pa.Table) -> np.ndarray:
    flat = pc.list_flatten(table.column("u")).to_numpy()
    return flat.reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def _joined(x: np.ndarray, y: np.ndarray, least: np.ndarray, threshold: float) -> np.ndarray:
    """Least node of the component of every row of ``x`` and then, unless it is the same, of ``y``.

    ``least`` says what is joined already; tile by tile only links between different components are looked at.
    """
    behind = 0 if x is y else len(x)
    for top in range(0, len(x), TILE):
        for at in range(0, len(y), 4 * TILE):
            i, j = slice(top, top + TILE), slice(at, at + 4 * TILE)
            if not len(x[i]) or not len(y[j]):
                continue
            close = x[i] @ y[j].T >= threshold
            close &= least[: len(x)][i, None] != least[behind : behind + len(y)][None, j]
            a, b = np.divmod(np.flatnonzero(close), close.shape[1])
            if len(a):
                low, node = stars(least[a + top], least[b + at + behind], len(least))
                to = np.arange(len(least))
                to[node] = low
                least = to[least]
    return least


def _forest(close: np.ndarray, rows: np.ndarray, cols: np.ndarray, same: bool) -> pd.DataFrame:
    """Spanning forest of a block: breadth-first over rows and columns."""
    offset = 0 if same else len(rows)
    total = len(rows) if same else len(rows) + len(cols)
    ids = rows if same else np.concatenate([rows, cols])
    seen = np.zeros(total, dtype=bool)
    a, b = [], []
    for start in range(total):
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        while queue:
            at = queue.pop()
            if same:
                reach = np.nonzero(close[at])[0]
            elif at < offset:
                reach = np.nonzero(close[at])[0] + offset
            else:
                reach = np.nonzero(close[:, at - offset])[0]
            fresh = reach[~seen[reach]]
            seen[fresh] = True
            a.extend([ids[at]] * len(fresh))
            b.extend(ids[fresh])
            queue.extend(fresh.tolist())
    return pd.DataFrame({"a": np.array(a, dtype=object), "b": np.array(b, dtype=object)})
