"""Near-duplicate vectors by sorted projection passes.

In each pass a vector gets a key, the signs of its projections on random directions, concatenated; projections start
from the mean of its label, so a direction that all vectors share does not blunt them.  Vectors are ordered by label
and key, and each is compared with at least its ``BLOCK`` neighbours on both sides by exact cosine.  Links of all
passes are united.

Two vectors at cosine ``threshold`` agree in a sign with a known chance, and those that agree in enough signs lie
within one window, so the number of passes follows from the size of the label for a chance of ``RECALL`` to find such a
pair (closer pairs are likelier); a label of up to ``BLOCK`` vectors is compared wholly by one pass.  A label whose
vectors point the same way so much that it would need more than ``MOST`` passes is compared wholly, as all labels are
with ``exact=True``.  A window may end inside a dense group: therefore what the passes united is
compared once more, all members of a component with each other, which gives the number of links of each vector.
Only a link between two components that no pass joined can be missed.

All comparisons are matrix products of chunks of bounded size, which return numbers of links and spanning
forests, never the pairs of a group.

Vectors link only within equal non-null labels and equal lengths.  Vectors that are null, zero, or hold null or
non-finite components link with nothing.  Equal vectors of a label are compared once and link to each other; a
repeated row is one more vector.  A row without any link is its own component; a null id names a component only
if no member has another id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..plans.components import connected_components
from ..plans.global_rank import global_rank
from .common import hot_join, spread, store

THRESHOLD = 0.93
RECALL = 0.999  # chance that the passes find a pair whose cosine is just the threshold
MOST = 48  # passes; labels that need more are compared wholly
BITS = 48  # of the key of a pass
SEED = 11
BLOCK = 1024  # vectors of a block; each block is compared with itself and the next one
SPAN = 8  # blocks that one task reads together
CHUNKS = 8  # of a label above SMALL vectors; more only where a chunk would exceed CHUNK_VALUES
SMALL = 256
BUNDLE = 4096  # vectors of small groups that are compared in one call
CHUNK_VALUES = 1 << 22  # numbers in the vectors of a chunk
TILE = 1024, 2048  # rows and columns of a matrix product


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their vector, and one row per distinct vector that can link."""
    usable = (
        F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0)
    )
    keyed = spread(vectors.select("vec_id", "label", "embedding")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    rows = keyed.withColumn("k1", F.xxhash64("label", "embedding")).withColumn(
        "k2", F.xxhash64(F.lit("second"), "embedding", "label")
    )
    rows = store(rows, "vectors")
    distinct = (
        rows.filter("usable").groupBy("k1", "k2")
        .agg(
            F.first("label").alias("label"), F.first("embedding").alias("embedding"),
            F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"),
        )
        .withColumn("dim", F.size("embedding")).withColumn("cid", F.monotonically_increasing_id())
    )
    return rows, store(distinct, "vector-classes")


def _flat(column) -> np.ndarray:
    """The numbers of a column of vectors."""
    flat = pa.concat_arrays([chunk.flatten() for chunk in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64)


def _unit(column) -> np.ndarray:
    """Unit vectors of a column whose vectors have one length."""
    x = _flat(column).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _close(x: np.ndarray, y: np.ndarray, x32: np.ndarray, y32: np.ndarray, threshold: float) -> np.ndarray:
    """Which cosines reach the threshold: in single precision, and in double precision where that may be wrong."""
    products = x32 @ y32.T
    margin = 1.2e-7 * (x.shape[1] + 4)  # twice the bound on the rounding error
    close = products >= threshold - margin
    if close.any():
        a, b = np.nonzero(close & (products < threshold + margin))
        close[a, b] = (x[a] * y[b]).sum(1) >= threshold
    return close


class _Forest:
    """Spanning forest of links that come as matrices."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), []

    def add(self, close: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        while True:
            # Every tree with a link to another one takes one in each round.
            fresh = close & (self.root[rows][:, None] != self.root[columns][None, :])
            of_row, of_column = np.flatnonzero(fresh.any(1)), np.flatnonzero(fresh.any(0))
            if not len(of_row):
                return
            a = np.concatenate((rows[of_row], rows[fresh[:, of_column].argmax(0)]))
            b = np.concatenate((columns[fresh[of_row].argmax(1)], columns[of_column]))
            for i, j in zip(a.tolist(), b.tolist()):
                x, y = self._find(i), self._find(j)
                if x != y:
                    self.root[max(x, y)] = min(x, y)
                    self.links.append((i, j))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def _find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i


def _runs(table: pa.Table, *keys: str) -> list[tuple[int, int]]:
    """Ranges (lo, hi) of consecutive rows that agree in ``keys``."""
    if not table.num_rows:
        return []
    starts = np.zeros(table.num_rows, dtype=bool)
    starts[0] = True
    for name in keys:
        codes = table.column(name).combine_chunks().dictionary_encode().indices.to_numpy()
        starts[1:] |= codes[1:] != codes[:-1]
    at = np.flatnonzero(starts)
    return list(zip(at.tolist(), [*at[1:].tolist(), table.num_rows]))


class _Comparison:
    """Links among vectors of one group: their numbers by weight, and a spanning forest."""

    def __init__(self, vectors, weight: np.ndarray, threshold: float):
        self.x = _unit(vectors)
        self.x32 = self.x.astype(np.float32)
        self.weight, self.threshold = weight, threshold
        self.links, self.forest = np.zeros(len(weight), dtype=np.int64), _Forest(len(weight))

    def meet(self, left: np.ndarray, right: np.ndarray, same: bool) -> None:
        """Compare positions ``left`` with ``right``; ``same`` if they are one set, whose pairs count once."""
        for lo in range(0, len(left), TILE[0]):
            rows = left[lo : lo + TILE[0]]
            for at in range(0, len(right), TILE[1]):
                columns = right[at : at + TILE[1]]
                if same and columns[-1] <= rows[0]:
                    continue
                close = _close(self.x[rows], self.x[columns], self.x32[rows], self.x32[columns], self.threshold)
                if same:
                    close &= rows[:, None] < columns[None, :]
                if not close.any():
                    continue
                a, b = np.nonzero(close)
                self.links[rows] += np.bincount(a, weights=self.weight[columns[b]], minlength=len(rows)).astype(np.int64)
                self.links[columns] += np.bincount(b, weights=self.weight[rows[a]], minlength=len(columns)).astype(np.int64)
                self.forest.add(close, rows, columns)


def all_links(groups: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links): links of spanning forests, and with a null ``b`` parts of the number of links of ``a``.

    ``groups``: label, dim, cid, weight, embedding; all pairs of equal ``label`` and ``dim`` are compared.
    """
    count = F.count(F.lit(1))
    chunks = F.when(count <= SMALL, 1).otherwise(F.greatest(F.lit(CHUNKS), F.ceil(count * F.col("dim") / CHUNK_VALUES)))
    sizes = store(groups.groupBy("label", "dim").agg(chunks.cast("int").alias("chunks"), count.alias("n")), "vector-groups")
    in_small = sizes.filter("chunks = 1").agg(F.sum("n")).first()[0] or 0
    bundles = max(1, math.ceil(in_small / BUNDLE))
    named = F.xxhash64("label", "dim")
    met = (
        hot_join(groups.select("label", "dim", "cid", "weight", "embedding"), sizes.filter("n > 1").drop("n"), "label", "dim")
        .withColumn("bundle", F.when(F.col("chunks") == 1, F.pmod(named, F.lit(bundles))).otherwise(named))
        .withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("bundle", "label", "dim", F.least("chunk", "other").alias("p"), F.greatest("chunk", "other").alias("q"),
                "chunk", "cid", "weight", "embedding")
    )

    def compare(table: pa.Table) -> pa.Table:
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        table = table.sort_by([("label", "ascending"), ("dim", "ascending")])
        cid, weight = table.column("cid").to_numpy(), table.column("weight").to_numpy()
        chunk, vectors = table.column("chunk").to_numpy(), table.column("embedding")
        a, b, links = [], [], []
        for lo, hi in _runs(table, "label", "dim"):
            group = _Comparison(vectors.slice(lo, hi - lo), weight[lo:hi], threshold)
            left, right = np.flatnonzero(chunk[lo:hi] == p), np.flatnonzero(chunk[lo:hi] == q)
            group.meet(left, right, p == q)
            own = cid[lo:hi]
            some = np.flatnonzero(group.links)
            pairs = np.array(group.forest.links, dtype=np.int64).reshape(-1, 2)
            a += own[some].tolist() + own[pairs[:, 0]].tolist()
            b += [None] * len(some) + own[pairs[:, 1]].tolist()
            links += group.links[some].tolist() + [0] * len(pairs)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(links, pa.int64())})

    return met.groupBy("bundle", "p", "q").applyInArrow(compare, "a long, b long, links long")


def _means(vectors: DataFrame) -> DataFrame:
    """(label, dim, mean) of the unit vectors: a sum per task and group, then a sum of those."""
    label = vectors.schema["label"]
    schema = StructType([
        StructField("label", label.dataType), StructField("dim", IntegerType()),
        StructField("total", ArrayType(DoubleType())), StructField("rows", LongType()),
    ])

    def partial(batches):
        sums: dict = {}
        kind = None
        for batch in batches:
            kind = batch.schema.field("label").type
            table = pa.Table.from_batches([batch]).sort_by([("label", "ascending"), ("dim", "ascending")])
            for lo, hi in _runs(table, "label", "dim"):
                x = _unit(table.column("embedding").slice(lo, hi - lo))
                total = sums.setdefault((table.column("label")[lo].as_py(), x.shape[1]), [np.zeros(x.shape[1]), 0])
                total[0] += x.sum(0)
                total[1] += len(x)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in sums], kind), pa.array([k[1] for k in sums], pa.int32()),
                    pa.array([v[0].tolist() for v in sums.values()], pa.list_(pa.float64())),
                    pa.array([v[1] for v in sums.values()], pa.int64()),
                ],
                names=schema.names,
            )

    def whole(table: pa.Table) -> pa.Table:
        total = np.stack([np.asarray(v) for v in table.column("total").to_pylist()]).sum(0)
        mean = np.round(total / table.column("rows").to_numpy().sum(), 6)  # whatever the order of the sums
        one = table.select(["label", "dim"]).slice(0, 1)
        return one.append_column("mean", pa.array([mean.tolist()], pa.list_(pa.float64())))

    out = StructType([*schema.fields[:2], StructField("mean", ArrayType(DoubleType()))])
    return vectors.select("label", "dim", "embedding").mapInArrow(partial, schema).groupBy("label", "dim").applyInArrow(whole, out)


def plan_passes(distinct: DataFrame, threshold: float, recall: float = RECALL) -> DataFrame:
    """(label, dim, mean, passes) of labels with two vectors or more; ``mean`` is null where one pass is exact."""
    sizes = store(distinct.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "vector-labels")
    large = hot_join(distinct.select("label", "dim", "embedding"), sizes.filter(F.col("n") > BLOCK), "label", "dim")
    means = store(_means(large), "vector-means")
    # What unrelated vectors have in common, on average; a pair at the threshold has so much less without it.
    shared = F.least(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x), F.lit(0.999))
    apart = F.greatest((F.lit(threshold) - shared) / (1 - shared), F.lit(0.0))
    agree = 1 - F.acos(apart) / math.pi
    # Vectors that agree in so many signs are fewer than a block; one more sign for parts that are not even.
    window = F.pow(agree, F.ceil(F.log2(F.col("n") / BLOCK)) + 1)
    needed = F.ceil(math.log(1 - recall) / F.log(1 - window))
    passes = F.when(F.col("n") <= BLOCK, 1).otherwise(F.least(needed, F.lit(MOST + 1))).cast("int")
    return store(sizes.join(means, ["label", "dim"], "left").select("label", "dim", "mean", passes.alias("passes")), "vector-passes")


def sort_keys(vectors: DataFrame) -> DataFrame:
    """(turn, label, dim, key, cid): the key of each vector in each of its passes."""
    label = vectors.schema["label"]
    schema = StructType([
        StructField("turn", IntegerType()), StructField("label", label.dataType), StructField("dim", IntegerType()),
        StructField("key", LongType()), StructField("cid", LongType()),
    ])
    powers = 1 << np.arange(BITS, dtype=np.int64)[::-1]

    def run(batches):
        directions: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("dim")
            for lo, hi in _runs(table, "dim"):
                part = table.slice(lo, hi - lo)
                x = _unit(part.column("embedding"))
                d = x.shape[1]
                x = x - _flat(part.column("mean")).reshape(-1, d)
                passes = part.column("passes").to_numpy()
                for turn in range(int(passes.max())):
                    if (d, turn) not in directions:
                        directions[d, turn] = np.random.default_rng([SEED, turn, d]).normal(size=(d, BITS))
                    at = np.flatnonzero(passes > turn)
                    keys = (x[at] @ directions[d, turn] > 0) @ powers
                    chosen = part.take(pa.array(at)).combine_chunks()
                    for found in chosen.select(["label", "dim", "cid"]).to_batches():
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(keys), turn, np.int32)), found.column("label"), found.column("dim"),
                                pa.array(keys, pa.int64()), found.column("cid"),
                            ],
                            names=schema.names,
                        )

    centred = F.coalesce("mean", F.array_repeat(F.lit(0.0), F.col("dim"))).alias("mean")
    return vectors.select("label", "dim", "cid", "embedding", "passes", centred).mapInArrow(run, schema)


def neighbour_links(distinct: DataFrame, plan: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a spanning forest of the links that each part of each pass finds."""
    vectors = hot_join(distinct.select("label", "dim", "cid", "embedding"), plan, "label", "dim")
    keys = store(sort_keys(vectors), "vector-keys")
    order = [F.col(c) for c in ("turn", "label", "dim", "key", "cid")]
    ranked = global_rank(keys, order).select("turn", "cid", "rank")
    part = F.floor(F.col("rank") / (SPAN * BLOCK))
    # The first block of a part also ends the part before.
    parts = F.when((F.col("rank") % (SPAN * BLOCK) < BLOCK) & (part > 0), F.array(part, part - 1)).otherwise(F.array(part))
    met = ranked.join(distinct.select("cid", "label", "dim", "embedding"), "cid").withColumn("part", F.explode(parts))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        part = table.column("part")[0].as_py()
        cid, block = table.column("cid").to_numpy(), table.column("rank").to_numpy() // BLOCK
        a, b = [], []
        for lo, hi in _runs(table, "turn", "label", "dim"):
            if hi - lo < 2:
                continue
            group = _Comparison(table.column("embedding").slice(lo, hi - lo), np.ones(hi - lo), threshold)
            own = block[lo:hi]
            for at in range(part * SPAN, (part + 1) * SPAN):
                here, after = np.flatnonzero(own == at), np.flatnonzero(own == at + 1)
                group.meet(here, here, True)
                group.meet(here, after, False)
            pairs = np.array(group.forest.links, dtype=np.int64).reshape(-1, 2) + lo
            a += cid[pairs[:, 0]].tolist()
            b += cid[pairs[:, 1]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("part").applyInArrow(compare, "a long, b long")


def _components(edges: DataFrame) -> DataFrame:
    return store(connected_components(edges).select(F.col("id").alias("cid"), "component"), "vector-components")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """Rows of ``vec_id`` with ``n_links``, ``component_id`` and ``kept``; ``exact`` compares all pairs of all labels."""
    rows, distinct = classes(vectors)
    if exact:
        links = store(all_links(distinct, threshold), "vector-links")
        found = _components(links.filter("b is not null"))
    else:
        plan = plan_passes(distinct, threshold)
        sorted_labels, whole = plan.filter(F.col("passes") <= MOST), plan.filter(F.col("passes") > MOST)
        edges, links, passed = neighbour_links(distinct, sorted_labels, threshold), None, distinct
        if whole.limit(1).count():
            passed = hot_join(distinct, sorted_labels.select("label", "dim"), "label", "dim")
            dense = hot_join(distinct, whole.select("label", "dim"), "label", "dim")
            links = store(all_links(dense, threshold), "vector-links")
            edges = edges.unionByName(links.filter("b is not null").select("a", "b"))
        found = _components(store(edges.distinct(), "vector-edges"))
        members = passed.join(found, "cid").select("cid", F.col("component").alias("label"), "dim", "weight", "embedding")
        within = store(all_links(store(members, "vector-members"), threshold), "vector-links")
        links = within if links is None else links.unionByName(within)
    # A component may hold most vectors: it is named before its members are told.
    lows = found.join(distinct.select("cid", "low"), "cid")
    named = lows.groupBy("component").agg(F.min("low").alias("component_id"))
    sized = hot_join(found, store(named, "vector-groups"), "component")
    degrees = links.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    of_class = (
        distinct.select("cid", "k1", "k2", "low", "weight")
        .join(sized.select("cid", "component_id"), "cid", "left").join(degrees, "cid", "left")
        .select(
            "k1", "k2", F.coalesce("component_id", "low").alias("component_id"),
            (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    # So may the copies of a vector.
    able = hot_join(rows.filter("usable").select("vec_id", "k1", "k2"), store(of_class, "vector-answers"), "k1", "k2")
    alone = rows.filter("not usable").select("vec_id", F.col("vec_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = able.select("vec_id", "component_id", "n_links").unionByName(alone)
    return out.select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def op6(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings)
