"""Exact similarity self-join on weighted feature sets, without comparing all pairs.

Each text is a set of features.  A feature shared by two texts adds at most its weight to
their similarity, seen from either side, and the weights of one text sum to one.  Features
have one global order, rarest first.  If the rarest feature two texts share is at position
``i`` of a text, all they share weighs at most the sum of weights from ``i`` on; so only
positions where that sum reaches the threshold need to be join keys.

A key carried by very many texts would still pair them all.  Such a hot key is not joined:
the next rarest shared feature is appended to it (then a third, and so on), under the same
bound with the weight of the key's own features added.  Two texts that share nothing
beyond a hot key can only be similar when the key alone reaches the threshold in both, so
just those texts are joined on the hot key itself.  Every similar pair is found under some
key; keys get longer only where they are hot.

Rows of a key also carry bit maps of their sets: every element sets one bit.  An element whose bit the other text
lacks is not shared, so the bits of one side without those of the other bound the overlap from above, and a pair
whose bounds stay below the threshold is dropped while the key is read, before any set is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import lookup_join
from .lineage import cut

HOT_KEY_ROWS = 256
MAX_KEY_FEATURES = 4
SLACK = 1e-9
WORDS = 8  # 64-bit words in the bit map of a set


def ranked_features(docs: DataFrame, sets: dict[str, tuple[str, float]], lead: str | None = None) -> DataFrame:
    """Rows (id, features): features as (late, feature, weight, tail), rarest first.

    ``docs`` has ``id`` and one array column per set; ``tail`` is the sum of weights from a
    feature to the end.  The order is (document frequency, feature): every task computes
    it alike.  Values in the array column ``lead`` come before all others.  The list
    collected per text is that text's own feature set.
    """
    def weighted(name: str, column: str, share: float) -> Column:
        weight = F.lit(share) / F.greatest(F.size(column), F.lit(1))
        return F.transform(
            F.col(column),
            lambda f: F.struct(
                (~F.array_contains(lead, f) if lead else F.lit(True)).alias("late"),
                F.concat(F.lit(name), f).alias("feature"),
                weight.alias("weight"),
            ),
        )

    parts = [weighted(name, column, share) for name, (column, share) in sets.items()]
    exploded = docs.select("id", F.explode(F.concat(*parts)).alias("f")).select("id", "f.*")
    # Common features are carried by most texts, hence a lookup and not a plain join.
    frequency = cut(exploded.groupBy("feature").agg(F.count(F.lit(1)).alias("df")))
    ordered = (
        lookup_join(exploded, frequency, "feature", rows=frequency.count())
        .groupBy("id")
        .agg(F.array_sort(F.collect_list(F.struct("late", "df", "feature", "weight"))).alias("o"))
    )
    features = F.reverse(
        F.aggregate(
            F.reverse(F.col("o")),
            F.struct(
                F.lit(0.0).alias("tail"),
                F.array().cast("array<struct<late:boolean,feature:string,weight:double,tail:double>>").alias("out"),
            ),
            lambda acc, x: F.struct(
                (acc["tail"] + x["weight"]).alias("tail"),
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            x["late"].alias("late"),
                            x["feature"].alias("feature"),
                            x["weight"].alias("weight"),
                            (acc["tail"] + x["weight"]).alias("tail"),
                        )
                    ),
                ).alias("out"),
            ),
            lambda acc: acc["out"],
        )
    )
    return ordered.select("id", features.alias("features"))


def candidate_pairs(
    docs: DataFrame,
    sets: dict[str, tuple[str, float]],
    threshold: float,
    block: str | None = None,
    lead: str | None = None,
    hot_rows: int = HOT_KEY_ROWS,
    max_features: int = MAX_KEY_FEATURES,
) -> DataFrame:
    """Distinct pairs (a, b), a < b, that contain every pair reaching ``threshold``.

    ``docs`` must have unique feature sets (collapse copies first).  With ``block`` only
    pairs of the same block value are wanted, with ``lead`` (an array column of feature
    values) only pairs that share one of its values.
    """
    names = list(sets)
    columns = [sets[n][0] for n in names]
    shares = [sets[n][1] for n in names]
    features = cut(ranked_features(docs, sets, lead))
    sizes = docs.select(
        "id",
        *[F.size(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[_bit_map(c).alias(f"m{i}") for i, c in enumerate(columns)],
        (F.col(block).cast("string") if block else F.lit("")).alias("block"),
    )
    sizes = cut(sizes.select(
        "id", "block", *[f"n{i}" for i in range(len(columns))],
        *[F.element_at(f"m{i}", w + 1).alias(f"m{i}_{w}") for i in range(len(columns)) for w in range(WORDS)],
    ))
    size_names = [c for c in sizes.columns if c not in ("id", "block")]
    limit = threshold - SLACK

    keys = (
        features.join(sizes, "id")
        .select("id", *size_names, "block", F.posexplode("features").alias("at", "f"))
        .filter((F.col("f.tail") >= limit) & (~F.col("f.late") if lead else F.lit(True)))
        .select(
            "id",
            *size_names,
            F.concat_ws("|", "block", "f.feature").alias("key"),
            F.col("f.weight").alias("key_weight"),
            "at",
        )
    )
    pairs: list[DataFrame] = []
    for length in range(1, max_features + 1):
        keys = cut(keys)
        carried = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
        keyed = lookup_join(keys, carried, "key", rows=carried.count())
        last = length == max_features
        usable = keyed if last else keyed.filter(F.col("rows") <= hot_rows)
        pairs.append(_join_on_key(usable, size_names, shares, limit))
        if last:
            break
        hot = cut(keyed.filter(F.col("rows") > hot_rows).drop("rows"))
        if hot.isEmpty():
            break
        pairs.append(_join_on_key(hot.filter(F.col("key_weight") >= limit), size_names, shares, limit))
        keys = (
            hot.join(features, "id")
            .select("*", F.posexplode("features").alias("next_at", "f"))
            .filter((F.col("next_at") > F.col("at")) & (F.col("key_weight") + F.col("f.tail") >= limit))
            .select(
                "id",
                *size_names,
                F.concat_ws("|", "key", "f.feature").alias("key"),
                (F.col("key_weight") + F.col("f.weight")).alias("key_weight"),
                F.col("next_at").alias("at"),
            )
        )
    found = pairs[0]
    for more in pairs[1:]:
        found = found.unionByName(more)
    return found.distinct()


def _bit_map(elements: str) -> Column:
    """``WORDS`` long values with the bit of every element's hash."""
    hashes = F.transform(elements, lambda e: F.pmod(F.xxhash64(e), F.lit(64 * WORDS)).cast("int"))
    empty = F.array(*[F.lit(0).cast("long")] * WORDS)
    one = F.lit(1).cast("long")

    def add(bits: Column, h: Column) -> Column:
        bit = F.call_function("shiftleft", one, h % 64)
        return F.transform(bits, lambda word, k: F.when(k == F.floor(h / 64), word.bitwiseOR(bit)).otherwise(word))

    return F.aggregate(F.array_distinct(hashes), empty, add)


def _overlap_bound(i: int) -> Column:
    """At most so many elements of set ``i`` are shared by the texts a and b."""

    def alone(x: str, y: str) -> Column:
        missing = [F.bit_count(F.col(f"{x}_m{i}_{w}").bitwiseAND(F.bitwise_not(f"{y}_m{i}_{w}"))) for w in range(WORDS)]
        return F.col(f"{x}_n{i}") - sum(missing[1:], missing[0])

    return F.least(alone("a", "b"), alone("b", "a"))


def _join_on_key(keys: DataFrame, sizes: list[str], shares: list[float], limit: float) -> DataFrame:
    """Pairs of texts with a common key whose sizes and bit maps allow the threshold."""
    left = keys.select("key", F.col("id").alias("a"), *[F.col(s).alias(f"a_{s}") for s in sizes])
    right = keys.select("key", F.col("id").alias("b"), *[F.col(s).alias(f"b_{s}") for s in sizes])
    by_size: Column = F.lit(0.0)
    by_bits: Column = F.lit(0.0)
    for i, share in enumerate(shares):
        a, b = F.col(f"a_n{i}"), F.col(f"b_n{i}")
        by_size = by_size + F.lit(share) * F.least(a, b) / F.greatest(a, b, F.lit(1))
        shared = _overlap_bound(i)
        by_bits = by_bits + F.lit(share) * shared / F.greatest(a + b - shared, F.lit(1))
    near = (F.col("a") < F.col("b")) & (by_size >= limit)
    return left.join(right, "key").filter(near & (by_bits >= limit)).select("a", "b")
