"""The prefix trie of conversations, with totals of every subtree, by bands of depth.

A node is a distinct sequence of first turns.  It is known by its depth and the exclusive or of strong hashes of
(position, role, text) over its turns, as two independent 64-bit halves; its parent's key follows from its own
and that of its last turn.

Totals of subtrees (leaves, tokens that sharing prefixes saves) go up by bands of ``height`` depths.  Inside a band
every node explodes to its ancestors in the band only; what has been summed up at the root of a band, the last node of
the band above, is added there before that band explodes.  ``height`` is the square root of the largest depth, but at
least ``HEIGHT``: so many rounds, and so many ancestors of a node at most.

Turns are ordered by ``turn`` (null first), then role, the begin of the text and a hash of it, by a global rank, so a
long conversation or many equal turn numbers are no single task.  Null roles and texts are empty ones.  A repeated
row is one more turn.  Rows without a ``conv_id`` belong to no conversation and are left out.  An empty table has no
nodes, not even the root.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.global_rank import global_rank
from ..plans.joins import lookup_join
from .common import hot_join, spread, store

HEIGHT = 16  # least number of depths in a band
SLOT = 4096  # positions of a conversation that are hashed together, and conv_ids whose ends are
ROOT = (0, 0)  # key of the textless root


def _hash(seed: str, *of) -> Column:
    return F.xxhash64(F.lit(seed), *of)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos`` (from 0), hashes ``c1, c2`` of role and text, and ``words`` of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = spread(conversations.select("conv_id", "turn", "role", "text")).filter("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.substring(text, 1, 64).alias("begin"),
        _hash("a", role, text).alias("c1"), _hash("b", text, role).alias("c2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    rows = store(rows.withColumn("uid", F.monotonically_increasing_id()), "trie-turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "begin", "c1", "c2", "uid"]
    ranked = store(global_rank(rows, [F.col(c).asc() if isinstance(c, str) else c for c in order], "at"), "trie-ranked")
    first = ranked.groupBy("conv_id").agg(F.min("at").alias("first"))
    numbered = lookup_join(ranked, first, "conv_id", rows=first.count())
    return numbered.select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "c1", "c2", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns after the first h turns of each conversation are replaced by those of another; and all conv_ids."""
    turns = store(turns, "trie-ordered")
    content = F.struct("pos", "c1", "c2", "words")
    heads = turns.filter("pos < 3").groupBy("conv_id").agg(F.array_sort(F.collect_list(content)).alias("head"))
    heads = store(heads, "trie-heads")  # every conversation has a first turn
    conv = F.col("conv_id")
    shared = F.crc32(conv.cast("string").cast("binary")) % 4
    base = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    convs = (
        heads.select("conv_id", shared.alias("h"), (conv - conv % 20).alias("base")).join(base, "base", "left")
        .select("conv_id", "h", F.slice(F.coalesce("base_head", F.array().cast(heads.schema["head"].dataType)), 1, 3).alias("of"))
        .withColumn("head", F.filter("of", lambda x: x["pos"] < F.col("h"))).drop("of")
    )
    convs = store(convs, "trie-convs")
    borrowed = convs.select("conv_id", F.inline("head"))
    # Own turns follow; they move up where the other conversation had fewer than h turns.
    short = convs.filter(F.size("head") < F.col("h")).select("conv_id", (F.col("h") - F.size("head")).alias("missing"))
    own = turns.filter(F.col("pos") >= shared)
    own = lookup_join(own, short, "conv_id", "left", rows=short.count())
    own = own.select("conv_id", (F.col("pos") - F.coalesce("missing", F.lit(0))).alias("pos"), "c1", "c2", "words")
    return borrowed.unionByName(own), convs.select("conv_id")


def rolled(turns: DataFrame) -> DataFrame:
    """Turns with ``depth``, the key ``k1, k2`` of the prefix that they end and ``p1, p2`` of the one before."""
    pos = F.col("pos")
    keyed = store(
        turns.select(
            "conv_id", pos.cast("long").alias("pos"), F.floor(pos / SLOT).alias("slot"), "words",
            _hash("a", pos.cast("long"), "c1", "c2").alias("t1"), _hash("b", "c2", "c1", pos.cast("long")).alias("t2"),
        ),
        "trie-hashed",
    )
    totals = keyed.groupBy("conv_id", "slot").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    by_slot = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "conv_id", "slot", F.bit_xor("s1").over(by_slot).alias("b1"), F.bit_xor("s2").over(by_slot).alias("b2")
    ).filter("slot > 0")  # nothing comes before the first slot
    inside = Window.partitionBy("conv_id", "slot").orderBy("pos")
    run = keyed.withColumn("r1", F.bit_xor("t1").over(inside)).withColumn("r2", F.bit_xor("t2").over(inside))
    run = run.join(before, ["conv_id", "slot"], "left")
    k1 = F.col("r1").bitwiseXOR(F.coalesce("b1", F.lit(0)))
    k2 = F.col("r2").bitwiseXOR(F.coalesce("b2", F.lit(0)))
    return run.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), k1.alias("k1"), k2.alias("k2"),
        k1.bitwiseXOR(F.col("t1")).alias("p1"), k2.bitwiseXOR(F.col("t2")).alias("p2"), "words",
    )


def nodes(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per node: its key, depth, members, its parent's key, the words of its last text, and its children."""
    found = prefixes.groupBy("k1", "k2", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(ROOT[0]).cast("long").alias("k1"), F.lit(ROOT[1]).cast("long").alias("k2"), zero.alias("depth"),
        "conv_id", "n_convs", none.alias("p1"), none.alias("p2"), zero.alias("words"),
    )
    found = store(found.unionByName(root), "trie-nodes")
    children = found.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"))
    return found.join(children.agg(F.count(F.lit(1)).alias("n_children")), ["k1", "k2", "depth"], "left").fillna(0, ["n_children"])


def subtree_totals(found: DataFrame, prefixes: DataFrame, height: int) -> DataFrame:
    """``k1, k2, depth, n_leaves, saved_tokens`` of every node's subtree."""
    band = F.floor((F.col("depth") - 1) / height)
    own = found.select(
        "k1", "k2", "depth", "conv_id", band.alias("band"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    # A node is on the path of its smallest member; of that path a band holds ``height`` prefixes at most.
    path = F.array_sort(F.collect_list(F.struct("depth", "k1", "k2", "p1", "p2"))).alias("path")
    paths = prefixes.groupBy("conv_id", band.alias("band")).agg(path)
    above = store(
        own.filter("depth > 0").join(paths, ["conv_id", "band"]).select(
            "k1", "k2", "depth", "band", "leaves", "saved",
            F.struct(F.element_at("path", 1)["p1"].alias("k1"), F.element_at("path", 1)["p2"].alias("k2")).alias("top"),
            F.transform(
                F.filter("path", lambda x: x["depth"] <= F.col("depth")),
                lambda x: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"), x["depth"].alias("depth")),
            ).alias("ancestors"),
        ),
        "trie-paths",
    )
    last = above.agg(F.max("band")).first()[0]
    spark = found.sparkSession
    below = spark.createDataFrame([], "k1 long, k2 long, more_leaves long, more_saved long")
    done: list[DataFrame] = []
    for n in range(-1 if last is None else int(last), -1, -1):
        level = above.filter(F.col("band") == n).join(below, ["k1", "k2"], "left").select(
            "top", "ancestors",
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
        )
        sums = F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
        inside = level.select(F.explode("ancestors").alias("of"), "leaves", "saved").groupBy("of.k1", "of.k2", "of.depth").agg(*sums)
        done.append(store(inside, f"trie-band-{n}"))
        below = store(
            level.groupBy("top.k1", "top.k2").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")),
            f"trie-root-{n}",
        )
    # The root of the first band is the textless one; without any turn it is a leaf itself.
    root = own.filter("depth = 0").join(below, ["k1", "k2"], "left").select(
        "k1", "k2", "depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
    )
    for part in done:
        root = root.unionByName(part)
    return root


def ends(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """``k1, k2, depth, ends_sha256`` of the nodes that are whole conversations.

    Ids are joined by ranges of ids, which bounds each group; the pieces of a node then pass one hash in order.
    """
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("last"))
    zero = F.lit(0).cast("long")
    at = convs.join(last, "conv_id", "left").select(
        "conv_id", F.coalesce("last.k1", F.lit(ROOT[0]).cast("long")).alias("k1"),
        F.coalesce("last.k2", F.lit(ROOT[1]).cast("long")).alias("k2"), F.coalesce("last.depth", zero).alias("depth"),
        F.floor(F.col("conv_id") / SLOT).alias("slot"),
    )
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    pieces = at.groupBy("k1", "k2", "depth", "slot").agg(F.array_join(ids, ",").alias("piece"))

    def run(batches):
        key, digest, rows = None, None, []
        for batch in batches:
            for *k, piece in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "depth", "piece"))):
                if k == key:
                    digest.update(b"," + piece.encode())
                else:
                    if key is not None:
                        rows.append((*key, digest.hexdigest()))
                    key, digest = k, hashlib.sha256(piece.encode())
            if len(rows) >= 4096:
                yield _batch(rows)
                rows = []
        if key is not None:
            rows.append((*key, digest.hexdigest()))
        if rows:
            yield _batch(rows)

    by_node = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "depth", "slot")
    return by_node.mapInArrow(run, "k1 long, k2 long, depth long, ends_sha256 string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    k1, k2, depth, sha = zip(*rows)
    numbers = [pa.array(v, pa.int64()) for v in (k1, k2, depth)]
    return pa.RecordBatch.from_arrays([*numbers, pa.array(sha, pa.string())], names=["k1", "k2", "depth", "ends_sha256"])


def trie(turns: DataFrame, convs: DataFrame, height: int | None = None) -> DataFrame:
    """Nodes of the trie of ``turns`` (``conv_id, pos, c1, c2, words``), with those ``convs`` that may have no turn."""
    prefixes = store(rolled(turns), "trie-prefixes")
    found = store(nodes(prefixes, convs), "trie-counted")
    if height is None:
        height = max(HEIGHT, math.isqrt(found.agg(F.max("depth")).first()[0] or 0))
    totals = subtree_totals(found, prefixes, height)
    up = found.select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id")
    )
    parents = hot_join(found.filter("depth > 0"), up, "p1", "p2", "depth")
    root = found.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    key = ["k1", "k2", "depth"]
    out = parents.unionByName(root).join(totals, key).join(ends(prefixes, convs), key, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def op13(conversations: DataFrame) -> DataFrame:
    return trie(*rebuilt(ordered_turns(conversations)))


#: Sequences of turns as texts; crc32 bit by bit.
OP13_SQL = r"""
with own as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  from conversations where conv_id is not null
), conv as (
  select conv_id, xor(list_reduce(
    list_concat([4294967295::bigint], list_transform(string_split(cast(conv_id as varchar), ''), lambda c: ascii(c)::bigint)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))
  ), 4294967295::bigint) % 4 as h, conv_id - conv_id % 20 as base
  from (select distinct conv_id from own)
), rebuilt as (
  select c.conv_id, o.pos, 0 as side, o.role, o.text from conv c join own o on o.conv_id = c.base and o.pos < c.h
  union all
  select c.conv_id, o.pos, 1, o.role, o.text from conv c join own o on o.conv_id = c.conv_id and o.pos >= c.h
), numbered as (
  select *, row_number() over (partition by conv_id order by side, pos) as depth from rebuilt
), prefix as (
  select conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words,
    sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by depth)) as k,
    count(*) over (partition by conv_id) as n
  from numbered
  union all
  select c.conv_id, 0, 0, '', (select count(*) from numbered x where x.conv_id = c.conv_id) from conv c
), node as (
  select k, depth, min(conv_id) as conv_id, count(*) as n_convs, max(words) as words,
    string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = depth) as ends
  from prefix group by k, depth
), linked as (
  select n.*, p.k as pk, q.conv_id as parent_conv_id from node n
  left join prefix p on p.conv_id = n.conv_id and p.depth = n.depth - 1
  left join node q on q.k = p.k and q.depth = p.depth
), kids as (
  select pk, depth - 1 as depth, count(*) as n_children from linked where depth > 0 group by pk, depth
), counted as (
  select l.*, coalesce(c.n_children, 0) as n_children from linked l left join kids c on c.pk = l.k and c.depth = l.depth
), total as (
  select a.k, a.depth, sum((d.n_children = 0)::bigint) as n_leaves, sum((d.n_convs - 1) * d.words) as saved_tokens
  from counted d join prefix a on a.conv_id = d.conv_id and a.depth <= d.depth
  group by a.k, a.depth
)
select c.conv_id, cast(c.depth as bigint) as depth, c.parent_conv_id, c.n_convs, c.n_children,
  cast(t.n_leaves as bigint) as n_leaves, cast(t.saved_tokens as bigint) as saved_tokens, sha256(coalesce(c.ends, '')) as ends_sha256
from counted c join total t on t.k = c.k and t.depth = c.depth
"""
