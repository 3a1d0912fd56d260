"""Secrets in texts; weak candidates count only beside their complementary parts.

Only DataFrame functions are used.  Strong kinds (``assign``, ``access``, ``hex``) are always reported.  Weak
kinds are identifiers (``ident``), opaque strings (``opaque``) and addresses (``endpoint``).  Parts of one text
are linked when they begin within ``SCOPE`` code points of each other, by a join on (text, slot of ``SCOPE``
code points) and the distance:

* an opaque string is reported beside an identifier (``access`` or ``ident``),
* an identifier is reported beside a secret (``assign``, ``hex`` or ``opaque``),
* an address is reported beside an identifier and beside a secret.

A weak part that overlaps a strong one is dropped.  Links are semi joins: no pairs are made.

What is found depends on the text alone, so equal texts are worked on once, known by their SHA-256; texts
without any part take no part in a join.  Null texts are empty.  Repeated rows and null ids stay rows.
Positions count code points and exclude the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import spread, store

SCOPE = 300

# Patterns, in the order in which kinds are listed.  Matches of a kind do not overlap, leftmost first.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",  # as AKIA[A-Z0-9]+ of 20 or more: a shorter match holds no longer one
    "hex": r"[0-9a-f]{24,}",  # as [0-9a-f]+ of 24 or more
    "ident": r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "opaque": r"[A-Za-z0-9+/_-]{32,}={0,2}",
    "endpoint": r"""(?:https?|ftp|s3|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]+""",
}
KINDS = list(PATTERNS)
STRONG = KINDS[:3]
IDENTIFIERS, SECRETS = ["access", "ident"], ["assign", "hex", "opaque"]
MIN_VALUE = 6

FOUND = "array<struct<kind: int, n: int, gap: bigint, hit: string>>"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hits(text: str, kind: int) -> Column:
    """Matches of a kind and the number of code points between each and the match before it."""
    pattern = _quoted(PATTERNS[KINDS[kind]])
    hits = f"regexp_extract_all({text}, {pattern}, 0)"
    return F.expr(
        f"case when size({hits}) > 0 then transform(zip_with(slice(split({text}, {pattern}, -1), 1, size({hits})), {hits},"
        " (g, h) -> struct(cast(char_length(g) as bigint) as gap, h as hit)),"
        f" (x, i) -> struct({kind} as kind, i as n, x.gap as gap, x.hit as hit))"
        f" else cast(array() as {FOUND}) end"
    )


def _fails(kind: Column, hit: Column) -> Column:
    """Matches of the pattern that are not of the kind."""
    assign = (kind == 0) & (F.length(F.regexp_extract(hit, "^" + ASSIGN, 1)) < MIN_VALUE)
    plain = (kind == KINDS.index("opaque")) & ~(
        hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")
    )
    return assign | plain


def with_parts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``parts`` (raw matches) and ``digest`` (null where there are none) in place of ``text``."""
    text = F.coalesce("text", F.lit(""))
    rest = [c for c in docs.columns if c not in ("text", "parts", "digest")]
    found = spread(docs).select(*rest, text.alias("text")).select(
        *rest, "text", F.concat(*(_hits("text", k) for k in range(len(KINDS)))).alias("parts")
    )
    return found.select(*rest, "parts", F.when(F.size("parts") > 0, F.sha2("text", 256)).alias("digest"))


def spans(parted: DataFrame) -> DataFrame:
    """(digest, kind, start, end) of what is reported, from rows of ``digest`` and ``parts``."""
    one = parted.filter("digest is not null").groupBy("digest").agg(F.first("parts").alias("parts"))
    each = one.select("digest", F.inline("parts"))
    upto = Window.partitionBy("digest", "kind").orderBy("n")
    end = F.sum(F.col("gap") + F.length("hit")).over(upto)
    placed = store(
        each.select("digest", "kind", "hit", end.alias("end"))
        .filter(~_fails(F.col("kind"), F.col("hit")))
        .select("digest", "kind", (F.col("end") - F.length("hit")).alias("start"), "end"),
        "secret-parts",
    )
    strong = placed.filter(F.col("kind") < len(STRONG))
    slots = F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor((F.col("end") - 1) / SCOPE)))
    taken = strong.select("digest", F.col("start").alias("s"), F.col("end").alias("e"), slots.alias("slot"))
    weak = placed.filter(F.col("kind") >= len(STRONG))
    hidden = weak.select("*", slots.alias("slot")).alias("w").join(
        taken.alias("t"),
        (F.col("w.digest") == F.col("t.digest")) & (F.col("w.slot") == F.col("t.slot"))
        & (F.col("w.start") < F.col("t.e")) & (F.col("t.s") < F.col("w.end")),
        "left_semi",
    )
    weak = store(weak.join(hidden.drop("slot").distinct(), ["digest", "kind", "start", "end"], "left_anti"), "secret-weak")
    every = strong.unionByName(weak)

    def beside(some: DataFrame, kinds: list[str]) -> DataFrame:
        """Rows of ``some`` that begin within SCOPE of a part of these kinds."""
        numbers = [KINDS.index(k) for k in kinds]
        slot = F.floor(F.col("start") / SCOPE)
        left = some.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1)))
        right = every.filter(F.col("kind").isin(numbers)).select(
            "digest", slot.alias("slot"), F.col("start").alias("s")
        )
        near = (
            (F.col("l.digest") == F.col("r.digest")) & (F.col("l.slot") == F.col("r.slot"))
            & (F.abs(F.col("l.start") - F.col("r.s")) <= SCOPE)
        )
        return left.alias("l").join(right.alias("r"), near, "left_semi").drop("slot").distinct()

    kind_is = lambda k: F.col("kind") == KINDS.index(k)
    linked = [
        beside(weak.filter(kind_is("opaque")), IDENTIFIERS),
        beside(weak.filter(kind_is("ident")), SECRETS),
        beside(beside(weak.filter(kind_is("endpoint")), IDENTIFIERS), SECRETS),
    ]
    return reduce(DataFrame.unionByName, linked, strong)


def listed(found: DataFrame) -> DataFrame:
    """A row per digest: ``spans``, an array of (start, kind, end) in order."""
    return found.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``spans`` in place of ``text``: an ordered array of (start, kind, end)."""
    rows = store(with_parts(docs.drop("spans")), "secret-rows")
    nothing = F.expr("cast(array() as array<struct<start: bigint, kind: int, end: bigint>>)")
    found = rows.filter("digest is not null").drop("parts").join(listed(spans(rows)), "digest", "left")
    # Texts without parts, nearly all, take no part in the join.
    clean = rows.filter("digest is null").drop("parts", "digest").withColumn("spans", nothing)
    return found.drop("digest").withColumn("spans", F.coalesce("spans", nothing)).unionByName(clean)


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced; ``n_chars`` follows where it is a column.

    Texts without parts pass without a shuffle.
    """
    names = docs.columns
    text = F.coalesce("text", F.lit(""))
    any_part = reduce(lambda a, b: a | b, (text.rlike(p) for p in PATTERNS.values()))
    rows = spread(docs)
    clean = rows.filter(~any_part)
    hit = rows.filter(any_part)
    found = listed(spans(store(with_parts(hit.select("text")), "secret-rows")))
    joined = hit.withColumn("_digest", F.sha2(text, 256)).join(
        found.select(F.col("digest").alias("_digest"), F.col("spans").alias("_spans")), "_digest", "left"
    )
    # Spans in order of their start; one inside an earlier span adds nothing, one that overlaps its end is joined.
    ends = "transform(_spans, (x, i) -> struct(x.start as start, array_max(transform(slice(_spans, 1, i + 1), y -> y.end)) as end))"
    heads = "filter(_ends, (x, i) -> i = 0 or x.start >= _ends[i - 1].end)"
    tails = "filter(_ends, (x, i) -> i = size(_ends) - 1 or _ends[i + 1].start >= x.end)"
    pieces = (
        "concat(transform(_heads, (x, i) -> substring(text, cast(if(i = 0, 0, _tails[i - 1].end) + 1 as int),"
        f" cast(x.start - if(i = 0, 0, _tails[i - 1].end) as int)) || {_quoted(mark)}),"
        " array(substring(text, cast(_tails[size(_tails) - 1].end + 1 as int))))"
    )
    done = (
        joined.withColumn("_ends", F.expr(ends)).withColumn("_heads", F.expr(heads)).withColumn("_tails", F.expr(tails))
        .withColumn("text", F.expr(f"case when size(_heads) > 0 then array_join({pieces}, '') else text end"))
    )
    if "n_chars" in names:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(done.select(*names))


def op3(documents: DataFrame) -> DataFrame:
    found = scan(documents.select("doc_id", "text"))
    names = "array('" + "','".join(KINDS) + "')"
    line = lambda keep: F.expr(
        f"array_join(transform({keep}, x -> concat_ws(':', {names}[x.kind], string(x.start), string(x.end))), ',')"
    )
    count = lambda k: F.expr(f"cast(size(filter(spans, x -> x.kind = {KINDS.index(k)})) as bigint)")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(line(f"filter(spans, x -> x.kind < {len(STRONG)})"), 256).alias("base_sha256"),
        line("spans").alias("spans"),
    )
