"""Story listing: windows, outlet and side filters, search, ranking and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import spectrum as S
from ..functions.dates import epoch_micros, as_column, hours_between, window_since
from ..functions.stems import stem, words_of
from ..plans.global_rank import global_rank
from ..plans.lineage import stored


def story_window(stories: DataFrame, window: str, as_of) -> DataFrame:
    """Stories active in the window; stories without a date only match ``all``."""
    since = window_since(window, as_of)
    return stories if since is None else stories.filter(F.col("last_pub") >= since)


def plural(stories: DataFrame, min_outlets: int) -> DataFrame:
    return stories.filter(F.col("outlet_count") >= min_outlets)


def search_contains(stories: DataFrame, term: str) -> DataFrame:
    """Case-insensitive substring of title or summary; the term is matched literally."""
    if not term:
        return stories
    needle = F.lower(F.lit(term))
    return stories.filter(
        F.coalesce(F.lower("titulo_canonico").contains(needle), F.lit(False))
        | F.coalesce(F.lower("resumen_canonico").contains(needle), F.lit(False))
    )


def search_fulltext(
    stories: DataFrame,
    all_of: list[str] = (),
    any_of: list[str] = (),
    none_of: list[str] = (),
) -> DataFrame:
    """Match on word stems of title and summary.

    Every ``all_of`` term, at least one ``any_of`` term and no ``none_of`` term must occur.
    A term of several words is a phrase: its stems must follow each other.  Words are
    stemmed once per distinct word.  ``stories`` is computed once and stored; the words that have a wanted stem are
    few, so each story is then judged where it is read: no occurrence is shuffled and nothing joined back.
    """
    terms = list(dict.fromkeys([*all_of, *any_of, *none_of]))
    if not terms:
        return stories
    query = (
        stories.sparkSession.createDataFrame([(t,) for t in terms], "term string")
        .select("term", F.posexplode(words_of("term")).alias("offset", "word"))
        .select("term", "offset", stem(F.col("word")).alias("stem"))
    )
    rows = stored(stories)
    words = words_of(F.concat_ws(" ", "titulo_canonico", "resumen_canonico"))
    # Stored before it is stemmed: the join would push its null check of a stem down to every occurrence.
    vocabulary = stored(rows.select(F.explode(words).alias("word")).distinct()).withColumn("stem", stem(F.col("word")))
    wanted = stored(vocabulary.join(F.broadcast(query), "stem").select("word", "term", "offset"))
    lengths = {r["term"]: r["n"] for r in query.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}

    def forms(term: str, offset: int) -> Column:
        """Words of the stories with the stem of one word of a term."""
        return wanted.filter((F.col("term") == term) & (F.col("offset") == offset)).agg(F.collect_set("word")).scalar()

    def occurs(term: str) -> Column:
        of = [F.col(f"_forms.`{terms.index(term)}_{offset}`") for offset in range(lengths.get(term, 0))]
        if not of:
            return F.lit(False)
        if len(of) == 1:
            return F.arrays_overlap("_words", of[0])

        def follows(i: Column) -> Column:
            held = [F.coalesce(F.array_contains(f, F.get("_words", i + k)), F.lit(False)) for k, f in enumerate(of)]
            return reduce(Column.__and__, held)

        return F.exists(F.transform("_words", lambda _, i: i), follows)

    listed = [forms(t, k).alias(f"{i}_{k}") for i, t in enumerate(terms) for k in range(lengths.get(t, 0))]
    judged = rows.withColumns({"_words": words, "_forms": F.struct(*listed, F.lit(0).alias("none"))})
    wanted_rows = F.lit(True)
    for t in all_of:
        wanted_rows = wanted_rows & occurs(t)
    for t in none_of:
        wanted_rows = wanted_rows & ~occurs(t)
    if any_of:
        wanted_rows = wanted_rows & F.greatest(F.lit(False), *[occurs(t) for t in any_of])
    return judged.filter(wanted_rows).select(*stories.columns)


def stories_of_outlets(articles: DataFrame, outlets: DataFrame, slugs: list[str]) -> DataFrame:
    """Ids of stories with an article of any active listed outlet."""
    return _stories_from(articles, outlets.filter(F.col("active") & F.col("slug").isin(list(slugs))))


def stories_of_outlet(articles: DataFrame, outlets: DataFrame, slug: str) -> DataFrame:
    """Ids of stories with an article of one outlet, active or not."""
    return _stories_from(articles, outlets.filter(F.col("slug") == slug))


def stories_of_side(articles: DataFrame, outlets: DataFrame, side: str) -> DataFrame:
    """Ids of stories covered by an active outlet of one side."""
    return _stories_from(articles, outlets.filter(F.col("active") & (S.side("sesgo") == side)))


def _stories_from(articles: DataFrame, outlets: DataFrame) -> DataFrame:
    return (
        articles.filter("story_id is not null")
        .join(outlets.select("outlet_id"), "outlet_id", "left_semi")
        .select("story_id")
        .distinct()
    )


def intersect_story_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, "story_id", "left_semi")


def page_bounds(number: int, size: int = V.PAGE_SIZE) -> tuple[int, int]:
    return (max(1, number) - 1) * size, size


def page(ordered: DataFrame, number: int, size: int = V.PAGE_SIZE) -> DataFrame:
    """One page of an ordered frame plus ``has_more``; the extra row is only looked at."""
    offset, size = page_bounds(number, size)
    rows = ordered.offset(offset).limit(size + 1)
    everything = Window.partitionBy()  # at most size + 1 rows
    numbered = rows.withColumn("_at", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))
    return (
        numbered.withColumn("has_more", F.count(F.lit(1)).over(everything) > size)
        .filter(F.col("_at") <= size)
        .withColumn("position", F.col("_at") + offset)
        .drop("_at")
    )


def hybrid_score(stories: DataFrame, as_of) -> DataFrame:
    """Recency and importance mixed, for every story; importance is relative to the highest one."""
    highest = stories.agg(F.greatest(F.lit(1), F.max("importance")).alias("_top"))  # one row
    top = F.col("_top")
    age_share = F.greatest(
        F.lit(0.0),
        (epoch_micros(as_column(as_of)) - F.coalesce(epoch_micros("last_pub"), F.lit(0)))
        / F.lit(72 * 3_600_000_000.0),
    )
    recency = F.greatest(F.lit(0.0), 1 - age_share)
    return stories.crossJoin(F.broadcast(highest)).withColumn(
        "score", F.round(F.log1p("importance") / F.log1p(top) * 0.62 + recency * 0.38, 9)
    ).drop("_top")


def _hybrid_order() -> list[Column]:
    return [F.col("score").desc(), F.col("last_pub").desc_nulls_last(), F.col("importance").desc(), F.col("story_id")]


def hybrid_rank(stories: DataFrame, as_of) -> DataFrame:
    """All stories with ``score`` and their ``position`` by it.

    Tasks take ranges of the whole ordering key: of stories older than the window, which differ in importance
    alone, any number may share a score.
    """
    ranked = global_rank(hybrid_score(stories, as_of), _hybrid_order(), "position")
    return ranked.withColumn("position", F.col("position").cast("int"))


def featured(scored: DataFrame, as_of) -> DataFrame:
    """Best scored story with three outlets, two sides and 36 hours of age at most."""
    on_side = sum((F.col(c) > 0).cast("int") for c in ("izq", "centro", "der"))
    fresh = hours_between(as_column(as_of), "last_pub") <= 36
    return (
        scored.filter((F.col("outlet_count") >= 3) & (on_side >= 2) & fresh)
        .orderBy(*_hybrid_order())
        .limit(1)
    )


def list_stories(
    stories: DataFrame,
    articles: DataFrame,
    outlets: DataFrame,
    as_of,
    term: str = "",
    outlet: str = "",
    side: str = "",
    window: str = "all",
    order: str = "ultimas",
    number: int = 1,
    mode: str = "contains",
) -> DataFrame:
    """Filtered, ordered page of stories; filters become semi joins Catalyst can order."""
    rows = story_window(stories, window, as_of)
    if outlet:
        rows = rows.join(stories_of_outlet(articles, outlets, outlet), "story_id", "left_semi")
    if side:
        rows = rows.join(stories_of_side(articles, outlets, side), "story_id", "left_semi")
    if term:
        if mode == "fulltext":
            rows = search_fulltext(rows, all_of=term.split())
        else:
            rows = search_contains(rows, term)
    if order == "relevantes":
        ordered = rows.orderBy(F.col("importance").desc(), "story_id")
    else:
        ordered = hybrid_score(rows, as_of).orderBy(*_hybrid_order())
    return page(ordered, number)
