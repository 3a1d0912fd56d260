"""Trending terms: term and document frequencies, scores and the final pick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import _col, fold_accents, js_trim, let
from .stories import top_by_importance
from ..functions.dates import minus
from ..plans.lineage import cut
from ..streaming.articles import sliding_totals


def trend_words(title) -> Column:
    """Words in order as (norm, surface), without short words and stop words."""
    found = F.regexp_extract_all(_col(title), F.lit(V.TREND_LETTERS), F.lit(0))
    pairs = F.transform(
        found,
        lambda w: F.struct(
            F.regexp_replace(fold_accents(w), "[^a-z0-9]", "").alias("norm"), w.alias("surface")
        ),
    )
    return F.filter(
        pairs,
        lambda p: (F.length(p["norm"]) >= V.TREND_MIN_LENGTH) & ~p["norm"].isin(V.TREND_STOP_WORDS),
    )


def _label(surface: Column) -> Column:
    return F.concat(F.upper(F.substring(surface, 1, 1)), F.lower(F.substring(surface, 2, 2_000_000)))


def _terms(words: Column) -> Column:
    """All unigrams and adjacent bigrams of one title with place and label."""
    unigrams = F.transform(
        words,
        lambda w, i: F.struct(
            w["norm"].alias("term"), _label(w["surface"]).alias("label"), i.alias("place"), F.lit(1).alias("words")
        ),
    )
    different = lambda i: F.get(words, i)["norm"] != F.get(words, i + 1)["norm"]
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 2), different)
    bigrams = F.transform(
        starts,
        lambda i: let(
            F.struct(F.get(words, i).alias("x"), F.get(words, i + 1).alias("y")),
            lambda p: F.struct(
                F.concat_ws(" ", p["x"]["norm"], p["y"]["norm"]).alias("term"),
                F.concat_ws(" ", _label(p["x"]["surface"]), _label(p["y"]["surface"])).alias("label"),
                i.alias("place"),
                F.lit(2).alias("words"),
            ),
        ),
    )
    none = F.array().cast("array<struct<term:string,label:string,place:int,words:int>>")
    return F.concat(unigrams, F.when(F.size(words) >= 2, bigrams).otherwise(none))


def _per_title(titles: DataFrame, id_col: str, title_col: str, group: list[str]) -> DataFrame:
    """One row per (title, term): repeats inside a title meet without hot groups."""
    rows = titles.filter(js_trim(F.col(title_col)) != "").select(
        *group, F.col(id_col).alias("_doc"), let(trend_words(title_col), _terms).alias("_terms")
    )
    exploded = rows.select(*group, "_doc", F.explode("_terms").alias("t"))
    return exploded.groupBy(*group, "_doc", F.col("t.term").alias("term"), F.col("t.words").alias("words")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("t.place", "t.label")).alias("first")
    )


def sliding_tf_df(titles: DataFrame, ts: str, id_col: str = "story_id", title_col: str = "titulo_canonico", hours: int = 48) -> DataFrame:
    """``start, term, words, tf, df`` of every window that begins on an hour, for terms that occur often enough in it."""
    totals = sliding_totals(
        _per_title(titles, id_col, title_col, [ts]), ts, ["term", "words"], {"tf": F.sum("n"), "df": F.count(F.lit(1))}, hours
    )
    return totals.filter((F.col("tf") >= V.TREND_MIN_TITLES) & (F.col("df") >= V.TREND_MIN_TITLES))


def tf_df(titles: DataFrame, id_col: str = "story_id", title_col: str = "titulo_canonico", group: list[str] = ()) -> DataFrame:
    """Term and document frequency of unigrams and bigrams, with the first label seen.

    Counting per (title, term) first makes the document frequency a plain row count; a term
    that occurs everywhere is pre-aggregated by every task before it is shuffled.
    """
    return _per_title(titles, id_col, title_col, group).groupBy(*group, "term", "words").agg(
        F.sum("n").alias("tf"),
        F.count(F.lit(1)).alias("df"),
        F.min(F.struct("_doc", "first.place", "first.label")).alias("first"),
    )


def trending_scores(titles: DataFrame, id_col: str = "story_id", title_col: str = "titulo_canonico") -> DataFrame:
    """Score of every term that occurs often enough and not in too many titles."""
    n = titles.filter(js_trim(F.col(title_col)) != "").agg(F.count(F.lit(1))).scalar()
    idf = F.log(2 + n / (1 + F.col("df")))
    boost = F.when(F.col("words") == 2, F.lit(V.TREND_BIGRAM_BOOST)).otherwise(F.lit(1.0))
    return (
        tf_df(titles, id_col, title_col)
        .filter((F.col("tf") >= V.TREND_MIN_TITLES) & (F.col("df") >= V.TREND_MIN_TITLES))
        .filter(F.col("df") / n <= V.TREND_MAX_DOC_RATIO)
        .select(
            "term",
            "words",
            "tf",
            "df",
            F.col("first.label").alias("label"),
            F.col("first._doc").alias("first_doc"),
            F.col("first.place").alias("first_place"),
            (F.col("tf") * idf * boost).alias("score"),
        )
    )


def trending_pick(scores: DataFrame, max_terms: int = 12) -> DataFrame:
    """Best terms whose words are all unused: up to four bigrams, then unigrams.

    The greedy choice only ever needs a bounded head of the ranking.  Each accepted
    bigram blocks two words; a bigram round keeps the best remaining one and drops those
    sharing a word with it.  At most ``max_terms`` terms block at most twice as many words,
    so the unigrams that can be picked lie in the first ``3 * max_terms`` of their ranking.
    """
    order = [F.col("score").desc(), F.col("first_doc"), F.col("first_place"), F.col("term")]
    scores = cut(scores)
    remaining = scores.filter("words = 2").withColumn("_w", F.split("term", " "))
    picked = None
    for round_ in range(min(V.TREND_MAX_BIGRAMS, max_terms)):
        best = cut(remaining.orderBy(*order).limit(1).withColumn("_round", F.lit(round_)))
        picked = best if picked is None else picked.unionByName(best)
        used = best.select("_w").scalar()
        remaining = remaining.filter(
            ~F.coalesce(F.arrays_overlap(F.col("_w"), F.coalesce(used, F.array().cast("array<string>"))), F.lit(False))
        )
    used_words = picked.select(F.explode("_w").alias("term"))
    unigrams = (
        scores.filter("words = 1")
        .orderBy(*order)
        .limit(3 * max_terms)
        .join(used_words, "term", "left_anti")
        .withColumn("_round", F.lit(V.TREND_MAX_BIGRAMS))
    )
    final = Window.orderBy("_round", *order)
    return (
        picked.drop("_w")
        .unionByName(unigrams)
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= max_terms)
        .select("rank", "term", "label", "words", "score")
    )


def trending_titles(stories: DataFrame, as_of=None, n: int | None = None) -> DataFrame:
    """Input of the trend list: the last 48 hours' plural stories, or all; the ``n`` most important if given."""
    if as_of is not None:
        stories = stories.filter(
            (F.col("last_pub") >= minus(as_of, "48 hours")) & (F.col("outlet_count") >= 2)
        )
    return stories if n is None else top_by_importance(stories, n)
