"""Low-value item rules: templated pieces, lottery results, club sports, TV advances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .text import _col, let, normalize_for_match


def _any(text: Column, patterns: list[str]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def _holds(text: Column, needles: tuple[str, ...]) -> Column:
    """Whether one of ``needles`` occurs.  Asked before a pattern that cannot match without one: it costs far less."""
    found = text.contains(needles[0])
    for needle in needles[1:]:
        found = found | text.contains(needle)
    return found


#: Parts of words without which LOTTERY_RESULT and LOTTERY_PRIZE match nothing.
LOTTERY_NEEDLES = ("premio", "resultado", "reintegro", "complementari", "reparto", "cifras", "combinacion", "numeros")
#: The same for TV_ADVANCE and TV_TODAY, in normalised text also for their forms on the raw text.
TV_ADVANCE_NEEDLE, TV_TODAY_NEEDLE = "avance de", "de hoy"
#: First letters of the alternatives of CLUB_SPORTS, all of which begin words.
CLUB_SPORTS = "(?=[abcdegilmnprstuw])" + V.CLUB_SPORTS


def is_templated(title) -> Column:
    return _any(normalize_for_match(title), V.TEMPLATED_TITLES)


def is_lottery_low_value(text: Column) -> Column:
    """``text`` is normalised for matching."""
    newsworthy = text.rlike(V.LOTTERY_NEWSWORTHY) | (
        text.rlike(V.LOTTERY_RISING) & text.rlike(V.LOTTERY_AMOUNT)
    )
    small_prize = text.rlike(V.LOTTERY_PRIZE) & ~_any(text, V.LOTTERY_BIG_PRIZE)
    return (
        _holds(text, LOTTERY_NEEDLES)
        & _any(text, V.LOTTERY_TOPICS) & ~newsworthy & (text.rlike(V.LOTTERY_RESULT) | small_prize)
    )


def is_club_sports_low_value(text: Column) -> Column:
    """``text`` is normalised for matching."""
    return (
        text.rlike(CLUB_SPORTS)
        & ~_any(text, V.NATIONAL_TEAM)
        & (text.rlike(V.MATCH_REPORT) | text.rlike(V.INJURY))
    )


def is_tv_advance(title, summary) -> Column:
    raw = F.concat(_col(title), F.lit(" "), F.coalesce(_col(summary), F.lit("")))
    return let(
        F.struct(raw.alias("raw"), normalize_for_match(raw).alias("text")),
        lambda x: _tv_advance(x["raw"], x["text"]),
    )


def _tv_advance(raw: Column, text: Column) -> Column:
    def on_raw(pattern: str) -> Column:
        # The raw text has accents, so \b and \s must not use Java's own classes.
        return raw.rlike(
            "(?i)" + pattern.replace(r"\b", V.WORD_EDGE).replace(r"\s", V.WHITESPACE)
        )

    possible = text.contains(TV_ADVANCE_NEEDLE) & text.contains(TV_TODAY_NEEDLE)
    return possible & ((on_raw(V.TV_ADVANCE_QUOTED) & on_raw(V.TV_TODAY)) | (
        text.rlike(V.TV_ADVANCE) & text.rlike(V.TV_TODAY) & text.rlike(V.TV_DATE)
    ))


def is_low_value(title, summary) -> Column:
    """Any of the rules above; the text is normalised once for all of them."""
    raw = F.concat(_col(title), F.lit(" "), F.coalesce(_col(summary), F.lit("")))
    texts = F.struct(
        raw.alias("raw"),
        normalize_for_match(raw).alias("text"),
        normalize_for_match(title).alias("title"),
    )

    def judge(x: Column) -> Column:
        return (x["text"] != "") & (
            _any(x["title"], V.TEMPLATED_TITLES)
            | is_lottery_low_value(x["text"])
            | is_club_sports_low_value(x["text"])
            | _tv_advance(x["raw"], x["text"])
        )

    return F.coalesce(let(texts, judge), F.lit(False))
