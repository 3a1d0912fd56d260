"""Text expressions: cleaning, matching and display rules, all ``Column -> Column``.

Everything stays on the JVM side: there is no Python UDF in this module.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: without it every use would repeat its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Characters that decompose to one base character plus marks, and those bases."""
    source, target = [], []
    for code in range(0x80, 0xD800):
        ch = chr(code)
        base = "".join(
            x for x in unicodedata.normalize("NFD", ch) if not unicodedata.category(x).startswith("M")
        )
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


def squash(c) -> Column:
    """Collapse runs of white space to one space and trim."""
    return F.trim(F.regexp_replace(_col(c), V.WHITESPACE + "+", " "))


def js_trim(c) -> Column:
    return F.regexp_replace(_col(c), f"^{V.WHITESPACE}+|{V.WHITESPACE}+$", "")


def fold_accents(c) -> Column:
    """Lower-case and strip combining marks, keeping white space."""
    source, target = _accent_table()
    return F.regexp_replace(F.translate(F.lower(_col(c)), source, target), r"\p{M}+", "")


def normalize_token(c) -> Column:
    return js_trim(fold_accents(c))


def _where(text: Column, needles: tuple[str, ...], change) -> Column:
    """``change`` of texts that hold one of ``needles``.  Looking for them costs a small part of a pass of a pattern."""

    def body(x: Column) -> Column:
        found = x.contains(needles[0])
        for needle in needles[1:]:
            found = found | x.contains(needle)
        return F.when(found, change(x)).otherwise(x)

    return let(text, body)


def normalize_percent(c) -> Column:
    """``3,4 %`` and ``3.4%`` become ``34pct``."""
    pattern = rf"(\d)[,.](\d){V.WHITESPACE}*%"
    return _where(_col(c), ("%",), lambda x: F.regexp_replace(x, pattern, "$1$2pct"))


def _replace_words(text: Column, words: str, target: str, needles: tuple[str, ...]) -> Column:
    pattern = rf"(?<![a-z0-9_])(?:{words})(?![a-z0-9_])"
    return _where(text, needles, lambda x: F.regexp_replace(x, pattern, target))


def collapse_synonyms(c) -> Column:
    """Press variants of one fact share a token (whole words only)."""
    out = _col(c)
    for words, target, needles in (
        ("ipc|inflacion", "inflacion_ipc", ("ipc", "inflacion")),
        ("carburantes|gasolina|gasoleo", "combustibles", ("carburantes", "gasol")),
        ("alza|encarecimientos?", "subida", ("alza", "encarecimiento")),
    ):
        out = _replace_words(out, words, target, needles)
    return out


def normalize_for_match(c) -> Column:
    t = collapse_synonyms(normalize_percent(fold_accents(c)))
    return F.trim(F.regexp_replace(t, r"[^a-z0-9]+", " "))


def _words_of(normalized: Column, min_length: int, drop: list[str]) -> Column:
    """Distinct words of already normalised text, without short and listed words."""
    long_enough = F.filter(F.split(normalized, " "), lambda w: F.length(w) >= min_length)
    return F.array_except(long_enough, F.array(*[F.lit(w) for w in drop]))


def token_set(c) -> Column:
    return tokens_of_normalized(normalize_for_match(c))


def tokens_of_normalized(normalized: Column) -> Column:
    return _words_of(normalized, 3, V.MATCH_STOP_WORDS)


def bigram_set(c) -> Column:
    return bigrams_of_normalized(normalize_for_match(c))


def bigrams_of_normalized(normalized: Column) -> Column:
    """Distinct two-character windows of the text without spaces (linear in its length)."""
    packed = F.regexp_replace(normalized, " ", "")
    return F.array_distinct(F.regexp_extract_all(packed, F.lit("(?=(..))"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two arrays without repeats; 0 when either is empty."""
    return let(
        F.size(F.array_intersect(a, b)),
        lambda shared: F.when(shared > 0, shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0)),
    )


def weighted_similarity(tokens_a, bigrams_a, tokens_b, bigrams_b) -> Column:
    return F.lit(V.TOKEN_WEIGHT) * jaccard(tokens_a, tokens_b) + F.lit(V.BIGRAM_WEIGHT) * jaccard(
        bigrams_a, bigrams_b
    )


def similarity(a, b) -> Column:
    def sets(text) -> Column:
        return let(
            normalize_for_match(text),
            lambda n: F.struct(
                tokens_of_normalized(n).alias("tokens"), bigrams_of_normalized(n).alias("bigrams")
            ),
        )

    return let(
        F.struct(sets(a).alias("a"), sets(b).alias("b")),
        lambda x: weighted_similarity(
            x["a"]["tokens"], x["a"]["bigrams"], x["b"]["tokens"], x["b"]["bigrams"]
        ),
    )


def compare_text(title, summary, chars: int | None = None) -> Column:
    """Title and summary as compared: the whole summary, or its first ``chars`` characters."""
    whole = squash(F.coalesce(_col(summary), F.lit("")))
    return F.concat(_col(title), F.lit("\n"), whole if chars is None else F.substring(whole, 1, chars))


def lexical_score(title_a, summary_a, title_b, summary_b) -> Column:
    return F.greatest(
        similarity(compare_text(title_a, summary_a), compare_text(title_b, summary_b)),
        similarity(title_a, title_b),
    )


def anchor_tokens(title) -> Column:
    return _words_of(normalize_for_match(title), 6, V.MATCH_STOP_WORDS + V.GENERIC_ANCHORS)


def shares_anchor(anchors_a: Column, anchors_b: Column) -> Column:
    common = F.array_intersect(anchors_a, anchors_b)
    return (F.size(common) >= 2) | (
        (F.size(common) == 1) & (F.length(F.coalesce(F.get(common, F.lit(0)), F.lit(""))) >= 8)
    )


def same_pub_day(a, b) -> Column:
    return F.coalesce(F.to_date(_col(a)) == F.to_date(_col(b)), F.lit(False))


def title_entities(title) -> Column:
    """Capitalised words after the first one: likely proper names, accent-folded."""
    text = F.regexp_replace(_col(title), r"(?i)&[a-z#0-9]+;", " ")
    words = F.filter(
        F.split(text, r"""(?:[,.;:!?¡¿"«»“”'‘’()|/-]|""" + V.WHITESPACE + ")+"), lambda w: w != ""
    )
    later = F.filter(
        words, lambda w, i: (i > 0) & (F.length(w) >= 4) & w.rlike(r"^\p{Lu}\p{Ll}")
    )
    return F.array_except(
        F.transform(later, fold_accents), F.array(*[F.lit(w) for w in V.GENERIC_ENTITIES])
    )


# --- cleaning -----------------------------------------------------------------------------


def _decode_once(c: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in V.NAMED_ENTITIES.items() for x in kv])

    def piece(p: Column) -> Column:
        code = F.lower(F.regexp_extract(p, r"(?i)^&(#x[0-9a-f]+|#\d+|[a-z]+);", 1))
        return let(code, lambda x: with_code(p, x))

    def with_code(p: Column, code: Column) -> Column:
        rest = F.substring(p, F.length(code) + 3, F.length(p))
        # Code points have at most six hex or seven decimal digits; longer runs stay as text.
        hex_digits = F.regexp_extract(code, "^#x0*([0-9a-f]{1,6})$", 1)
        dec_digits = F.regexp_extract(code, "^#0*([0-9]{1,7})$", 1)
        number = F.when(hex_digits != "", F.conv(hex_digits, 16, 10).try_cast("int")).when(
            dec_digits != "", dec_digits.try_cast("int")
        )
        decoded = F.coalesce(let(number, character), F.try_element_at(named, code))
        return F.when((code != "") & decoded.isNotNull(), F.concat(decoded, rest)).otherwise(p)

    def character(number: Column) -> Column:
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(
            valid, F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")
        )

    return F.array_join(F.transform(F.split(c, "(?=&)"), piece), "")


def decode_entities(c) -> Column:
    """Decode HTML entities in two passes, so text that was escaped twice is repaired."""
    c = _col(c)
    return F.when(c.rlike("&[#a-zA-Z]"), _decode_once(_decode_once(c))).otherwise(c)


def has_entities(c) -> Column:
    """Rows whose decoded value differs from the stored one."""
    c = _col(c)
    return F.coalesce(c.like("%&%;%") & (decode_entities(c) != c), F.lit(False))


def strip_html(c) -> Column:
    return squash(F.regexp_replace(_col(c), "<[^>]+>", " "))


def snippet(c, limit: int = V.SNIPPET_DISPLAY_CHARS) -> Column:
    """Short excerpt: cut at a late sentence end, else at the last whole word."""
    return let(squash(F.coalesce(_col(c), F.lit(""))), lambda t: _excerpt(t, limit))


def _excerpt(t: Column, limit: int) -> Column:
    cut = F.substring(t, 1, limit)
    backwards = F.reverse(cut)
    sentence_from_end = F.instr(backwards, " .")
    word_from_end = F.instr(backwards, " ")
    sentence = F.when(sentence_from_end > 0, F.length(cut) - sentence_from_end - 1).otherwise(-1)
    word = F.when(word_from_end > 0, F.length(cut) - word_from_end).otherwise(-1)
    at_word = F.when(word > 0, F.substring(cut, F.lit(1), word)).otherwise(cut)
    return (
        F.when(F.length(t) <= limit, t)
        .when(sentence > limit * 0.6, F.substring(cut, F.lit(1), sentence + 1))
        .otherwise(
            F.concat(F.regexp_replace(at_word, rf"(?:[,;:]|{V.WHITESPACE})+$", ""), F.lit("…"))
        )
    )


def item_summary(content_snippet, summary, content) -> Column:
    """The whole cleaned summary of an item; sinks may store a snippet of it."""
    raw = F.coalesce(_col(content_snippet), _col(summary), _col(content), F.lit(""))
    return squash(decode_entities(F.regexp_replace(raw, "<[^>]+>", " ")))


def item_image(enclosure_url, media_url) -> Column:
    return F.coalesce(F.nullif(_col(media_url), F.lit("")), F.nullif(_col(enclosure_url), F.lit("")))


def clean_summary(c) -> Column:
    tail = rf"(?iu){V.WHITESPACE}*{V.READ_MORE_TAIL}{V.WHITESPACE}*$"
    return js_trim(F.regexp_replace(_col(c), tail, ""))


def is_other_language(title) -> Column:
    """Title carries markers of the other press language (see the fixed pattern)."""
    return _col(title).rlike("(?iu)" + V.OTHER_LANGUAGE_MARKERS.replace(r"\b", V.WORD_EDGE))


# --- input helpers ------------------------------------------------------------------------


def sanitize_search(c) -> Column:
    return squash(F.regexp_replace(_col(c), "[%_,()]", " "))


def parse_slugs(c) -> Column:
    """Comma list to distinct valid slugs in first-seen order."""
    parts = F.transform(F.split(F.coalesce(_col(c), F.lit("")), ","), js_trim)
    valid = F.filter(parts, lambda s: s.rlike(V.SLUG_PATTERN))
    return F.array_distinct(valid)


def split_feed_urls(c) -> Column:
    return F.filter(F.transform(F.split(_col(c), r"\r?\n"), js_trim), lambda s: s != "")


def embedding_text(title, summary, prefix: str = "", limit: int | None = None) -> Column:
    """Model input: title and summary on one line, optionally cut and prefixed."""
    text = squash(F.concat(_col(title), F.lit("\n"), F.coalesce(_col(summary), F.lit(""))))
    if limit is not None:
        text = F.substring(text, 1, limit)
    return F.concat(F.lit(prefix), text) if prefix else text


# --- display ------------------------------------------------------------------------------


def truncate(c, limit: int, keep: int | None = None, mark: str = "…") -> Column:
    """Trimmed text, cut to ``keep`` characters plus a mark when longer than ``limit``."""
    t = js_trim(c)
    head = F.substring(t, 1, limit - 1 if keep is None else keep)
    return F.when(F.length(t) > limit, F.concat(head, F.lit(mark))).otherwise(t)


def page_title(c) -> Column:
    return truncate(c, 58, 55)


def brief_title(c) -> Column:
    t = squash(c)
    return F.when(
        F.length(t) > 120, F.concat(F.rtrim(F.substring(t, 1, 119)), F.lit("..."))
    ).otherwise(t)


def share_description(summary, outlet_count, article_count) -> Column:
    fallback = F.concat(
        F.lit("Comparativa de medios: "),
        _col(outlet_count).cast("string"),
        F.lit(" medios, "),
        _col(article_count).cast("string"),
        F.lit(" artículos."),
    )
    return F.coalesce(F.substring(_col(summary), 1, 160), fallback)


@lru_cache(maxsize=1)
def _long_capitals() -> dict[str, str]:
    """Letters whose capital is written with several letters, and the single letter that stands for it."""
    lower = (chr(code) for code in range(0x80, 0xFB18) if not 0xD800 <= code < 0xE000)
    single = {c: c.title() if len(c.title()) == 1 else c for c in lower if len(c.upper()) > 1}
    return single | {"ß": "ẞ"}


def upper_letters(c) -> Column:
    """Upper case letter by letter: a text keeps its length (``ß`` becomes ``ẞ``, not ``SS``)."""
    kept = F.create_map(*[F.lit(x) for pair in _long_capitals().items() for x in pair])
    letters = F.transform(F.split(_col(c), ""), lambda x: F.coalesce(F.try_element_at(kept, x), F.upper(x)))
    return F.array_join(letters, "")


def outlet_initials(c) -> Column:
    words = F.filter(F.split(squash(c), " "), lambda w: w != "")
    two = F.concat(
        F.substring(F.get(words, F.lit(0)), 1, 1), F.substring(F.get(words, F.lit(1)), 1, 1)
    )
    one = F.substring(squash(c), 1, 2)
    letters = upper_letters(F.when(F.size(words) >= 2, two).otherwise(one))
    return F.when(letters == "", F.lit("?")).otherwise(letters)


def share_text(title, suffix: str) -> Column:
    return F.concat(js_trim(title), F.lit(f" · {suffix}"))


def share_caption(title, url, suffix: str) -> Column:
    return F.concat(share_text(title, suffix), F.lit("\n\n"), js_trim(url))


def share_message(title, url, suffix: str) -> Column:
    return F.concat(share_text(title, suffix), F.lit(" "), js_trim(url))


def story_url(base: str, story_id) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/historia/"), _col(story_id).cast("string"))
