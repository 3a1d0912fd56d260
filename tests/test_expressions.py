"""Expressions against hand-derived values."""

import pytest
from pyspark.sql import functions as F

from storylens.functions import dates as D
from storylens.functions import relevance as R
from storylens.functions import spectrum as S
from storylens.functions import text as T
from storylens.functions import vectors as X
from storylens.functions.stems import stem


def text(value):
    return F.lit(value).cast("string")


CASES = {
    "match": (lambda: T.normalize_for_match(text("El IPC sube un 3,4 % en España")), "el inflacion ipc sube un 34pct en espana"),
    "synonym_edge": (lambda: T.normalize_for_match(text("alzas alza gasóleo")), "alzas subida combustibles"),
    "accents": (lambda: T.normalize_token(text(" ÁÉÍÓÚÑÇŠŽ ")), "aeiouncsz"),
    "entities_twice": (lambda: T.decode_entities(text("&amp;quot;Hola&amp;quot;")), '"Hola"'),
    "entities_numeric": (lambda: T.decode_entities(text("&#8230;&#x1F600;&#0;&nope;")), "…😀&#0;&nope;"),
    "templated": (lambda: R.is_templated(text("Efemérides del 5 de mayo")), True),
    "weather": (lambda: R.is_low_value(text("El tiempo en Madrid"), text(None)), True),
    "lottery": (lambda: R.is_low_value(text("Bonoloto: resultado del sorteo"), text("")), True),
    "jackpot": (lambda: R.is_low_value(text("Bonoloto: bote de 3 millones"), text("")), False),
    "club": (lambda: R.is_low_value(text("LaLiga: resultado del partido"), text("")), True),
    "national": (lambda: R.is_low_value(text("LaLiga: resultado del partido Mundial"), text("")), False),
    "tv_quoted": (lambda: R.is_tv_advance(text("Avance de «Serie» de hoy"), text("")), True),
    "tv_dated": (lambda: R.is_tv_advance(text("Avance de Serie de hoy, 5 de mayo"), text("")), True),
    "empty_text": (lambda: R.is_low_value(text(""), text("")), False),
    "anchor_one": (lambda: T.shares_anchor(T.anchor_tokens(text("Guardiola renueva")), T.anchor_tokens(text("Guardiola habla"))), True),
    "anchor_generic": (lambda: T.shares_anchor(T.anchor_tokens(text("Gobierno aprueba")), T.anchor_tokens(text("Gobierno cesa"))), False),
    "slugs": (lambda: T.parse_slugs(text("el-pais,EL MUNDO,el-pais,abc")), ["el-pais", "abc"]),
    "slugs_null": (lambda: T.parse_slugs(text(None)), []),
    "urls": (lambda: T.split_feed_urls(text(" a \r\n\n b")), ["a", "b"]),
    "snippet_short": (lambda: T.snippet(text(" a  b "), 220), "a b"),
    "snippet_sentence": (lambda: T.snippet(text("a" * 150 + ". " + "b " * 60), 220), "a" * 150 + "."),
    "snippet_word": (lambda: T.snippet(text("uno, dos tres"), 6), "uno…"),
    "entities_title": (lambda: T.title_entities(text("Hoy Maricarmen y Sánchez en Cádiz, Óscar")), ["maricarmen", "oscar"]),
    "catalan": (lambda: T.is_other_language(text("L'any amb tot")), True),
    "spanish": (lambda: T.is_other_language(text("El año nuevo")), False),
    "accented_word_edge": (lambda: T.is_other_language(text("però que")), False),
    "tail": (lambda: T.clean_summary(text("Texto. Leer más.")), "Texto."),
    "initials": (lambda: T.outlet_initials(text("El País")), "EP"),
    "initials_one": (lambda: T.outlet_initials(text("abc")), "AB"),
    "initials_blank": (lambda: T.outlet_initials(text("  ")), "?"),
    "page_title": (lambda: T.page_title(text("x" * 60)), "x" * 55 + "…"),
    "sanitize": (lambda: T.sanitize_search(text("a%b_(c),d")), "a b c d"),
    "image": (lambda: T.item_image(text("e"), text("m")), "m"),
    "image_none": (lambda: T.item_image(text(""), text(None)), None),
    "description": (lambda: T.share_description(text(None), F.lit(3), F.lit(5)), "Comparativa de medios: 3 medios, 5 artículos."),
    "vector": (lambda: X.parse_vector(text("[1, 2.5]")), [1.0, 2.5]),
    "vector_bad": (lambda: X.parse_vector(text("nope")), None),
    "cosine_sizes": (lambda: X.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))), 0.0),
    "merge_first": (lambda: X.merge_centroid(F.lit(None).cast("array<double>"), F.lit(0), F.array(F.lit(2.0))), [2.0]),
    "merge": (lambda: X.merge_centroid(F.array(F.lit(1.0)), F.lit(1), F.array(F.lit(3.0))), [2.0]),
    "day": (lambda: D.local_day(F.lit("2024-01-29 23:30:00").cast("timestamp")), "2024-01-30"),
    "weekday": (lambda: D.local_weekday(F.lit("2024-01-29 12:00:00").cast("timestamp")), "Monday"),
    "no_date": (lambda: D.format_local(F.lit(None).cast("timestamp")), "—"),
    "bad_date": (lambda: D.parse_pub_date(text("bad"), text("2024-01-01")), None),
    "badge_67": (lambda: S.brief_badge(F.lit(67)), "SESGO"),
    "badge_68": (lambda: S.brief_badge(F.lit(68)), "ANGULO MUERTO"),
    "missing": (lambda: S.missing_side(F.lit(10), F.lit(25)), "izquierda"),
    "not_missing": (lambda: S.missing_side(F.lit(11), F.lit(25)), None),
    "stem": (lambda: stem(text("rápidamente")), "rapid"),
    "stem_plural": (lambda: stem(text("canciones")), "cancion"),
    "factuality": (lambda: S.better_factuality(text("alta"), text("rara")), True),
}


@pytest.fixture(scope="module")
def values(spark):
    return spark.range(1).select(*[build().alias(name) for name, (build, _) in CASES.items()]).first().asDict(True)


@pytest.mark.parametrize("name", CASES)
def test_value(values, name):
    assert values[name] == CASES[name][1]


@pytest.mark.parametrize(
    "lean,position,side",
    [
        ("centro-izquierda", 35, "left"), ("liberal-derecha", 78, "right"), ("pro-indep", 22, "left"),
        ("desconocido", 50, "center"), ("izquierda radical", 5, "left"), ("extrema derecha", 95, "right"),
        ("centro-derecha", 68, "right"), ("Derecha", 88, "right"), ("centro", 52, "center"),
    ],
)
def test_lean(spark, lean, position, side):
    row = spark.range(1).select(S.lean_position(F.lit(lean)).alias("p"), S.side(F.lit(lean)).alias("s")).first()
    assert tuple(row) == (position, side)


def test_largest_remainder_sums_to_100(spark):
    counts = spark.range(12).selectExpr("cast(id as int) as l").crossJoin(
        spark.range(12).selectExpr("cast(id as int) as c")
    ).crossJoin(spark.range(12).selectExpr("cast(id as int) as r")).filter("l + c + r > 0")
    shares = S.largest_remainder("l", "c", "r")
    rows = counts.select("l", "c", "r", *[shares[k].alias(k) for k in shares]).collect()
    assert all(x.left + x.center + x.right == 100 for x in rows)
    found = {(x.l, x.c, x.r): (x.left, x.center, x.right) for x in rows}
    assert found[1, 1, 1] == (34, 33, 33)
    assert found[1, 0, 1] == (50, 0, 50)
    assert found[2, 1, 0] == (67, 33, 0)


def test_similarity_matches_plain_sets(spark):
    a, b = "Sube la gasolina en Madrid y Sevilla", "La gasolina sube en Sevilla"

    def bigrams(t):
        t = t.replace(" ", "")
        return {t[i : i + 2] for i in range(len(t) - 1)}

    na, nb = "sube la combustibles en madrid y sevilla", "la combustibles sube en sevilla"
    ta, tb = {"sube", "combustibles", "madrid", "sevilla"}, {"sube", "combustibles", "sevilla"}
    j = lambda x, y: len(x & y) / len(x | y)
    expected = 0.55 * j(ta, tb) + 0.45 * j(bigrams(na), bigrams(nb))
    got = spark.range(1).select(T.similarity(F.lit(a), F.lit(b))).first()[0]
    assert got == pytest.approx(expected)
