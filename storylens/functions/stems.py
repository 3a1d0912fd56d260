"""Spanish word stems (the published Snowball rules) as a column expression.

Each step is an anchored regular expression on a column of words, so stemming runs inside
the JVM.  RV, R1 and R2 are start positions; a suffix is only removed where it lies inside
its region.  Stem a vocabulary of distinct words and join it back, not every occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, let

VOWEL = "[aeiouáéíóúü]"
CONSONANT = "[^aeiouáéíóúü]"

# --- Fixed values: suffix lists of the published algorithm ------------------------------
PRONOUNS = "selas|selos|sela|selo|las|les|los|nos|me|se|la|le|lo"
STANDARD = [
    ("r2", "amientos?|imientos?|anzas?|ismos?|ables?|ibles?|istas?|icos?|icas?|osos?|osas?", ""),
    ("r2", "(?:ic)?(?:adora|ador|ación|acion|adoras|adores|aciones|ante|antes|ancia|ancias)", ""),
    ("r2", "logías?", "log"),
    ("r2", "ución|uciones", "u"),
    ("r2", "encias?", "ente"),
    ("r1", "amente", ""),
    ("r2", "(?:ante|able|ible)?mente", ""),
    ("r2", "(?:abil|ic|iv)?idad(?:es)?", ""),
    ("r2", "(?:at)?iv[ao]s?", ""),
]
Y_VERBS = "yendo|yamos|yeron|yais|yan|yen|yas|yes|ya|ye|yo|yó"
VERBS_E = "emos|éis|en|es"
VERBS = (
    "aríamos|eríamos|iríamos|iéramos|iésemos|aríais|aremos|eríais|eremos|iríais|iremos|"
    "ierais|ieseis|asteis|isteis|ábamos|áramos|ásemos|arían|arías|aréis|erían|erías|eréis|"
    "irían|irías|iréis|ieran|iesen|ieron|iendo|ieras|ieses|abais|arais|aseis|íamos|arán|"
    "arás|aría|erán|erás|ería|irán|irás|iría|iera|iese|aste|iste|aban|aran|asen|aron|ando|"
    "abas|adas|idas|aras|ases|íais|ados|idos|amos|imos|ará|aré|erá|eré|irá|iré|aba|ada|ida|"
    "ara|ase|ían|ado|ido|ías|áis|ía|ad|ed|id|an|ió|ar|er|ir|as|ís"
)


def _region(head: Column, word: Column, before=0) -> Column:
    """Start of the region after ``head`` (past the end of the word without one)."""
    return F.when(head > 0, before + head + 1).otherwise(F.length(word) + 1)


def _after_first(word: Column) -> Column:
    """Length of the head that ends after the first vowel-consonant pair."""
    return F.length(F.regexp_extract(word, rf"^.*?{VOWEL}{CONSONANT}", 0))


def _strip(word: Column, start: Column, suffixes: str, replacement: str = "") -> Column:
    """The word without its longest listed suffix in the region, else null."""

    def body(suffix: Column) -> Column:
        inside = (suffix > 0) & (F.length(word) - suffix + 1 >= start)
        kept = F.substring(word, F.lit(1), F.length(word) - suffix)
        return F.when(inside, F.concat(kept, F.lit(replacement)))

    return let(F.length(F.regexp_extract(word, f"(?:{suffixes})$", 0)), body)


def stem(word: Column) -> Column:
    """Stem of one lower-case word."""
    rv_pattern = rf"^(?:.{CONSONANT}.*?{VOWEL}|{VOWEL}{VOWEL}.*?{CONSONANT}|{CONSONANT}{VOWEL}.)"

    def with_word(w: Column) -> Column:
        return let(_after_first(w), lambda h1: with_head(w, h1))

    def with_head(w: Column, h1: Column) -> Column:
        h2 = _after_first(F.substring(w, h1 + 1, F.length(w)))
        regions = F.struct(
            _region(F.length(F.regexp_extract(w, rv_pattern, 0)), w).alias("rv"),
            _region(h1, w).alias("r1"),
            let(h2, lambda h: F.when(h1 > 0, _region(h, w, h1)).otherwise(F.length(w) + 1)).alias("r2"),
        )
        return let(regions, lambda at: with_regions(w, at))

    def with_regions(w: Column, at: Column) -> Column:
        return let(_without_pronoun(w, at["rv"]), lambda s0: with_base(s0, at))

    def with_base(s0: Column, at: Column) -> Column:
        # Step 1: the first standard suffix that applies; step 2: verbs, if none did.
        shorter = F.coalesce(
            *[_strip(s0, at[region], suffixes, to) for region, suffixes, to in STANDARD],
            _strip(s0, at["rv"], rf"(?<=u)(?:{Y_VERBS})"),
            _strip(s0, at["rv"], VERBS),
            F.regexp_replace(_strip(s0, at["rv"], VERBS_E), "gu$", "g"),
            s0,
        )
        return let(shorter, lambda s2: residual(s2, at))

    def residual(s2: Column, at: Column) -> Column:
        # Step 3: residual vowels, then accents.
        left = F.coalesce(
            _strip(s2, at["rv"], "os|a|o|á|í|ó"),
            F.regexp_replace(_strip(s2, at["rv"], "e|é"), "gu$", "g"),
            s2,
        )
        return F.translate(left, "áéíóú", "aeiou")

    return let(word, with_word)


def _without_pronoun(w: Column, rv: Column) -> Column:
    """Step 0: drop a pronoun attached to a gerund or infinitive in RV."""
    forms = "iéndo|ándo|ár|ér|ír|ando|iendo|ar|er|ir"

    def with_form(bare: Column, form: Column) -> Column:
        cut_at = F.length(bare) - F.length(form)
        plain = F.concat(F.substring(bare, F.lit(1), cut_at), F.translate(form, "áéíóú", "aeiou"))
        return F.when((bare != "") & (cut_at + 1 >= rv), plain).otherwise(w)

    bare = F.regexp_extract(w, rf"^(.*(?:{forms}|uyendo))(?:{PRONOUNS})$", 1)
    return let(
        bare,
        lambda b: let(F.regexp_extract(b, f"(?:{forms}|yendo)$", 0), lambda f: with_form(b, f)),
    )


def words_of(text) -> Column:
    """Lower-case words of a text, in order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
