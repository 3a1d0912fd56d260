"""Word lists, labels and patterns that results depend on.

They are data, not logic.  Everything in this module must keep its exact value
for results to be comparable; nothing here is computed from the input.
"""

from __future__ import annotations

import unicodedata


def fold(word: str) -> str:
    """Lower-case a constant and drop its combining marks (driver-side, constants only)."""
    decomposed = unicodedata.normalize("NFD", word.lower())
    return "".join(ch for ch in decomposed if not unicodedata.category(ch).startswith("M")).strip()


def folded(words: str) -> list[str]:
    return list(dict.fromkeys(fold(w) for w in words.split()))


# --- Fixed values: thresholds and sizes ----------------------------------------------
LEXICAL_THRESHOLD = 0.36
TITLE_PAIR_THRESHOLD = 0.38
ANCHOR_LEXICAL_THRESHOLD = 0.30
ANCHOR_TITLE_THRESHOLD = 0.20
TOKEN_WEIGHT = 0.55
BIGRAM_WEIGHT = 0.45
SUMMARY_COMPARE_CHARS = 420
EMBEDDING_THRESHOLD_LOCAL = 0.88
EMBEDDING_THRESHOLD_REMOTE = 0.82
MAX_ITEMS_PER_FEED = 40
MAX_OPEN_STORIES = 800
LOOKBACK_DAYS = 4
CLUSTER_WINDOW_HOURS = 72
MAX_PER_OUTLET = 2
SNIPPET_DISPLAY_CHARS = 220
SNIPPET_STORE_CHARS = 300
PAGE_SIZE = 20
MERGE_THRESHOLD = 0.87
SMALL_MERGE_THRESHOLD = 0.86
STRONG_MERGE_THRESHOLD = 0.84
SMALL_GROUP_MAX = 4
STRONG_PROTAGONIST = 0.6
MIN_PROTAGONIST = 0.2
CENTROID_SLACK = 0.03
OUTLIER_THRESHOLD = 0.85
OUTLIER_MIN_SIZE = 5
DOMINANT_SHARE = 0.3

# --- Fixed values: white space as the source text rules understand it -----------------
WHITESPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# An ASCII word boundary: Java's own \b treats accented letters as word characters.
WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# --- Fixed values: named HTML entities -------------------------------------------------
NAMED_ENTITIES = {
    "quot": '"',
    "apos": "'",
    "amp": "&",
    "lt": "<",
    "gt": ">",
    "nbsp": " ",
    "laquo": "«",
    "raquo": "»",
    "ldquo": "“",
    "rdquo": "”",
    "lsquo": "‘",
    "rsquo": "’",
    "hellip": "…",
    "ndash": "–",
    "mdash": "—",
    "iexcl": "¡",
    "iquest": "¿",
}

# --- Fixed values: words ignored when titles are compared ------------------------------
MATCH_STOP_WORDS = folded(
    """
    the and los las una uno como para por con sin sobre entre tras hasta desde esta este
    estos estas ese esa eso sus son ser han hay más menos muy todo todos toda todas año
    años día días hoy ayer que del al el la le lo les ya fue fueron sido tiene tienen
    haber según cada vez dos ante noticias informa informó directo última hora
    """
)

# --- Fixed values: roles and places that do not identify a story by themselves ---------
GENERIC_ANCHORS = folded(
    """
    gobierno gobiernos presidente presidenta ministro ministra ministros comunidad
    comunidades nacional nacionales regional regionales municipal municipales español
    española españoles congreso senado parlamento asamblea pleno diputado diputada alcalde
    alcaldesa venezuela colombia argentina ucrania pakistan israel palestina españa espana
    """
)

# --- Fixed values: proper names too common to be a story's protagonist -----------------
GENERIC_ENTITIES = folded(
    """
    españa gobierno congreso senado constitucional supremo tribunal
    audiencia nacional estado estados unidos unión europa europea
    bruselas comisión consejo ministros ministerio interior defensa
    justicia hacienda sanidad vivienda policía guardia civil ejército
    fiscalía moncloa génova psoe sumar podemos junts vox otan
    onu sánchez trump feijóo madrid barcelona cataluña catalunya
    andalucía rusia ucrania china francia italia alemania marruecos
    israel irán venezuela portugal reino unido eeuu gaza última
    hora directo vídeo fotos podcast opinión así qué quién por
    ceuta melilla canarias baleares valencia sevilla málaga zaragoza
    bilbao murcia alicante granada córdoba cádiz galicia asturias
    aragón navarra euskadi país vasco castilla león mancha extremadura
    cantabria rioja palma tenerife vigo coruña oviedo valladolid
    salamanca toledo almería huelva jaén tarragona girona lleida
    nueva york washington londres parís berlín roma moscú pekín
    rabat tánger argelia europeo española español españoles
    """
)

# --- Fixed values: trending rules -------------------------------------------------------
TREND_MIN_LENGTH = 5
TREND_MAX_DOC_RATIO = 0.42
TREND_MIN_TITLES = 2
TREND_MAX_BIGRAMS = 4
TREND_BIGRAM_BOOST = 1.15
TREND_LETTERS = "[a-záéíóúñüA-ZÁÉÍÓÚÑÜ]+"
# Shorter words never reach the stop list (TREND_MIN_LENGTH), so only words of five
# letters or more are listed.
TREND_STOP_WORDS = folded(
    """
    contra desde durante entre hacia hasta mediante segun sobre versus
    cuando donde mientras aunque porque nosotros vosotros ellos ellas
    estos estas aquel aquella aquello mismo misma mismos mismas otros otras
    alguien nadie quien todos todas cualquier varios varias somos
    fueron siendo estar están estaba haber hemos habia tiene tienen hacen
    hicieron puede pueden podria deben quiere quieren habra serán estará
    menos tanto tanta ahora mañana despues antes tambien tampoco apenas muchos muchas
    mucho mucha bastante demasiado cuatro cinco meses horas semana minuto
    minutos segundo noticias noticia ultima ultimo directo directos informa informó informe
    fuentes fuente video fotos galeria actualidad portada titulares titular
    resumen breaking gobierno presidente presidenta ministro ministra estado
    mundo personas persona millones millon nacional internacional politica economia
    sociedad deportes cultura medio medios prensa digital redes social sociales
    informacion seguridad crisis nuevo nueva nuevos nuevas primer primera primeros primeras
    grandes mayor mayores importante importantes general generales
    """
)

# --- Fixed values: low-value item patterns (matched on folded text) ---------------------
LOTTERY_TOPICS = [
    r"\b(bonoloto|primitiva|euromill(ones?|on|ion|ions)|euro\s+mill(ones?|on|ion|ions)|lae|gordo|quiniela|loterias?|apuestas del estado|onlae|cuponazo|el\s+cupon|cupon( de|azo)?)\b",
    r"\b(sorteo|sorteos|once|cupon)\b",
    r"\b(el|la) (gordo|nino) (de|del)\b",
    r"\bloteria (de|del) (nino|navidad)\b",
]
LOTTERY_NEWSWORTHY = r"\b(bote|botes|jackpot|jackpots|en juego|en (el )?bote|acumulad[oa][s]?|repartir[ae]|sin (ningun )?acertante|sin acertantes|boleto premiado|no hay (ningun )?acertante|buscan al|buscando (al|el) ganador|boleto valido en|mayor premio|record|historico|historica|millones? (de|en) (euros?|bote|premi)|bati(endo|o) (el |la )?record|llega? (a|al))\b"
LOTTERY_RISING = r"\b(asciende?|alcanz|bati(endo|do)?|sube|lleg(ando|o) (a|al|el)|llega (a|al|el|los)|roza|sigue subiendo|supera?)\b"
LOTTERY_AMOUNT = r"\b(bote|jackpot|mill(ones?|on))\b"
LOTTERY_RESULT = r"\b(resultado|reintegro|numero complementario|reparto|cifras( ganador| premiad[oa]s?)?|complementari[ao]|combinacion( ganador| premiad[oa]s?)?|(los|las) numeros( del| de la)|numeros premiados)\b"
LOTTERY_PRIZE = r"\b(premio|premios)\b"
LOTTERY_BIG_PRIZE = [
    r"\b(mayor|bote|record|histo(rico|rica)?|acumul|en juego)\b",
    r"\bmillones? de\b",
]
NATIONAL_TEAM = [
    r"\b(mundial|eurocopa)\b",
    r"\bcopa\s+del\s+mundo\b",
    r"\bcampeonato\s+del\s+mundo\b",
    r"\beuro\s+copa\b",
    r"\buefa\s+euro\b",
    r"\bworld\s+cup\b",
    r"\beuro\s+20\d{2}\b",
    r"\bcopa\s+del\s+mundo\s+20\d{2}\b",
]
CLUB_SPORTS = r"\b(champions(\s+league)?|liga(\s+de)?\s+campeones|laliga|la\s+liga|primera(\s+division)?|segunda(\s+division)?|copa(\s+del)?\s+rey|supercopa(\s+de(\s+la)?\s+espana)?|europa\s+league|uefa\s+europa|conference\s+league|euroliga|euroleague|euro\s+cup|eurocup|liga\s+(acb|endesa)|\bacb\b|baloncest\w*|basket( |$|ball)|premier(\s+league)?|bundesliga|eredivisie|ligue\s*1|serie\s*a|mls|santiago\s*bern|bernabeu|wanda|metropolitano|sanchez\s*pizjuan|la\s+cartuja|camp\s*nou|mestalla|ramon\s*sanchez|palau|san\s*mames|anoeta|balaidos|benito\s+villamarin|nuevo\s+los\s+carmenes|ciutat de valencia|butarque|roland\s*garros|wimbledon|australian\s*open|us\s*open|\batp\b|\bwta\b|davis(\s+cup)?|itf|masters( 1000)?|m1000|mutua( madrid)?|cuadro( final| masculino| femenino| principal)?|tenis\w*|pista( central( de( tenis)?)?| de( tenis))|grand\s*slam|gira\s*atp|gira\s*wta)\b"
MATCH_REPORT = r"\b(resultado|retransmi\w*|directo|en\s*vivo|minuto(\s+a(\s+)?minuto)?|partid\w*|jornad\w*|marcador|tanteo|gol( |$|es|s|azo|ead\w*)?|futbol\w*|despid\w*|despedida|elimin\w*|cuartos|semifin\w*|\bsemis\b|final(\s*|\s)four|finalista|paliz\w*|golead\w*|remont\w*|derbi\w*|racha\w*|tanda(\s+de)?( penalt\w*)?|penal\w*|penalti\w*|porter\w*|no\s*tiene\s*remedio|sin\s*remedio\w*|confirma(\s+en|\s+que)|\b(gana|pierde|empat)\w*|\bclasifica\w*|\b(ataque|defen)\w*|imagen\w*|\bfotos?\b|fotogaler(ia\w*)?|galer(ia\w*)?|aplast\w*|\b(top1?0|top-10|top 10|top-5|top-8|top(10|4|2|1))\b|retir\w*|\bsets?\b|saqu\w*|volea\w*|ranking(\s*atp|\s*wta)|asusta|lesion\w*|\b(de|da( de)) baja\b)\b"
INJURY = r"lesion\w*|\b(de|da( de)) baja\b|sin (?:\s*roland\w*|\s+wimbledon\w*|\s+australian( open\w*)?|us open|el open( de( par(í|i)s\w*|\w*)?|par(í|i)\w*)|\bcomplej\w+ (lesion\w*|\w*lesion\w*|\s*proces)|\b(no|sin) (defiend(era?|a|a)|defend(era?|a|a))\w*|\b(no|sin) (jugar|compet(ira?|a|a|e|ir)\w*)\b|inflam\w*|\bproces\w+ (complej\w*|\w* complic\w*|\w*larg(ado|a|a|o)\w*)|(carti(lago|a)|cari(lago|a))(\w*|\b)|tend(ón|on|onitis|initis)\w*|rehabilit\w*|anunc(ia?|a|a|ó)\w* que( no( va| podr(á|a)|\b| defender\w*|\b)| su (baja|retirad\w*)))"
TV_ADVANCE_QUOTED = r"""\bavance de\s+[‘’'"“”«»]"""
TV_ADVANCE = r"\bavance de\b"
TV_TODAY = r"\bde hoy\b"
TV_DATE = r"\b\d{1,2}\s+de\s+(enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)\b"
TEMPLATED_TITLES = [
    r"\befemerides\b",
    r"\bnecrolog\w*",
    r"\besquelas?\b",
    r"\bhoroscop\w*",
    r"\bque paso (el|un dia como hoy)\b",
    r"\bnoticias (de hoy|del dia)\b",
    r"\b(resumen|claves) (de las noticias )?del dia\b",
    r"^(el )?tiempo (en|para|de) ",
    r"\bprevision del tiempo\b",
    r"\bsanto(ral)? de hoy\b",
    r"\bprecio de la luz (de )?(hoy|manana)\b",
]
OTHER_LANGUAGE_MARKERS = r"\b(els|les|amb|però|aquest|aquesta|són|més|pel|dels|als|l'|d'|n'|s')\b|\b(l|d|s|n)['’]\w"
READ_MORE_TAIL = r"(Leer( más)?|Seguir leyendo)\.?"

# --- Fixed values: editorial scale ------------------------------------------------------
SLUG_PATTERN = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
FACTUALITY_RANKS = {"baja": 1.0, "media-baja": 1.5, "media": 2.0, "media-alta": 3.0, "alta": 4.0}
LEFT_BELOW = 38
RIGHT_ABOVE = 62

# --- Fixed values: blindspot, digest and brief rules ------------------------------------
MISSING_MAX_PCT = 10
COVERING_MIN_PCT = 25
BLINDSPOT_MIN_OUTLETS = 4
BRIEF_DOMINANT_MIN = 68
TOP_WEEKLY = 8
TOP_DAILY = 10
BLINDSPOTS_PER_SIDE = 3
CLAIM_LEFT = "Ángulo muerto para quien busca más perspectiva desde la derecha."
CLAIM_RIGHT = "Ángulo muerto para quien busca más perspectiva desde la izquierda."
CLAIM_CENTER = "Ángulo muerto para quien busca lecturas fuera del centro."
BRIEF_INTRO = (
    "Tres lecturas del día: izquierda · centro · derecha.\n"
    "Cada slide: claim de ángulo muerto, imagen, barra de ideología y titular."
)
