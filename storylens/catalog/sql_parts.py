"""Pieces of the DuckDB reference queries: fixture tables and text rules as SQL."""

from __future__ import annotations

from ..functions import fixed_values as V

TABLES = {
    "outlets": """select s_suppkey as outlet_id, s_name as nombre, lower(replace(s_name,'#','-')) as slug,
 case s_nationkey % 7 when 0 then 'izquierda' when 1 then 'centro-izquierda' when 2 then 'centro' when 3 then 'desconocido' when 4 then 'centro' when 5 then 'centro-derecha' else 'derecha' end as sesgo,
 case s_suppkey % 5 when 0 then 'alta' when 1 then 'media-alta' when 2 then 'media' when 3 then 'media-baja' else 'baja' end as factualidad,
 concat('group-', cast(s_suppkey % 8 as string)) as ownership, cast(1 + s_suppkey % 5 as int) as prioridad, s_acctbal >= 0 as active from supplier""",
    "articles": """select concat_ws('/', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string)) as url,
 l_orderkey as story_id, l_suppkey as outlet_id, p_name as titulo, l_shipdate as fecha_pub,
 case when l_linenumber % 3 <> 0 then concat('img/', cast(l_orderkey as string), '-', cast(l_linenumber as string)) end as imagen_url
 from lineitem left join part on l_partkey = p_partkey""",
    "follows": "select distinct user_id, cast(event_id % 10 as bigint) as outlet_id from events where event_type = 'signup'",
    "subscribers": """select c_custkey as subscriber_id, case when c_custkey % 2 = 0 then 'daily' else 'weekly' end as frequency,
 case when c_custkey % 5 <> 0 then timestamp '2024-01-01 00:00:00' end as verified_at,
 case when c_custkey % 3 <> 0 then timestamp '2024-01-29 22:30:00' end as last_digest_sent_at from customer""",
    "text_articles": """select doc_id, cast(doc_id // 4 as bigint) as story_id, doc_id % 20 as outlet_id, split_part(text, chr(10), 1) as titulo, text as resumen,
 timestamp '2024-01-01 00:00:00' + to_minutes(cast(doc_id * 7919 % 10080 as int)) as fecha_pub, source, lang from documents""",
    "vectors": "select vec_id, embedding, label from embeddings",
    "lean": """select outlet_id, case when sesgo in ('izquierda','centro-izquierda') then 'left' when sesgo in ('derecha','centro-derecha') then 'right' else 'center' end as side,
 case sesgo when 'izquierda' then 18 when 'centro-izquierda' then 35 when 'centro' then 52 when 'centro-derecha' then 68 when 'derecha' then 88 else 50 end as position from outlets""",
    "t": "select max(fecha_pub) as t from articles",
    "pairs": "select distinct story_id, outlet_id from articles",
    "spans": "select story_id, count(*) as article_count, min(fecha_pub) as first_pub, max(fecha_pub) as last_pub, min(titulo) as titulo_canonico, max(titulo) as resumen_canonico from articles group by story_id",
    "mix0": """select story_id, count(*) as outlet_count, cast(sum(case when side='left' then 1 else 0 end) as int) as izq, cast(sum(case when side='center' then 1 else 0 end) as int) as centro,
 cast(sum(case when side='right' then 1 else 0 end) as int) as der, cast(count(distinct side) as int) as sides from pairs left join lean using (outlet_id) group by story_id""",
    "mix1": "select *, izq+centro+der as tot, (cast(izq as double)/(izq+centro+der))*100 as rl, (cast(centro as double)/(izq+centro+der))*100 as rc, (cast(der as double)/(izq+centro+der))*100 as rr from mix0",
    "mix2": "select *, floor(rl) as fl, floor(rc) as fc, floor(rr) as fr, rl-floor(rl) as xl, rc-floor(rc) as xc, rr-floor(rr) as xr, 100-floor(rl)-floor(rc)-floor(rr) as rem from mix1",
    "cov": """select story_id, article_count, outlet_count, sides, first_pub, last_pub, izq, centro, der,
 cast(outlet_count*10 + case when outlet_count>=2 then sides*8 else 0 end as int) as importance,
 cast(fl + case when rem > (case when xc>xl then 1 else 0 end)+(case when xr>xl then 1 else 0 end) then 1 else 0 end as int) as izq_pct,
 cast(fc + case when rem > (case when xl>=xc then 1 else 0 end)+(case when xr>xc then 1 else 0 end) then 1 else 0 end as int) as centro_pct,
 cast(fr + case when rem > (case when xl>=xr then 1 else 0 end)+(case when xc>=xr then 1 else 0 end) then 1 else 0 end as int) as der_pct, titulo_canonico, resumen_canonico
 from mix2 join spans using (story_id)""",
    "blind": """select k.*, case when izq_pct<=10 and der_pct>=25 then 'izquierda' else 'derecha' end as missing_side, case when izq_pct<=10 and der_pct>=25 then izq_pct else der_pct end as missing_pct from
 (select cov.* from cov cross join t where last_pub >= t - interval 365 day and outlet_count >= 4) k
 where (izq_pct<=10 and der_pct>=25) or (der_pct<=10 and izq_pct>=25)""",
}
NEEDS = {
    "lean": ["outlets"], "t": ["articles"], "pairs": ["articles"], "spans": ["articles"],
    "mix0": ["pairs", "lean"], "mix1": ["mix0"], "mix2": ["mix1"], "cov": ["mix2", "spans"],
    "blind": ["cov", "t"],
}


def query(body: str, *names: str, **extra: str) -> str:
    """``body`` with the named tables (and what they need) as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} as ({TABLES[n]})" for n in ordered] + [f"{n} as ({s})" for n, s in extra.items()]
    return (f"with {', '.join(parts)} " if parts else "") + body


def _list(words: list[str]) -> str:
    return "[" + ",".join(f"'{w}'" for w in words) + "]"


def norm(x: str) -> str:
    out = f"strip_accents(lower({x}))"
    out = rf"regexp_replace({out}, '(\d),(\d)\s*%', '\1\2pct', 'g')"
    out = rf"regexp_replace({out}, '(\d)\.(\d)\s*%', '\1\2pct', 'g')"
    out = rf"regexp_replace({out}, '\b(ipc|inflacion)\b', 'inflacion_ipc', 'g')"
    out = rf"regexp_replace({out}, '\b(carburantes|gasolina|gasoleo)\b', 'combustibles', 'g')"
    out = rf"regexp_replace({out}, '\b(alza|encarecimiento|encarecimientos)\b', 'subida', 'g')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def words(n: str, size: int, drop: list[str]) -> str:
    return f"list_distinct(list_filter(string_split({n}, ' '), lambda w: length(w) >= {size} and not list_contains({_list(drop)}, w)))"


def tokens(n: str) -> str:
    return words(n, 3, V.MATCH_STOP_WORDS)


def anchors(n: str) -> str:
    return words(n, 6, V.MATCH_STOP_WORDS + V.GENERIC_ANCHORS)


def bigrams(n: str) -> str:
    s = f"replace({n}, ' ', '')"
    return f"list_distinct(list_transform(range(1, greatest(length({s}), 1)), lambda i: substring({s}, i, 2)))"


def jaccard(a: str, b: str) -> str:
    shared = f"len(list_intersect({a},{b}))"
    return f"(case when len({a})>0 and len({b})>0 then cast({shared} as double)/(len({a})+len({b})-{shared}) else 0.0 end)"


def similarity(ta: str, ga: str, tb: str, gb: str) -> str:
    return f"(0.55::double*{jaccard(ta, tb)}+0.45::double*{jaccard(ga, gb)})"


def squash(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{FEFF}}]+', ' ', 'g'))"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def matches(x: str, patterns: str | list[str]) -> str:
    joined = patterns if isinstance(patterns, str) else "|".join(f"(?:{p})" for p in patterns)
    return f"regexp_matches({x}, {quoted(joined)})"


def low_value(title: str, summary: str) -> str:
    """The low-value rule over whole texts; ``title`` and ``summary`` are columns."""
    n = norm(f"{title} || ' ' || {summary}")
    tn = norm(title)
    lottery = (
        f"{matches(n, V.LOTTERY_TOPICS)} and not ({matches(n, V.LOTTERY_NEWSWORTHY)} or ({matches(n, V.LOTTERY_RISING)} and {matches(n, V.LOTTERY_AMOUNT)}))"
        f" and ({matches(n, V.LOTTERY_RESULT)} or ({matches(n, V.LOTTERY_PRIZE)} and not {matches(n, V.LOTTERY_BIG_PRIZE)}))"
    )
    sports = f"{matches(n, V.CLUB_SPORTS)} and not {matches(n, V.NATIONAL_TEAM)} and ({matches(n, V.MATCH_REPORT)} or {matches(n, V.INJURY)})"
    raw = f"({title} || ' ' || {summary})"
    tv = (
        f"(regexp_matches({raw}, {quoted('(?i)' + V.TV_ADVANCE_QUOTED)}) and regexp_matches({raw}, {quoted('(?i)' + V.TV_TODAY)}))"
        f" or ({matches(n, V.TV_ADVANCE)} and {matches(n, V.TV_TODAY)} and {matches(n, V.TV_DATE)})"
    )
    return f"(({matches(tn, V.TEMPLATED_TITLES)}) or ({lottery}) or ({sports}) or ({tv}))"
