"""Coverage, ranking, listing, digest and page queries on the relational profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spectrum as S
from ..functions import text as T
from ..functions.dates import minus
from ..operators import blindspots as B
from ..operators import coverage as C
from ..operators import digest as D
from ..operators import feed as FD
from ..operators import maintenance as M
from ..operators import search as SR
from ..operators import stories as ST
from .registry import register
from .sql_parts import query

YEAR = "365 days"

# --- flagship ------------------------------------------------------------------------------


@register("blindspots", query("select story_id, outlet_count, importance, izq_pct, centro_pct, der_pct, missing_side, missing_pct from blind", "blind"))
def blindspots(n):
    return B.blindspots(n.coverage_of(YEAR), n.as_of, window=YEAR).select(
        "story_id", "outlet_count", "importance", "izq_pct", "centro_pct", "der_pct", "missing_side", "missing_pct"
    )


# --- coverage ------------------------------------------------------------------------------


@register("coverage_mix", query("select story_id, izq, centro, der, izq_pct, centro_pct, der_pct from cov", "cov"))
def coverage_mix(n):
    return C.coverage_mix(n.plain_articles, n.outlets)


@register("story_rollup", query("select story_id, article_count, outlet_count, sides, first_pub, last_pub, importance from cov", "cov"))
def story_rollup(n):
    return C.story_rollup(n.plain_articles, n.outlets)


@register("average_position", query("select story_id, round(avg(position), 6) as average_position from pairs join lean using (outlet_id) group by story_id", "pairs", "lean"))
def average_position(n):
    return C.average_position(n.plain_articles, n.outlets).withColumn("average_position", F.round("average_position", 6))


@register("per_outlet_counts", query("select story_id, outlet_id, count(*) as articles from articles group by story_id, outlet_id", "articles"))
def per_outlet_counts(n):
    return C.per_outlet_counts(n.plain_articles)


@register("outlets_by_side", query("select side, count(*) as outlets from lean join outlets using (outlet_id) where active group by side", "lean"))
def outlets_by_side(n):
    return C.outlets_by_side(n.outlets)


@register("side_imbalance", query("""select case when l>r then 'left' else 'right' end as more, case when l>r then 'right' else 'left' end as fewer, greatest(l,r) as more_outlets, least(l,r) as fewer_outlets
 from (select count(*) filter (where side='left') as l, count(*) filter (where side='right') as r from lean join outlets using (outlet_id) where active) where l <> r""", "lean"))
def side_imbalance(n):
    return C.side_imbalance(n.outlets)


@register("methodology_table", query("select side, nombre, slug, ownership from lean join outlets using (outlet_id) where active", "lean"))
def methodology_table(n):
    return C.methodology_table(n.outlets)


@register("lean_positions", query("select outlet_id, position, side, side = 'center' as is_center, case factualidad when 'alta' then 4.0::double when 'media-alta' then 3.0::double when 'media' then 2.0::double when 'media-baja' then 1.5::double else 1.0::double end as factuality from lean join outlets using (outlet_id)", "lean"))
def lean_positions(n):
    return n.outlets.select(
        "outlet_id", S.lean_position("sesgo").alias("position"), S.side("sesgo").alias("side"),
        S.is_center("sesgo").alias("is_center"), S.factuality_rank("factualidad").alias("factuality"),
    )


@register("stacked_segments", query("""select story_id, case when izq_pct>0 then 0 end as left_start, case when izq_pct>0 then izq_pct end as left_width, case when centro_pct>0 then izq_pct end as center_start, case when centro_pct>0 then centro_pct end as center_width,
 case when der_pct>0 then izq_pct+centro_pct end as right_start, case when der_pct>0 then der_pct end as right_width from cov""", "cov"))
def stacked_segments(n):
    seg = S.stacked_segments("izq_pct", "centro_pct", "der_pct")
    return n.coverage.select("story_id", seg.alias("s")).select(
        "story_id", *[F.col(f"s.{side}.{part}").alias(f"{side}_{part}") for side in ("left", "center", "right") for part in ("start", "width")]
    )


@register("blindspot_claims", query("""select story_id, case when izq_pct = m then 'Ángulo muerto para quien busca más perspectiva desde la derecha.' when der_pct = m then 'Ángulo muerto para quien busca más perspectiva desde la izquierda.' else 'Ángulo muerto para quien busca lecturas fuera del centro.' end as claim
 from (select *, greatest(izq_pct, centro_pct, der_pct) as m from cov)""", "cov"))
def blindspot_claims(n):
    return n.coverage.select("story_id", S.blindspot_claim("izq_pct", "centro_pct", "der_pct").alias("claim"))


@register("absent_outlets", query("select outlet_id, nombre, slug, sesgo from outlets where active and outlet_id not in (select outlet_id from articles where story_id = (select min(story_id) from articles))", "outlets", "articles"))
def absent_outlets(n):
    first = n.plain_articles.agg(F.min("story_id")).scalar()
    return C.absent_outlets(n.plain_articles, n.outlets, first)


@register("coverage_by_day", "select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2")
def coverage_by_day(n):
    from ..sources import fixtures
    from ..streaming.articles import coverage_window

    days = coverage_window(fixtures.event_stream(n.spark, n.folder), "ts", ["event_type"])
    return days.select(F.to_date("window.start").alias("day"), "event_type", "n")


@register("sliding_coverage", """select cast(date_trunc('hour', ts) - to_hours(cast(h as int)) as timestamp) as start, event_type, count(*) as n
 from events, (select unnest(range(48)) as h) group by 1, 2""")
def sliding_coverage(n):
    from ..sources import fixtures
    from ..streaming.articles import sliding_totals

    return sliding_totals(fixtures.event_stream(n.spark, n.folder), "ts", ["event_type"], {"n": F.count(F.lit(1))})


@register("story_sessions", query("""select story_id, cast(s as bigint) as session, count(*) as n, min(fecha_pub) as first_at, max(fecha_pub) as last_at from
 (select *, sum(case when p is null or fecha_pub - p >= interval 72 hour then 1 else 0 end) over (partition by story_id order by fecha_pub rows unbounded preceding) as s from
 (select story_id, fecha_pub, lag(fecha_pub) over (partition by story_id order by fecha_pub) as p from articles)) group by 1, 2""", "articles"))
def story_sessions(n):
    from ..streaming.articles import story_sessions as sessions

    return sessions(n.plain_articles)


# --- per story -----------------------------------------------------------------------------


@register("cover_image", query("""select story_id, imagen_url as cover_url from (select a.story_id, imagen_url, row_number() over (partition by a.story_id order by case when titulo = titulo_canonico then 0 else 1 end,
 case when titulo = titulo_canonico then epoch_us(fecha_pub) else -epoch_us(fecha_pub) end, url) as rn from articles a join spans using (story_id) where imagen_url is not null) where rn = 1""", "spans"))
def cover_image(n):
    return ST.cover_image(n.articles, n.stories)


@register("latest_image", query("select story_id, imagen_url as image_url from (select *, row_number() over (partition by story_id order by fecha_pub desc, url) as rn from articles where imagen_url is not null) where rn = 1", "articles"))
def latest_image(n):
    return ST.latest_image(n.plain_articles)


@register("cover_join", query("select a.story_id, url, imagen_url, fecha_pub from articles a join spans s on a.story_id = s.story_id and a.titulo = s.titulo_canonico where imagen_url is not null", "spans"))
def cover_join(n):
    return ST.cover_join(n.articles, n.stories)


@register("spectrum_order", query("select story_id, url, outlet_id, fecha_pub, position, row_number() over (partition by story_id order by position, fecha_pub asc nulls last, url) as rank from articles join lean using (outlet_id)", "articles", "lean"))
def spectrum_order(n):
    return ST.spectrum_order(n.plain_articles, n.outlets)


@register("outlet_recent", query("select * from (select outlet_id, url, titulo, story_id, fecha_pub, cast(row_number() over (partition by outlet_id order by fecha_pub desc nulls last, url) as int) as rank from articles) where rank <= 12", "articles"))
def outlet_recent(n):
    return ST.outlet_recent(n.articles)


@register("story_detail", query("""select story_id, article_count, outlet_count, importance, izq_pct, centro_pct, der_pct, average_position, image_url from cov
 join (select story_id, round(avg(position), 6) as average_position from pairs join lean using (outlet_id) group by story_id) using (story_id)
 left join (select story_id, imagen_url as image_url from (select *, row_number() over (partition by story_id order by fecha_pub desc, url) as rn from articles where imagen_url is not null) where rn = 1) using (story_id)""", "cov"))
def story_detail(n):
    d = FD.story_detail(n.coverage, n.plain_articles, n.outlets)
    return d.select("story_id", "article_count", "outlet_count", "importance", "izq_pct", "centro_pct", "der_pct", F.round("average_position", 6).alias("average_position"), "image_url")


@register("share_fields", query("""select story_id, titulo_canonico, resumen_canonico, outlet_count, article_count, izq_pct, centro_pct, der_pct, last_pub, image_url,
 case when length(titulo_canonico) > 58 then substring(titulo_canonico, 1, 55) || '…' else titulo_canonico end as page_title, substring(resumen_canonico, 1, 160) as description from cov
 left join (select story_id, imagen_url as image_url from (select *, row_number() over (partition by story_id order by fecha_pub desc, url) as rn from articles where imagen_url is not null) where rn = 1) using (story_id)""", "cov"))
def share_fields(n):
    return FD.share_fields(n.stories, n.coverage, n.plain_articles)


@register("outlet_page", query("""select outlet_id, url, rank, slug, position, side = 'center' as is_center, upper(substring(nombre, 1, 2)) as initials from
 (select outlet_id, url, cast(row_number() over (partition by outlet_id order by fecha_pub desc nulls last, url) as int) as rank from articles) join lean using (outlet_id) join outlets using (outlet_id) where rank <= 12""", "articles", "lean"))
def outlet_page(n):
    return FD.outlet_page(n.outlets, n.articles).select("outlet_id", "url", "rank", "slug", "position", "is_center", "initials")


# --- ranking and lists ---------------------------------------------------------------------


@register("importance_top", query("select story_id, importance, outlet_count from cov order by importance desc, story_id limit 200", "cov"))
def importance_top(n):
    return ST.top_by_importance(n.coverage, 200).select("story_id", "importance", "outlet_count")


HYBRID = """select *, row_number() over (order by score desc, last_pub desc, importance desc, story_id) as position from
 (select c.*, round(ln(1+importance)/ln(1+greatest(1, max(importance) over ()))*0.62 + greatest(0.0, 1 - greatest(0.0, epoch_us(t) - epoch_us(last_pub))/(72*3600000000.0))*0.38, 9) as score
 from cov c cross join t)"""


@register("hybrid_rank", query("select story_id, importance, last_pub, round(score, 6) as score, cast(position as int) as position from hybrid", "cov", "t", hybrid=HYBRID))
def hybrid_rank(n):
    # Ranking stores its rows: it is given the columns that are asked for.
    ranked = SR.hybrid_rank(n.coverage.select("story_id", "importance", "last_pub"), n.as_of)
    return ranked.select("story_id", "importance", "last_pub", F.round("score", 6).alias("score"), "position")


@register("featured_story", query("""select story_id, outlet_count, importance, last_pub from hybrid cross join t where outlet_count >= 3 and (izq>0)::int + (centro>0)::int + (der>0)::int >= 2 and t - last_pub <= interval 36 hour order by position limit 1""", "cov", "t", hybrid=HYBRID))
def featured_story(n):
    return SR.featured(SR.hybrid_score(n.coverage, n.as_of), n.as_of).select("story_id", "outlet_count", "importance", "last_pub")


@register("open_pool", query("select story_id, last_pub from cov cross join t where last_pub >= t - interval 4 day", "cov", "t"))
def open_pool(n):
    return ST.open_pool(n.coverage_of("4 days"), n.as_of).select("story_id", "last_pub")


@register("story_window", query("select story_id, last_pub from cov cross join t where last_pub >= t - interval 30 day", "cov", "t"))
def story_window(n):
    return SR.story_window(n.coverage_of("30 days"), "30d", n.as_of).select("story_id", "last_pub")


@register("plural_stories", query("select story_id, outlet_count from cov where outlet_count >= 3", "cov"))
def plural_stories(n):
    return SR.plural(n.coverage, 3).select("story_id", "outlet_count")


@register("indexable_pages", query("""select '/medios/' || slug as path, cast(null as timestamp) as modified from outlets where active union all
 select '/historia/' || cast(story_id as string), last_pub from cov cross join t where outlet_count >= 2 and last_pub >= t - interval 30 day""", "cov", "t"))
def indexable_pages(n):
    return ST.indexable(n.coverage_of("30 days"), n.outlets, n.as_of)


@register("stories_by_side", query("select distinct story_id from articles join lean using (outlet_id) join outlets using (outlet_id) where active and side = 'left'", "articles", "lean"))
def stories_by_side(n):
    return SR.stories_of_side(n.plain_articles, n.outlets, "left")


@register("stories_by_outlet", query("select distinct story_id from articles join outlets using (outlet_id) where slug = 'supplier-000000001'", "articles", "outlets"))
def stories_by_outlet(n):
    return SR.stories_of_outlet(n.plain_articles, n.outlets, "supplier-000000001")


@register("stories_by_outlets", query("select distinct story_id from articles join outlets using (outlet_id) where active and slug in ('supplier-000000000', 'supplier-000000001', 'supplier-000000003')", "articles", "outlets"))
def stories_by_outlets(n):
    return SR.stories_of_outlets(n.plain_articles, n.outlets, ["supplier-000000000", "supplier-000000001", "supplier-000000003"])


@register("intersect_stories", query("""select distinct story_id from articles join outlets using (outlet_id) where slug = 'supplier-000000001' intersect
 select distinct story_id from articles join lean using (outlet_id) join outlets using (outlet_id) where active and side = 'right'""", "articles", "lean"))
def intersect_stories(n):
    return SR.intersect_story_ids(
        SR.stories_of_outlet(n.plain_articles, n.outlets, "supplier-000000001"),
        SR.stories_of_side(n.plain_articles, n.outlets, "right"),
    )


@register("search_contains", query("select story_id, titulo_canonico from spans where contains(lower(titulo_canonico), 'ring') or contains(lower(resumen_canonico), 'ring')", "spans"))
def search_contains(n):
    return SR.search_contains(n.stories, "ring").select("story_id", "titulo_canonico")


@register("search_fulltext", query(r"select story_id, titulo_canonico from (select *, titulo_canonico || ' ' || resumen_canonico as x from spans) where regexp_matches(x, '\bring\b') and regexp_matches(x, '\b(small|red)\b') and not regexp_matches(x, '\bwidget\b')", "spans"))
def search_fulltext(n):
    texts = n.stories.select("story_id", "titulo_canonico", "resumen_canonico")
    return SR.search_fulltext(texts, all_of=["ring"], any_of=["small", "red"], none_of=["widget"]).select("story_id", "titulo_canonico")


@register("list_stories", query("""select story_id, importance, last_pub, count(*) over () > 20 as has_more from (select cov.story_id, importance, last_pub from cov cross join t
 where last_pub >= t - interval 30 day and (contains(lower(titulo_canonico), 'r') or contains(lower(resumen_canonico), 'r')) and story_id in (select story_id from articles join lean using (outlet_id) join outlets using (outlet_id) where active and side = 'left')
 order by importance desc, story_id limit 21) order by importance desc, story_id limit 20""", "cov", "t"))
def list_stories(n):
    listed = SR.list_stories(n.stories_of("30 days"), n.plain_articles, n.outlets, n.as_of, term="r", side="left", window="30d", order="relevantes")
    return listed.select("story_id", "importance", "last_pub", "has_more")


@register("list_latest", query("""select story_id, importance, cast(position as int) as position from hybrid order by position limit 20 offset 20""", "cov", "t", hybrid=HYBRID))
def list_latest(n):
    return SR.list_stories(n.stories, n.plain_articles, n.outlets, n.as_of, number=2).select("story_id", "importance", "position")


@register("user_feed", query("""select story_id, importance from cov where story_id in (select story_id from articles join outlets using (outlet_id) join follows using (outlet_id)
 where active and user_id = (select min(user_id) from follows)) order by importance desc, story_id limit 20""", "cov", "follows", "outlets"))
def user_feed(n):
    user = n.follows.agg(F.min("user_id")).scalar()
    return FD.user_feed(n.stories, n.plain_articles, n.outlets, n.follows, user, n.as_of).select("story_id", "importance")


@register("followed_outlets", query("select distinct slug from follows join outlets using (outlet_id) where user_id = (select min(user_id) from follows)", "follows", "outlets"))
def followed_outlets(n):
    return FD.followed_outlets(n.follows, n.outlets, n.follows.agg(F.min("user_id")).scalar())


@register("is_following", query("select outlet_id, slug, outlet_id in (select outlet_id from follows where user_id = (select min(user_id) from follows)) as following from outlets", "follows", "outlets"))
def is_following(n):
    return FD.is_following(n.follows, n.outlets, n.follows.agg(F.min("user_id")).scalar())


@register("catalog_stats", query("""select (select count(*) from outlets where active) as outlets, (select count(*) from cov cross join t where last_pub >= t - interval 24 hour and outlet_count >= 2) as stories_today,
 (select count(*) from articles cross join t where fecha_pub >= t - interval 24 hour) as articles_today, (select count(*) from cov) as stories_total""", "cov", "t", "outlets"))
def catalog_stats(n):
    return ST.catalog_stats(n.coverage, n.plain_articles, n.outlets, n.as_of, active=n.coverage_of("24 hours"))


@register("row_counts", query("select (select count(*) from cov) as stories, (select count(*) from articles) as articles", "cov"))
def row_counts(n):
    return ST.row_counts(n.coverage, n.plain_articles)


# --- editions ------------------------------------------------------------------------------

EDITION = "story_id, outlet_count, article_count, importance, izq_pct, centro_pct, der_pct"


@register("daily_edition", query(f"select {EDITION} from cov cross join t where last_pub >= t - interval 1 day and outlet_count >= 2 order by importance desc, story_id limit 10", "cov", "t"))
def daily_edition(n):
    return D.daily_edition(n.coverage_of("1 day"), minus(n.as_of, "1 day"))


@register("weekly_edition", query(f"""select 'top' as section, {EDITION} from top union all select 'sin_' || missing_side, {EDITION} from (select *, row_number() over (partition by missing_side order by importance desc, story_id) as rn from
 blind where story_id not in (select story_id from top)) where rn <= 3""",
 "blind", top="select * from cov cross join t where last_pub >= t - interval 365 day and outlet_count >= 3 order by importance desc, story_id limit 8"))
def weekly_edition(n):
    return D.weekly_edition(n.coverage_of(YEAR), n.as_of, YEAR)


@register("daily_items", query("""select story_id, importance, titulo_canonico, resumen_canonico as resumen, 'https://news.example/historia/' || cast(story_id as string) as link, cover_url from
 (select * from cov cross join t where last_pub >= t - interval 1 day and outlet_count >= 2 order by importance desc, story_id limit 10) e left join
 (select story_id, imagen_url as cover_url from (select a.story_id, imagen_url, row_number() over (partition by a.story_id order by case when titulo = titulo_canonico then 0 else 1 end,
 case when titulo = titulo_canonico then epoch_us(fecha_pub) else -epoch_us(fecha_pub) end, url) as rn from articles a join spans using (story_id) where imagen_url is not null) where rn = 1) using (story_id)""", "cov", "t"))
def daily_items(n):
    edition = D.daily_edition(n.coverage_of("1 day"), minus(n.as_of, "1 day"))
    chosen = n.articles.join(edition.select("story_id"), "story_id", "left_semi")
    items = D.edition_items(edition, n.stories_of("1 day"), ST.cover_image(chosen, n.stories_of("1 day")), "https://news.example")
    return items.select("story_id", "importance", "titulo_canonico", "resumen", "link", "cover_url")


BRIEF = """select 'izquierda' as side, izq_pct as dominant_pct, * from l union all select 'centro', centro_pct, * from c union all select 'derecha', der_pct, * from r"""
BRIEF_PARTS = {
    "pool": "select * from cov where outlet_count >= 2",
    "l": "select * from pool order by izq_pct desc, importance desc, story_id limit 1",
    "c": "select * from pool where story_id not in (select story_id from l) order by centro_pct desc, importance desc, story_id limit 1",
    "r": "select * from pool where story_id not in (select story_id from l union all select story_id from c) order by der_pct desc, importance desc, story_id limit 1",
    "brief": BRIEF,
}


@register("side_brief", query("select side, story_id, dominant_pct, case when dominant_pct >= 68 then 'ANGULO MUERTO' else 'SESGO' end as badge, izq_pct, centro_pct, der_pct from brief", "cov", **BRIEF_PARTS))
def side_brief(n):
    return B.side_brief(n.coverage).select("side", "story_id", "dominant_pct", "badge", "izq_pct", "centro_pct", "der_pct")


@register("brief_caption", query("""select 'Tres lecturas del día: izquierda · centro · derecha.' || chr(10) || 'Cada slide: claim de ángulo muerto, imagen, barra de ideología y titular.' || chr(10) ||
 string_agg(case when dominant_pct >= 68 then 'ANGULO MUERTO' else 'SESGO' end || ' · ' || upper(side) || chr(10) || titulo_canonico || chr(10) || 'https://news.example/historia/' || cast(story_id as string), chr(10)
 order by case side when 'izquierda' then 0 when 'centro' then 1 else 2 end) as caption from brief""", "cov", **BRIEF_PARTS))
def brief_caption(n):
    return B.brief_caption(B.side_brief(n.coverage), n.stories, "https://news.example")


@register("digest_due", query("""select subscriber_id, frequency from subscribers where verified_at is not null and (last_digest_sent_at is null or
 cast(timezone('Europe/Madrid', last_digest_sent_at at time zone 'UTC') as date) <> cast(timezone('Europe/Madrid', timestamp '2024-01-29 12:30:00' at time zone 'UTC') as date)) and (frequency = 'daily' or
 strftime(timezone('Europe/Madrid', timestamp '2024-01-29 12:30:00' at time zone 'UTC'), '%A') = 'Monday')""", "subscribers"))
def digest_due(n):
    return D.digest_due(n.subscribers, F.expr("timestamp '2024-01-29 12:30:00'")).select("subscriber_id", "frequency")


# --- maintenance ---------------------------------------------------------------------------


@register("backfill_dates", query("""select s.story_id, case when ls is null then mn else fs end as first_pub, case when ls is null then mx else ls end as last_pub from
 (select story_id, min(fecha_pub) as mn, max(fecha_pub) as mx, case when story_id % 7 <> 0 then min(fecha_pub) end as fs, case when story_id % 7 <> 0 then max(fecha_pub) end as ls from articles group by story_id) s""", "articles"))
def backfill_dates(n):
    keep = F.col("story_id") % 7 != 0
    undated = n.coverage.select(
        "story_id",
        F.when(keep, F.col("first_pub")).alias("first_pub"),
        F.when(keep, F.col("last_pub")).alias("last_pub"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    return ST.backfill_dates(undated, n.plain_articles).select("story_id", "first_pub", "last_pub")


@register("missing_dates", query("select distinct story_id from articles where story_id % 7 = 0", "articles"))
def missing_dates(n):
    undated = n.coverage.select("story_id", F.when(F.col("story_id") % 7 != 0, F.col("last_pub")).alias("last_pub"))
    return ST.missing_dates(undated, n.plain_articles).select("story_id")


@register("recompute_stories", query("select story_id, article_count, outlet_count, sides, importance from cov cross join t where last_pub >= t - interval 14 day", "cov", "t"))
def recompute_stories(n):
    return M.recompute_stories(n.coverage, n.plain_articles, n.outlets, n.as_of).select("story_id", "article_count", "outlet_count", "sides", "importance")


@register("merge_stories", query("""select story_id, count(*) as article_count, count(distinct outlet_id) as outlet_count, cast(count(distinct outlet_id)*10 + case when count(distinct outlet_id) >= 2 then count(distinct side)*8 else 0 end as int) as importance from
 (select target as story_id, outlet_id from articles join spans using (story_id) join (select titulo_canonico, min(story_id) as target from spans group by 1 having count(*) > 1) using (titulo_canonico)) join lean using (outlet_id) group by story_id""", "spans", "lean"))
def merge_stories(n):
    pairs = M.duplicate_title_pairs(n.stories)
    _, targets = M.merge_stories(n.plain_articles, n.outlets, pairs)
    return targets.select("story_id", "article_count", "outlet_count", "importance")


@register("merge_checks", query("""select case when target = source then 'same_story' when target not in (select story_id from spans) then 'unknown_target' else 'ok' end as outcome, count(*) as n from
 (select story_id as source, case when story_id % 3 = 0 then story_id when story_id % 3 = 1 then -1 else (select min(story_id) from spans where story_id % 3 = 0) end as target from spans) group by 1""", "spans"))
def merge_checks(n):
    root = n.coverage.filter("story_id % 3 = 0").agg(F.min("story_id")).scalar()
    pairs = n.coverage.select(
        F.col("story_id").alias("source"),
        F.when(F.col("story_id") % 3 == 0, F.col("story_id")).when(F.col("story_id") % 3 == 1, F.lit(-1)).otherwise(root).alias("target"),
    )
    valid, rejected = M.check_merge_pairs(pairs, n.coverage)
    outcomes = valid.select(F.lit("ok").alias("outcome")).unionByName(rejected.select(F.col("reason").alias("outcome")))
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@register("pick_winner", query("""select titulo_canonico as cluster, story_id as winner from (select *, row_number() over (partition by titulo_canonico order by importance desc, article_count desc, last_pub desc, story_id) as rn from cov) where rn = 1""", "cov"))
def pick_winner(n):
    from ..operators.similarity import pick_winner as pick

    return pick(n.stories.select("story_id", F.col("titulo_canonico").alias("cluster")), n.coverage)


@register("story_labels", query("""select story_id, titulo_canonico || ' · News' as shared, titulo_canonico || ' · News' || chr(10) || chr(10) || 'https://n.example/historia/' || cast(story_id as string) as caption,
 titulo_canonico || ' · News https://n.example/historia/' || cast(story_id as string) as message, strftime(timezone('Europe/Madrid', last_pub at time zone 'UTC'), '%Y-%m-%d') as local_day from cov""", "cov"))
def story_labels(n):
    from ..functions.dates import local_day

    url = T.story_url("https://n.example", "story_id")
    return n.stories.select(
        "story_id",
        T.share_text("titulo_canonico", "News").alias("shared"),
        T.share_caption("titulo_canonico", url, "News").alias("caption"),
        T.share_message("titulo_canonico", url, "News").alias("message"),
        local_day("last_pub").alias("local_day"),
    )


@register("story_articles", query("""select story_id, url, nombre, rank from (select story_id, url, outlet_id, row_number() over (partition by story_id order by position, fecha_pub asc nulls last, url) as rank from articles join lean using (outlet_id)) join outlets using (outlet_id)""", "articles", "lean"))
def story_articles(n):
    return FD.story_articles(n.plain_articles, n.outlets).select("story_id", "url", "nombre", "rank")


