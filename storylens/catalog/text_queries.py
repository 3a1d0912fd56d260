"""Text, similarity, trending, feed and clustering queries on the document profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import relevance as R
from ..functions import text as T
from ..operators import clustering as CL
from ..operators import maintenance as M
from ..operators import similarity as SIM
from ..operators import trending as TR
from ..operators import vector_ops as VO
from ..operators.canonical import canonical_article
from ..operators.embed import embed_articles, hashing_model
from ..sources import feeds, fixtures
from ..sources import outlets as OU
from . import sql_parts as Q
from .registry import register
from .sql_parts import query

TITLE_NORM = Q.norm("titulo")


def joined(c, alias):
    return F.array_join(F.array_sort(c), " ").alias(alias)


@register("normalize_text", query(f"select doc_id, {TITLE_NORM} as norm from text_articles", "text_articles"))
def normalize_text(n):
    return n.texts.select("doc_id", T.normalize_for_match("titulo").alias("norm"))


@register("text_sets", query(f"""select doc_id, array_to_string(list_sort({Q.tokens('norm')}), ' ') as tokens, array_to_string(list_sort({Q.bigrams('norm')}), ' ') as bigrams,
 array_to_string(list_sort({Q.anchors('norm')}), ' ') as anchors from (select doc_id, {TITLE_NORM} as norm from text_articles)""", "text_articles"))
def text_sets(n):
    return n.texts.select("doc_id", joined(T.token_set("titulo"), "tokens"), joined(T.bigram_set("titulo"), "bigrams"), joined(T.anchor_tokens("titulo"), "anchors"))


@register("title_entities", query(r"""select doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(ws[2:], lambda w: length(w) >= 4 and regexp_matches(w, '^\p{Lu}\p{Ll}')), lambda w: strip_accents(lower(w))), lambda k: not list_contains(["""
 + ",".join(f"'{w}'" for w in V.GENERIC_ENTITIES) + r"""], k)))), ' ') as entities from (select doc_id, list_filter(string_split_regex(regexp_replace(titulo, '(?i)&[a-z#0-9]+;', ' ', 'g'), '[\s\x{00A0},.;:!?¡¿"«»“”''‘’()|/-]+'), lambda w: w <> '') as ws from text_articles)""", "text_articles"))
def title_entities(n):
    return n.texts.select("doc_id", joined(T.title_entities("titulo"), "entities"))


CUT = "substring(t, 1, 220)"
SENT = f"(case when instr(reverse({CUT}), ' .') > 0 then length({CUT}) - instr(reverse({CUT}), ' .') - 1 else -1 end)"
WORD = f"(case when instr(reverse({CUT}), ' ') > 0 then length({CUT}) - instr(reverse({CUT}), ' ') else -1 end)"


@register("snippets", query(rf"""select doc_id, case when length(t) <= 220 then t when {SENT} > 132 then substring(t, 1, {SENT} + 1)
 else regexp_replace(case when {WORD} > 0 then substring(t, 1, {WORD}) else {CUT} end, '[,;:\s]+$', '') || '…' end as snippet from (select doc_id, {Q.squash('resumen')} as t from text_articles)""", "text_articles"))
def snippets(n):
    return n.texts.select("doc_id", T.snippet("resumen").alias("snippet"))


@register("strip_html", f"""select page_id, md5({Q.squash("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) as text_hash, length({Q.squash("regexp_replace(html, '<[^>]+>', ' ', 'g')")}) as chars from pages""")
def strip_html(n):
    plain = T.strip_html("html")
    return fixtures.html_pages(n.spark, n.folder).select("page_id", F.md5(plain).alias("text_hash"), F.length(plain).cast("long").alias("chars"))




@register("decode_entities")
def decode_entities(n):
    pages = fixtures.html_pages(n.spark, n.folder)
    decoded = T.decode_entities("html")
    return pages.select("page_id", T.has_entities("html").alias("has_entities"), F.md5(decoded).alias("decoded_hash"))


@register("low_value_articles", query(f"select doc_id, {Q.low_value('titulo', 'resumen')} as low from text_articles", "text_articles"))
def low_value_articles(n):
    return n.texts.select("doc_id", R.is_low_value("titulo", "resumen").alias("low"))


@register("prune_low_value", query("""select cast(sum(low) as bigint) as deleted, count(*) filter (where low > 0) as stories_touched, count(*) filter (where low > 0 and low = n) as stories_removed from
 (select story_id, sum(case when """ + Q.low_value("titulo", "resumen") + """ then 1 else 0 end) as low, count(*) as n from text_articles group by story_id)""", "text_articles"))
def prune_low_value(n):
    return M.prune_counts(n.texts)


@register("other_language", query(f"select doc_id, {Q.matches('titulo', '(?i)' + V.OTHER_LANGUAGE_MARKERS)} as other from text_articles", "text_articles"))
def other_language(n):
    return n.texts.select("doc_id", T.is_other_language("titulo").alias("other"))


@register("display_texts", query(rf"""select doc_id, case when length(t) > 58 then substring(t, 1, 55) || '…' else t end as page_title, case when length(t) > 132 then substring(t, 1, 131) || '…' else t end as card,
 case when length(q) > 120 then rtrim(substring(q, 1, 119)) || '...' else q end as brief, case when len(list_filter(string_split(q, ' '), lambda w: w <> '')) >= 2 then upper(substring(string_split(q, ' ')[1], 1, 1) || substring(string_split(q, ' ')[2], 1, 1))
 when q = '' then '?' else upper(substring(q, 1, 2)) end as initials from (select doc_id, regexp_replace(titulo, '^\s+|\s+$', '', 'g') as t, {Q.squash('titulo')} as q from text_articles)""", "text_articles"))
def display_texts(n):
    return n.texts.select(
        "doc_id", T.page_title("titulo").alias("page_title"), T.truncate("titulo", 132).alias("card"),
        T.brief_title("titulo").alias("brief"), T.outlet_initials("titulo").alias("initials"),
    )


@register("search_inputs", query(rf"""select doc_id, {Q.squash("regexp_replace(titulo, '[%_,()]', ' ', 'g')")} as term,
 'query: ' || {Q.squash("titulo || chr(10) || resumen")} as model_text from text_articles""", "text_articles"))
def search_inputs(n):
    return n.texts.select("doc_id", T.sanitize_search("titulo").alias("term"), T.embedding_text("titulo", "resumen", "query: ").alias("model_text"))


@register("followed_lists", r"""select user_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(string_agg(event_type || '-' || cast(event_id % 7 as string), ', '), ','), lambda s: trim(s)), lambda s: regexp_matches(s, '^[a-z0-9]+(?:-[a-z0-9]+)*$')))), ',') as slugs from events group by user_id""")
def followed_lists(n):
    slug = F.concat_ws("-", "event_type", (F.col("event_id") % 7).cast("string"))
    # Distinct slugs per user are few by construction (kinds of event times seven).
    per_user = fixtures.event_stream(n.spark, n.folder).groupBy("user_id").agg(F.collect_set(slug).alias("s"))
    return per_user.select("user_id", F.array_join(F.array_sort(T.parse_slugs(F.array_join("s", ", "))), ",").alias("slugs"))


# --- feeds ---------------------------------------------------------------------------------

ITEM = "select doc_id as position, source as feed, 'https://' || source || '/' || md5(titulo) as url, titulo as title, resumen as summary from text_articles"


def _items(n):
    return n.texts.select(
        F.col("doc_id").alias("position"), F.col("source").alias("feed"),
        F.concat(F.lit("https://"), "source", F.lit("/"), F.md5("titulo")).alias("url"),
        F.col("titulo").alias("title"), F.col("resumen").alias("summary"),
    )


@register("feed_cap", query("select feed, position, url, rank from (select *, cast(row_number() over (partition by feed order by position) as int) as rank from items) where rank <= 40", "text_articles", items=ITEM))
def feed_cap(n):
    return feeds.cap_items_per_feed(_items(n), 40).select("feed", "position", "url", "rank")


@register("dedupe_urls", query("select url, min(fecha_pub) as fecha_pub, count(*) as copies from articles group by url", "articles"))
def dedupe_urls(n):
    copies = n.plain_articles.groupBy("url").agg(F.count(F.lit(1)).alias("copies"))
    first = feeds.first_seen(n.plain_articles.select("url", "fecha_pub"), ["fecha_pub"])
    return first.join(copies, "url")


@register("drop_known", query("select url, min(position) as position from items where title <> '' and url not in (select url from items where feed = (select min(feed) from items)) group by url", "text_articles", items=ITEM))
def drop_known(n):
    items = _items(n)
    known = items.filter(F.col("feed") == items.agg(F.min("feed")).scalar())
    return feeds.drop_known(items, known, ["position"]).select("url", "position")


@register("ingest_metrics", query(f"""select cast(sum(c) as bigint) as items_usable, cast(sum(case when known then c else c - 1 end) as bigint) as duplicates, count(*) filter (where not known and low) as excluded_low_value, count(*) filter (where not known and not low) as inserted from
 (select c, known, {Q.low_value('title', 'summary')} as low from (select url, count(*) as c, min_by(title, position) as title, min_by(summary, position) as summary, bool_or(feed = (select min(feed) from items)) as known from items where title <> '' group by url))""", "text_articles", items=ITEM))
def ingest_metrics(n):
    items = _items(n)
    known = items.filter(F.col("feed") == items.agg(F.min("feed")).scalar())
    return feeds.ingest_metrics(items, known, ["position"])


def _xml(c):
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " ")


@register("feed_xml", query(rf"""select source as feed, doc_id, regexp_replace(titulo, '^\s+|\s+$', '', 'g') as title, timestamp '2024-01-01 10:00:00' as fecha_pub, 'img/' || cast(doc_id as string) as imagen_url from text_articles where {Q.squash('titulo')} <> ''""", "text_articles"))
def feed_xml(n):
    item = F.concat(
        F.lit("<rss><channel><item><title>"), _xml(F.col("titulo")), F.lit("</title><link>https://x/"), F.col("doc_id").cast("string"),
        F.lit("</link><description>"), _xml(F.col("resumen")), F.lit("</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><enclosure url=\"img/"),
        F.col("doc_id").cast("string"), F.lit("\"/></item></channel></rss>"),
    )
    payloads = n.texts.select(F.col("source").alias("feed"), item.alias("payload"))
    rows = feeds.parse_feed_xml(payloads).filter("title <> ''")
    return rows.select("feed", F.substring_index("url", "/", -1).cast("long").alias("doc_id"), "title", F.col("fecha_pub").cast("timestamp_ntz").alias("fecha_pub"), "imagen_url")


@register("feed_json", query(f"""select source as feed, 'https://x/' || cast(doc_id as string) as url, timestamp '2024-01-01 10:00:00' as fecha_pub from text_articles where {Q.squash("regexp_replace(titulo, '<[^>]+>', ' ', 'g')")} <> ''""", "text_articles"))
def feed_json(n):
    post = F.to_json(F.array(F.struct(
        F.concat(F.lit("https://x/"), F.col("doc_id").cast("string")).alias("link"), F.lit("2024-01-01T10:00:00").alias("date"),
        F.struct(F.col("titulo").alias("rendered")).alias("title"), F.struct(F.col("resumen").alias("rendered")).alias("excerpt"),
    )))
    rows = feeds.parse_feed_json(n.texts.select(F.col("source").alias("feed"), post.alias("payload")))
    return rows.select("feed", "url", F.col("fecha_pub").cast("timestamp_ntz").alias("fecha_pub"))


# --- outlets -------------------------------------------------------------------------------


@register("outlet_list", query("select outlet_id, nombre, slug, sesgo, prioridad from outlets where active", "outlets"))
def outlet_list(n):
    return OU.outlet_list(n.outlets)


@register("expand_feeds", query("select outlet_id, slug, prioridad, cast(i as int) as feed_index, 'https://' || slug || '/' || cast(i as string) as feed_url from outlets, (select unnest([0, 1]) as i) where active", "outlets"))
def expand_feeds(n):
    urls = F.transform(F.array(F.lit("0"), F.lit("1")), lambda i: F.concat(F.lit("https://"), F.col("slug"), F.lit("/"), i))
    text = F.array_join(urls, "\n")
    return OU.expand_feeds(n.outlets.withColumn("rss_urls", T.split_feed_urls(text)))


@register("validate_outlets", query(r"""select outlet_id, array_to_string(list_filter([case when slug is null or not regexp_matches(slug, '^[a-z0-9]+(?:-[a-z0-9]+)*$') then 'slug' end, case when prioridad not between 1 and 5 then 'prioridad' end,
 case when count(*) over (partition by lower(nombre)) > 1 then 'nombre_repetido' end, case when count(*) over (partition by slug) > 1 then 'slug_repetido' end], lambda v: v is not null), ',') as violations from dirty""", "outlets",
 dirty="select outlet_id, case when outlet_id % 10 = 3 then 'Same Name' else nombre end as nombre, case when outlet_id % 10 = 4 then 'Bad Slug' else slug end as slug, case when outlet_id % 10 = 5 then 9 else prioridad end as prioridad from outlets"))
def validate_outlets(n):
    last = F.col("outlet_id") % 10
    dirty = (
        n.outlets.withColumn("nombre", F.when(last == 3, "Same Name").otherwise(F.col("nombre")))
        .withColumn("slug", F.when(last == 4, "Bad Slug").otherwise(F.col("slug")))
        .withColumn("prioridad", F.when(last == 5, 9).otherwise(F.col("prioridad")))
    )
    return OU.validate_outlets(dirty).select("outlet_id", F.array_join("violations", ",").alias("violations"))


INCOMING = "select outlet_id + 5 as outlet_id, 'supplier-' || lpad(cast(outlet_id + 5 as string), 9, '0') as slug, nombre || ' II' as nombre, 'centro' as sesgo, prioridad from outlets"


@register("upsert_outlets", query("""select coalesce(o.outlet_id, i.outlet_id) as outlet_id, coalesce(o.slug, i.slug) as slug, coalesce(o.nombre, i.nombre) as nombre, coalesce(i.sesgo, o.sesgo) as sesgo, coalesce(i.prioridad, o.prioridad) as prioridad
 from outlets o full join incoming i on o.slug = i.slug""", "outlets", incoming=INCOMING))
def upsert_outlets(n):
    current = n.outlets.select("outlet_id", "slug", "nombre", "sesgo", "prioridad")
    shifted = F.col("outlet_id") + 5
    incoming = n.outlets.select(
        shifted.alias("outlet_id"), F.concat(F.lit("supplier-"), F.lpad(shifted.cast("string"), 9, "0")).alias("slug"),
        F.concat("nombre", F.lit(" II")).alias("nombre"), F.lit("centro").alias("sesgo"), "prioridad",
    )
    return OU.upsert_outlets(current, incoming, ["sesgo", "prioridad"])


@register("outlet_patch", query("select outlet_id, slug, case when not active then 'desconocido' else sesgo end as sesgo, active or prioridad >= 4 as active from outlets", "outlets"))
def outlet_patch(n):
    patches = n.outlets.filter("not active").select("slug", F.lit("desconocido").alias("sesgo"), F.when(F.col("prioridad") >= 4, True).alias("active"))
    return OU.feed_outlet_patch(n.outlets.select("outlet_id", "slug", "sesgo", "active"), patches)


@register("upsert_follows", query("""select user_id, outlet_id from follows union select user_id, cast(event_id % 10 as bigint) as outlet_id from events where event_type = 'click' and event_id % 10 in (select outlet_id from outlets where active)""", "follows", "outlets"))
def upsert_follows(n):
    clicks = fixtures.event_stream(n.spark, n.folder).filter("event_type = 'click'").selectExpr("user_id", "cast(event_id % 10 as bigint) as outlet_id")
    return OU.upsert_follows(n.follows, clicks, n.outlets)


@register("remove_follows", query("""select user_id, outlet_id from follows where (user_id, outlet_id) not in (select user_id, cast(event_id % 10 as bigint) from events where event_type = 'error')""", "follows"))
def remove_follows(n):
    errors = fixtures.event_stream(n.spark, n.folder).filter("event_type = 'error'").selectExpr("user_id", "cast(event_id % 10 as bigint) as outlet_id")
    return OU.remove_follows(n.follows, errors)


# --- similarity ----------------------------------------------------------------------------

SETS = f"select id, {Q.tokens('norm')} as tk, {Q.bigrams('norm')} as gb from (select norm, min(doc_id) as id from (select doc_id, {TITLE_NORM} as norm from text_articles) group by norm)"


@register("lexical_pairs", query(f"select a, b, round(score, 6) as score from (select x.id as a, y.id as b, {Q.similarity('x.tk', 'x.gb', 'y.tk', 'y.gb')} as score from sets x join sets y on x.id < y.id) where score >= 0.38", "text_articles", sets=SETS))
def lexical_pairs(n):
    return SIM.lexical_pairs(n.texts, "doc_id", "titulo").select("a", "b", F.round("score", 6).alias("score"))


def _text_stories(n):
    return n.texts.select(
        F.col("doc_id").alias("story_id"), F.col("titulo").alias("titulo_canonico"), F.col("resumen").alias("resumen_canonico"),
        F.col("fecha_pub").alias("last_pub"), F.lit(10).alias("importance"), F.lit(1).alias("article_count"),
    )


@register("duplicate_clusters")
def duplicate_clusters(n):
    return SIM.duplicate_story_clusters(_text_stories(n))


@register("dedupe_plan")
def dedupe_plan(n):
    return SIM.dedupe_plan(_text_stories(n))


# --- trending ------------------------------------------------------------------------------

WORDS = f"""select doc_id, list_filter(list_transform(regexp_extract_all(titulo, '{V.TREND_LETTERS}'), lambda w: regexp_replace(strip_accents(lower(w)), '[^a-z0-9]', '', 'g')), lambda w: length(w) >= 5 and not list_contains({Q._list(V.TREND_STOP_WORDS)}, w)) as ws
 from text_articles where trim(titulo) <> ''"""
TERMS = """select doc_id, unnest(ws) as term, 1 as words from w union all
 select doc_id, ws[i] || ' ' || ws[i+1] as term, 2 as words from (select doc_id, ws, unnest(range(1, len(ws))) as i from w) where ws[i] <> ws[i+1]"""


@register("trending_scores", query("""select term, words, tf, df, round(tf * ln(2 + n / (1.0::double + df)) * case when words = 2 then 1.15 else 1.0 end, 6) as score from
 (select term, words, count(*) as tf, count(distinct doc_id) as df from terms group by term, words), (select count(*)::double as n from w) where tf >= 2 and df >= 2 and df / n <= 0.42""", "text_articles", w=WORDS, terms=TERMS))
def trending_scores(n):
    return TR.trending_scores(n.texts, "doc_id", "titulo").select("term", "words", "tf", "df", F.round("score", 6).alias("score"))


@register("sliding_trending", query("""select cast(date_trunc('hour', fecha_pub) - to_hours(cast(h as int)) as timestamp) as start, term, words, cast(sum(k) as bigint) as tf, count(*) as df from
 (select doc_id, term, words, count(*) as k from terms group by 1, 2, 3) join text_articles using (doc_id), (select unnest(range(48)) as h) group by 1, 2, 3 having sum(k) >= 2 and count(*) >= 2""", "text_articles", w=WORDS, terms=TERMS))
def sliding_trending(n):
    return TR.sliding_tf_df(n.texts, "fecha_pub", "doc_id", "titulo")


@register("dedupe_applied")
def dedupe_applied(n):
    """The plan of a deduplication carried out: articles of merged stories move, their targets are recomputed."""
    articles = n.texts.withColumn("story_id", F.col("doc_id"))
    _, targets = M.merge_stories(articles, n.outlets, SIM.dedupe_plan(_text_stories(n)))
    return targets.select("story_id", "article_count", "outlet_count", "importance")


@register("trending_pick")
def trending_pick(n):
    return TR.trending_pick(TR.trending_scores(n.texts, "doc_id", "titulo"))


# --- vectors -------------------------------------------------------------------------------


@register("centroid_by_label", "select label, count(*) as n, cast(i - 1 as int) as at, round(avg(embedding[i]::double), 6) as value from embeddings, (select unnest(range(1, 65)) as i) group by label, i")
def centroid_by_label(n):
    c = VO.centroid(n.vectors, "label")
    return c.select("label", "n", F.posexplode("centroid").alias("at", "value")).withColumn("value", F.round("value", 6))


UNIT = "select vec_id, label, list_transform(embedding, lambda x: x::double / n) as u from (select vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings)"
SUMS = "select label, count(distinct vec_id) as n, list(s order by i) as su from (select label, i, sum(u[i]) as s from unit, (select unnest(range(1, 65)) as i) group by label, i) join (select vec_id, label from unit) using (label) group by label"


@register("cosine_topk", query("""select vec_id, label, cast(rank as int) as rank, cosine from (select vec_id, label, cosine, row_number() over (partition by label order by cosine desc, vec_id) as rank from
 (select vec_id, label, round(list_cosine_similarity(embedding::double[], c), 6) as cosine from embeddings join (select label, list(m order by i) as c from (select label, i, avg(embedding[i]::double) as m from embeddings, (select unnest(range(1, 65)) as i) group by label, i) group by label) using (label))) where rank <= 3"""))
def cosine_topk(n):
    return VO.central_articles(n.vectors, "label", "vec_id", 3).select("vec_id", "label", "rank", "cosine")


@register("average_linkage", query("""select a.label as a, b.label as b, round(avg(list_dot_product(a.u, b.u)), 6) as linkage from unit a join unit b on a.label < b.label group by 1, 2""", unit=UNIT))
def average_linkage(n):
    # One protagonist for all: every two labels are a pair.
    groups = n.vectors.select(F.lit("Caso Protagonista").alias("titulo"), "label")
    pairs = VO.protagonist_strength(VO.entity_counts(groups, "label"), "label")
    linked = VO.average_linkage(n.vectors, "label", pairs.select("a", "b"))
    return linked.select("a", "b", F.round("linkage", 6).alias("linkage"))


@register("outlier_score", query("""select a.vec_id, a.label, round(sum(list_dot_product(a.u, b.u)) / count(*), 6) as score from unit a join unit b on a.label = b.label and a.vec_id <> b.vec_id group by 1, 2""", unit=UNIT))
def outlier_score(n):
    return VO.outlier_score(n.vectors, "label", "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@register("protagonist_strength", query("""select x.g as a, y.g as b, round(max(least(x.share, y.share)), 6) as strength from shares x join shares y on x.e = y.e and x.g < y.g group by 1, 2""",
 shares="select * from (select label as g, 'protagonista' || cast((vec_id % 5) // 2 as string) as e, count(*)::double / any_value(size) as share from embeddings join (select label, count(*) as size from embeddings group by label) using (label) group by 1, 2) where share >= 0.2"))
def protagonist_strength(n):
    titled = n.vectors.select(F.concat(F.lit("Caso Protagonista"), F.floor(F.col("vec_id") % 5 / 2).cast("string")).alias("titulo"), "label")
    return VO.protagonist_strength(VO.entity_counts(titled, "label"), "label").withColumn("strength", F.round("strength", 6))


@register("parse_vectors", "select vec_id, len(embedding) as size, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) as total from embeddings")
def parse_vectors(n):
    from ..functions.vectors import parse_vector

    parsed = n.vectors.select("vec_id", parse_vector(F.to_json(F.transform("embedding", lambda x: x.cast("double")))).alias("v"))
    return parsed.select("vec_id", F.size("v").cast("long").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


# --- order-dependent jobs ------------------------------------------------------------------


def _articles(n):
    return n.texts.select(F.col("doc_id").alias("article_id"), "outlet_id", "titulo", "resumen", "fecha_pub", "story_id")


@register("assign_stories")
def assign_stories(n):
    return CL.assign_stories(_articles(n)).withColumn("score", F.round("score", 6))


@register("assign_by_vector")
def assign_by_vector(n):
    items = fixtures.vector_articles(n.spark, n.folder).withColumn("resumen", F.lit("")).withColumn(
        "titulo", F.concat("titulo", F.lit(" "), F.sha1(F.col("article_id").cast("string")))
    )
    return CL.assign_stories(items, mode="local", embedding_threshold=0.6).withColumn("score", F.round("score", 6))


@register("regroup")
def regroup(n):
    return CL.regroup(fixtures.vector_articles(n.spark, n.folder), 0.6, 0.5, 0.5, 0.45, 0.5)


@register("regroup_summary")
def regroup_summary(n):
    items = fixtures.vector_articles(n.spark, n.folder)
    groups = CL.cut(CL.regroup(items, 0.6, 0.5, 0.5, 0.45, 0.5))
    current = items.select(F.col("article_id").cast("string").alias("article_id"), "story_id", "outlet_id")
    return CL.regroup_summary(CL.regroup_targets(groups, current), current)


@register("canonical_article")
def canonical(n):
    return canonical_article(_articles(n), n.outlets.withColumn("outlet_id", F.col("outlet_id")))


@register("embed_articles")
def embed(n):
    return embed_articles(_articles(n), hashing_model).select("article_id", "embedding")
