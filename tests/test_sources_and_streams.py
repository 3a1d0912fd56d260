"""Landed feeds, upserts, sinks and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from storylens.operators.clustering import assign_stories
from storylens.sources import feeds, outlets, sinks
from storylens.streaming import articles as ST

T0 = dt.datetime(2024, 1, 1)
ITEMS = "url string, title string, summary string, fecha_pub timestamp"


def test_read_feed_xml_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<rss><channel><item><title>Uno &amp;amp;quot;dos&amp;amp;quot;</title><link> https://x/1 </link>"
        "<description>Texto &lt;b&gt;largo&lt;/b&gt;</description><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate>"
        "<enclosure url='e.jpg'/></item><item><title>Dos</title><link>https://x/2</link>"
        "<pubDate>nunca</pubDate></item></channel></rss>",
        encoding="utf8",
    )
    rows = {r.url: r for r in feeds.read_feed_xml(spark, str(tmp_path)).collect()}
    assert rows["https://x/1"].title == 'Uno "dos"'
    assert rows["https://x/1"].summary == "Texto largo"
    assert rows["https://x/1"].fecha_pub == dt.datetime(2024, 1, 1, 10)
    assert rows["https://x/1"].imagen_url == "e.jpg"
    assert rows["https://x/2"].fecha_pub is None and rows["https://x/2"].summary == ""


def test_parse_feed_xml_reads_rss_rdf_and_atom(spark):
    payloads = [
        ("rss", "<rss><channel><link>https://c</link><item><title><![CDATA[a <item b]]></title><link>https://x/1</link>"
                "<dc:date xmlns:dc='d'>2024-01-01T10:00:00Z</dc:date></item></channel></rss>"),
        ("rdf", "<rdf:RDF xmlns:rdf='r'><channel><title>c</title></channel><item><title>r</title><link>https://x/2</link></item></rdf:RDF>"),
        ("atom", "<feed xmlns='http://www.w3.org/2005/Atom'><link href='https://f'/>"
                 "<entry><title type='html'>A &amp;amp; B</title><link rel='self' href='https://x/s'/>"
                 "<link rel='alternate' href='https://x/3'/><summary type='html'>s</summary>"
                 "<published>2024-01-02T10:00:00Z</published><updated>2024-01-03T10:00:00Z</updated></entry>"
                 "<entry><title>only</title><link href='https://x/4'/><updated>2024-01-03T10:00:00Z</updated></entry></feed>"),
        ("cut", "<rss><channel><item><title>x</title>"), ("none", None), ("empty", ""),
    ]
    rows = feeds.parse_feed_xml(spark.createDataFrame(payloads, "feed string, payload string")).collect()
    assert [(r.feed, r.position, r.url, r.title, r.summary, r.fecha_pub and r.fecha_pub.day) for r in rows] == [
        ("rss", 0, "https://x/1", "a <item b", "", 1),
        ("rdf", 0, "https://x/2", "r", "", None),
        ("atom", 0, "https://x/3", "A & B", "s", 2),
        ("atom", 1, "https://x/4", "only", "", 3),
    ]


def test_read_feed_json_files(spark, tmp_path):
    posts = [
        {"link": "https://x/1", "date": "2024-01-01T10:00:00", "title": {"rendered": "<i>Uno</i>"}, "excerpt": {"rendered": "<p>r</p>"}},
        {"link": "", "date": "x", "title": {"rendered": "sin enlace"}, "excerpt": {"rendered": ""}},
        {"link": "https://x/3", "date": "mal", "title": {"rendered": "Tres"}, "excerpt": {"rendered": ""}},
        {"link": "https://x/4", "date": None, "title": {"rendered": "<b></b>"}, "excerpt": {"rendered": ""}},
    ]
    (tmp_path / "p.json").write_text(json.dumps(posts), encoding="utf8")
    rows = {r.url: r for r in feeds.read_feed_json(spark, str(tmp_path)).collect()}
    assert set(rows) == {"https://x/1", "https://x/3"}
    assert rows["https://x/1"].title == "Uno" and rows["https://x/1"].summary == "r"
    assert rows["https://x/3"].fecha_pub is None


def test_read_outlets_applies_defaults(spark, tmp_path):
    (tmp_path / "o.json").write_text('{"outlet_id":"1","nombre":"A","slug":"A-B","rss_urls":["https://a/f"]}\n')
    row = outlets.read_outlets(spark, str(tmp_path)).first()
    assert (row.slug, row.sesgo, row.factualidad, row.prioridad, row.active) == ("a-b", "desconocido", "media", 3, True)
    checked = outlets.validate_outlets(outlets.read_outlets(spark, str(tmp_path))).first()
    assert checked.violations == []


def test_upsert_overwrites_all_or_listed_columns(spark):
    schema = "outlet_id long, slug string, sesgo string, prioridad int"
    old = spark.createDataFrame([(1, "a", "centro", 1), (2, "b", "centro", 1)], schema)
    new = spark.createDataFrame([(9, "b", "derecha", 5), (3, "c", "izquierda", 2)], schema)
    full = {tuple(r) for r in outlets.upsert_outlets(old, new).collect()}
    assert full == {(1, "a", "centro", 1), (2, "b", "derecha", 5), (3, "c", "izquierda", 2)}
    part = {tuple(r) for r in outlets.upsert_outlets(old, new, ["sesgo"]).collect()}
    assert (2, "b", "derecha", 1) in part


def test_write_articles_partitions_by_day(spark, tmp_path):
    rows = spark.createDataFrame([("u1", T0), ("u2", T0 + dt.timedelta(days=1)), ("u3", None)], "url string, fecha_pub timestamp")
    sinks.write_articles(rows, str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.count() == 3 and "pub_date" in back.columns


def test_feeds_return_whole_summaries(spark, tmp_path):
    """What stands after character 300 reaches the rules; only the sink shortens, if asked to."""
    text = "palabra " * 60 + "fin"
    xml = f"<rss><channel><item><title>T</title><link>https://x/1</link><description>{text}</description></item></channel></rss>"
    post = json.dumps([{"link": "https://x/2", "title": {"rendered": "T"}, "excerpt": {"rendered": text}}])
    payloads = spark.createDataFrame([("f", xml, post)], "feed string, xml string, json string")
    items = feeds.parse_feed_xml(payloads, payload="xml").unionByName(feeds.parse_feed_json(payloads, payload="json"))
    assert {r.summary for r in items.collect()} == {text}
    rows = items.withColumnRenamed("summary", "resumen")
    sinks.write_articles(rows, str(tmp_path / "whole"))
    sinks.write_articles(rows, str(tmp_path / "short"), chars=300)
    assert {r.resumen for r in spark.read.parquet(str(tmp_path / "whole")).collect()} == {text}
    assert all(len(r.resumen) <= 301 and r.resumen.endswith("…") for r in spark.read.parquet(str(tmp_path / "short")).collect())


@pytest.fixture
def landed(spark, tmp_path):
    rows = [
        ("u1", "Incendio forestal provincia", "s", T0),
        ("u1", "Incendio forestal provincia", "s", T0 + dt.timedelta(hours=1)),
        ("u2", "Bonoloto: resultado del sorteo", "", T0),
        ("u3", "Huelga transporte ferrocarril", "s", None),
        ("u4", "Incendio forestal provincia grave", "s", T0 + dt.timedelta(hours=2)),
        (None, "sin enlace", "", T0),
    ]
    frame = spark.createDataFrame(rows, ITEMS)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    return frame, str(tmp_path)


def test_stream_equals_batch(spark, landed):
    frame, folder = landed
    known = spark.createDataFrame([("u4",)], "url string")
    items = ST.stream_articles(spark, f"{folder}/in", frame.schema)
    items = ST.stream_dedupe(items, F.lit(T0))
    ST.write_new_articles(items, f"{folder}/out", f"{folder}/cp", lambda: known).awaitTermination()
    got = {r.url for r in spark.read.parquet(f"{folder}/out").collect()}
    batch = feeds.filter_relevant(feeds.drop_known(frame, known, ["fecha_pub"]))
    assert got == {r.url for r in batch.collect()} == {"u1", "u3"}


def test_stream_assign_equals_batch_and_replays(spark, tmp_path):
    rows = [
        (1, 1, "incendio forestal provincia", "", T0),
        (2, 2, "incendio forestal provincia grave", "", T0 + dt.timedelta(hours=1)),
        (3, 3, "huelga transporte ferrocarril", "", T0 + dt.timedelta(hours=2)),
        (4, 3, "incendio forestal provincia", "", T0 + dt.timedelta(hours=200)),
    ]
    frame = spark.createDataFrame(rows, "article_id long, outlet_id long, titulo string, resumen string, fecha_pub timestamp")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    ST.stream_assign(stream, lambda s, b: None, out, str(tmp_path / "cp1")).awaitTermination()
    first = {(r.article_id, r.story_id) for r in spark.read.parquet(out).collect()}
    ST.stream_assign(stream, lambda s, b: None, out, str(tmp_path / "cp2")).awaitTermination()
    again = {(r.article_id, r.story_id) for r in spark.read.parquet(out).collect()}
    batch = {(r.article_id, r.story_id) for r in assign_stories(frame).collect()}
    assert first == again == batch
    # 200 hours later the story is closed: a late piece opens a new one.
    assert ("4", "4") in batch and ("2", "1") in batch


def test_observe_late_counts(spark):
    from pyspark.sql import Observation

    rows = spark.createDataFrame([("a", T0), ("b", T0 - dt.timedelta(days=9))], "url string, fecha_pub timestamp")
    late = F.col("fecha_pub") < F.lit(T0) - F.expr("interval 4 days")
    seen = Observation("ingest")
    rows.observe(seen, F.count(F.lit(1)).alias("seen"), F.count_if(late).alias("late")).collect()
    assert seen.get == {"seen": 2, "late": 1}
    assert ST.observe_late(rows, "fecha_pub", F.lit(T0)).count() == 2
