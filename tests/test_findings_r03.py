"""Small tests of what the findings of round 3 named."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from storylens.functions import text as T
from storylens.plans import joins

FOLDER = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["story_window", "indexable_pages", "list_stories"])
def test_active_stories_are_never_broadcast(spark, name):
    plan = _plan(entry.queries()[name](spark, FOLDER))
    assert "SortMergeJoin [l_orderkey" in plan
    assert "BroadcastHashJoin [l_orderkey" not in plan


def test_part_names_are_never_broadcast(spark):
    plan = _plan(entry.queries()["list_stories"](spark, FOLDER))
    assert "SortMergeJoin [l_partkey" in plan and "BroadcastHashJoin [l_partkey" not in plan


def test_salted_copies_are_never_broadcast(spark):
    fact = spark.range(100).select((F.col("id") % 5).alias("k"), "id")
    dim = spark.range(5).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = joins.lookup_join(fact, dim, "k", rows=1 << 30)
    assert "BroadcastHashJoin" not in _plan(joined)
    assert {(r.k, r.id, r.v) for r in joined.collect()} == {(i % 5, i, i % 5 * 2) for i in range(100)}


def test_initials_keep_two_letters(spark):
    texts = [("der ßer", "Dẞ"), ("ßa", "ẞA"), ("ﬁn", "ﬁN"), ("ábaco élite", "ÁÉ"), ("", "?"), ("x", "X")]
    rows = spark.createDataFrame(texts, "t string, wanted string").select(T.outlet_initials("t").alias("got"), "wanted")
    assert all(r.got == r.wanted for r in rows.collect())


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a & b else 0.0


@pytest.mark.parametrize("text_ids", [False, True])
def test_similar_pairs_equal_brute_force(spark, monkeypatch, text_ids):
    import random

    from storylens.plans import block_scores

    # Several blocks of several pieces, where one common element would be a hot key.
    monkeypatch.setattr(block_scores, "MIN_BLOCK", 40)
    monkeypatch.setattr(block_scores, "MAX_BLOCK", 60)
    rng = random.Random(5)
    rows = []
    for i in range(220):
        words = sorted(rng.sample([f"w{k}" for k in range(25)], rng.randint(0, 9))) + ["common"] * (i % 3 > 0)
        rows.append((f"d{i:03d}" if text_ids else i, f"g{i % 2}", words, sorted({w[:2] for w in words}), words[:2]))
    kind = "string" if text_ids else "long"
    texts = spark.createDataFrame(rows, f"id {kind}, g string, tokens array<string>, bigrams array<string>, lead array<string>")
    for group, lead in ((None, None), ("g", None), ("g", "lead")):
        got = {(r.a, r.b): r.score for r in block_scores.similar_pairs(texts, {"tokens": 0.55, "bigrams": 0.45}, 0.38, group, lead).collect()}
        wanted = {}
        for i, x in enumerate(rows):
            for y in rows[i + 1 :]:
                score = 0.55 * _jaccard(set(x[2]), set(y[2])) + 0.45 * _jaccard(set(x[3]), set(y[3]))
                if score >= 0.38 and (not group or x[1] == y[1]) and (not lead or set(x[4]) & set(y[4])):
                    wanted[x[0], y[0]] = score
        assert wanted and got.keys() == wanted.keys()
        assert all(abs(got[k] - v) < 1e-12 for k, v in wanted.items())


def test_blocks_are_bounded(spark):
    """Titles are compared in blocks: the plan joins no texts on a key they have in common."""
    texts = spark.createDataFrame([(1, ["a"], ["b"])], "id long, tokens array<string>, bigrams array<string>")
    from storylens.operators.similarity import similar_texts

    plan = _plan(similar_texts(texts, 0.38))
    assert "FlatMapGroupsInArrow" in plan and "SortMergeJoin" not in plan


def test_relaxed_pairs_do_not_normalise_texts(spark):
    """Sets of a story are made once: the plan over pairs holds no text rule."""
    from storylens.operators.similarity import relaxed_edges

    rows = [(1, "alfa presidente congreso", "uno", "2024-01-01"), (2, "beta presidente congreso votan", "dos", "2024-01-01")]
    stories = spark.createDataFrame(rows, "story_id long, titulo_canonico string, resumen_canonico string, last_pub string")
    edges = relaxed_edges(stories.withColumn("last_pub", F.to_timestamp("last_pub")))
    assert "translate(" not in _plan(edges)


def test_patterns_run_on_few_texts(spark):
    """Low-value rules and synonyms look for parts of words first, and say the same as their patterns alone."""
    from storylens.functions import fixed_values as V
    from storylens.functions import relevance as R

    texts = [
        "bonoloto resultado del sorteo", "bonoloto premio", "cupon reintegro", "once numeros premiados", "gordo cifras",
        "euromillones combinacion", "primitiva reparto", "quiniela complementario", "loteria de navidad los numeros de la suerte",
        "atp gana", "us open partido", "nuevo los carmenes gol", "supercopa directo", "gira wta jornada", "ciutat de valencia derbi",
        "la cartuja sin remedio", "m1000 final four", "palau sets", "itf ranking atp", "davis racha", "roland garros retirada",
        "avance de ayer", "de hoy", "avance de serie de hoy 3 de mayo", "nada", "",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    lottery = R._any(t, V.LOTTERY_TOPICS) & (t.rlike(V.LOTTERY_RESULT) | t.rlike(V.LOTTERY_PRIZE))
    tv = t.rlike(V.TV_ADVANCE) & t.rlike(V.TV_TODAY) & t.rlike(V.TV_DATE)
    got = rows.select(
        t, lottery.alias("a"), (lottery & R._holds(t, R.LOTTERY_NEEDLES)).alias("b"), t.rlike(V.CLUB_SPORTS).alias("c"),
        t.rlike(R.CLUB_SPORTS).alias("d"), tv.alias("e"), R._tv_advance(t, t).alias("f"),
    ).collect()
    assert all(r.a == r.b and r.c == r.d and r.e == r.f for r in got)
    assert sum(r.a for r in got) == 9 and sum(r.c for r in got) == 12 and sum(r.e for r in got) == 1
    plan = _plan(rows.select(R.is_low_value("t", "t")))
    assert "inflacion)" in plan and "reintegro)" in plan


def test_synonyms_and_percents_as_before(spark):
    plain = [
        ("el IPC sube 3,4 %", "el inflacion ipc sube 34pct"), ("alza_x alza ipcx", "alza x subida ipcx"), ("Inflación, gasóleo", "inflacion ipc combustibles"),
        ("encarecimientos encarecimientosx", "subida encarecimientosx"), ("3,4 % 5.6%", "34pct 56pct"), ("gasolinera carburantes", "gasolinera combustibles"),
    ]
    rows = spark.createDataFrame(plain, "t string, wanted string").select(T.normalize_for_match("t").alias("got"), "wanted")
    assert [r.got for r in rows.collect()] == [w for _, w in plain]


def test_sets_of_articles_normalise_a_text_once(spark):
    from storylens.operators import clustering as CL

    texts = [("Sube un 3,4 % el  IPC", "gasolina   y\n\tluz"), ("Título", None), ("", "")]
    rows = spark.createDataFrame(texts, "titulo string, resumen string")
    made = CL._with_features(rows, "titulo", "resumen")
    assert _plan(made).count("translate(") == 2
    whole = T.compare_text("titulo", "resumen")
    wanted = {"title_tokens": T.token_set("titulo"), "title_bigrams": T.bigram_set("titulo"), "full_tokens": T.token_set(whole), "full_bigrams": T.bigram_set(whole)}
    for name, sets in wanted.items():
        assert made.filter(~F.col(name).eqNullSafe(CL._numbers(sets))).isEmpty()


def _plain_merge(groups, merge_th, small_th, strong_th):
    """Merging over all pairs, the best first."""
    from storylens.operators.clustering import _angle

    live = {k: dict(g) for k, g in enumerate(groups)}

    def score(i, j):
        a, b = live[i], live[j]
        shares = [{e: c / g["n"] for e, c in g["counts"].items()} for g in (a, b)]
        strength = max((min(shares[0][e], shares[1][e]) for e in shares[0].keys() & shares[1].keys()), default=0.0)
        limit = small_th if min(a["n"], b["n"]) <= 4 else merge_th
        limit = min(limit, strong_th) if strength >= 0.6 else limit
        linkage = float(a["sum"] @ b["sum"]) / (a["n"] * b["n"])
        fits = strength >= 0.2 and _angle(a["centroid"], b["centroid"]) >= limit - 0.03 and linkage >= limit
        return linkage if fits else -1.0

    while True:
        found = [(score(i, j), -i, -j) for i in live for j in live if i < j]
        best = max(found, default=(-1.0, 0, 0))
        if best[0] <= 0:
            return [g["items"] for g in live.values()]
        a, b = live[-best[1]], live.pop(-best[2])
        a["centroid"] = (a["centroid"] * a["n"] + b["centroid"] * b["n"]) / (a["n"] + b["n"])
        a["items"], a["sum"], a["n"] = a["items"] + b["items"], a["sum"] + b["sum"], a["n"] + b["n"]
        a["counts"] = {e: a["counts"].get(e, 0) + b["counts"].get(e, 0) for e in a["counts"] | b["counts"]}


def test_regrouping_scores_a_row_against_all_groups_at_once(monkeypatch):
    import numpy as np

    from storylens.operators import clustering as CL

    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16))
    x = np.repeat(middle, 20, axis=0) + rng.normal(size=(240, 16)) * 0.8
    x[5] = x[4]
    outlet, at = [f"o{i % 7}" for i in range(240)], np.arange(240) * 3_600_000_000
    entities = [{f"e{i // 40}"} | ({"all"} if i % 3 else set()) for i in range(240)]
    calls = []
    angle = CL._angle
    monkeypatch.setattr(CL, "_angle", lambda a, b: calls.append(1) or angle(a, b))
    u = CL._units(x)
    groups = CL._cluster(x, u, at, outlet, 0.6, [])
    assert len(groups) > 60 and len(calls) <= 2 * len(x)  # one by one would take a score for every open group
    for g in groups:
        g["sum"], g["counts"] = u[g["items"]].sum(0), CL._counts(g["items"], entities)
    wanted = _plain_merge(groups, 0.5, 0.45, 0.4)
    assert len(wanted) < len(groups)
    calls.clear()
    assert [g["items"] for g in CL._merge(groups, 0.5, 0.45, 0.4)] == wanted
    assert not calls


def test_size_estimates_do_not_grow_over_slices(spark, monkeypatch):
    """a slice's result is the next one's input; its size estimate must not be a product of all before it."""
    from storylens.operators import clustering as CL
    from storylens.plans.joins import plan_bytes

    estimates, passed = [], CL._passed

    def watched(*args):
        estimates.append(plan_bytes(passed(*args)))
        return passed(*args)

    monkeypatch.setattr(CL, "_passed", watched)
    rows = [(i, i % 3, f"caso {i % 4}", "", f"2024-01-01 {i:02d}:00:00", [float(i % 4 == k) for k in range(4)]) for i in range(20)]
    articles = spark.createDataFrame(rows, "article_id long, outlet_id long, titulo string, resumen string, fecha_pub string, embedding array<double>")
    assert CL.assign_stories(articles, mode="local", embedding_threshold=0.6, slice_rows=4).count() == 20
    assert len(estimates) == 5 and max(estimates) < 1 << 100


def test_fulltext_search_shuffles_no_occurrence(spark):
    """stories are judged where they are read, and phrases, forms, odd terms and nulls count as before."""
    from storylens.operators import search as SR

    rows = [(1, "Los gatos negros", "duermen"), (2, "Negro gato", None), (3, "gato y negro", ""), (4, None, None), (5, "perros", "gato negro")]
    stories = spark.createDataFrame(rows, "story_id long, titulo_canonico string, resumen_canonico string")

    def ids(**terms):
        return sorted(r.story_id for r in SR.search_fulltext(stories, **terms).collect())

    assert ids(all_of=["gato"]) == [1, 2, 3, 5]
    assert ids(all_of=["gato negro"]) == [1, 5]
    assert ids(any_of=["perro", "negro gato"], none_of=["duermen"]) == [2, 5]
    assert ids(none_of=["gato"]) == [4] and ids(all_of=["¡!"]) == [] and ids(none_of=["¡!"]) == [1, 2, 3, 4, 5]
    plan = _plan(SR.search_fulltext(stories, all_of=["gato negro"], none_of=["perro"]))
    assert "Join" not in plan.split("Subquery")[0]


def _largest_partition(df):
    """Most rows of ``df`` that one task holds."""
    return max(r[1] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_merge_pairs_of_one_target_go_to_many_tasks(spark):
    """a target that a third of the pairs name is no hot key, and odd pairs are judged as before."""
    from storylens.operators import maintenance as M

    stories = spark.createDataFrame([(i,) for i in range(1, 9)], "story_id long")
    pairs = [
        ("1", "2"), ("1", "2"), (" 1 ", "3"), ("4", "4"), ("9", "5"), ("1", "99"), ("6", "7"), ("8", "7"), ("2", "6"),
        ("1", None), (None, "77"), ("", "77"), ("5", " "), ("4", "8"),
    ]
    valid, rejected = M.check_merge_pairs(spark.createDataFrame(pairs, "target string, source string"), stories)
    assert sorted((r.target, r.source) for r in valid.collect()) == [(" 1 ", "3"), ("1", "2"), ("4", "8")]
    assert sorted(((r.target, r.source, r.reason) for r in rejected.collect()), key=repr) == sorted([
        ("4", "4", "same_story"), ("9", "5", "unknown_target"), ("1", "99", "unknown_source"), ("8", "7", "source_has_other_target"),
        ("2", "6", "target_is_merged_away"), ("6", "7", "target_is_merged_away"), ("1", None, "blank_id"), (None, "77", "blank_id"),
        ("", "77", "blank_id"), ("5", " ", "blank_id"),
    ], key=repr)
    many = spark.range(1, 30001).select(F.least("id", F.lit(-1)).alias("target"), F.col("id").alias("source"))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    kept = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        _, rejected = M.check_merge_pairs(many, spark.range(1, 30001).withColumnRenamed("id", "story_id"))
        assert rejected.count() == 30000 and _largest_partition(rejected) < 20000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_sliding_totals_add_hours_up_once(spark):
    """an hour's sums are made once for both changes it brings, and windows with gaps add up as before."""
    import datetime as dt

    from storylens.streaming.articles import sliding_totals

    at = [dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 1, 0, 50), dt.datetime(2024, 1, 1, 2, 0), dt.datetime(2024, 1, 2, 9, 30), None]
    rows = spark.createDataFrame([(k, t, i + 1) for i, t in enumerate(at) for k in ("a", None)], "k string, at timestamp, v long")
    totals = sliding_totals(rows, "at", ["k"], {"n": F.count(F.lit(1)), "v": F.sum("v")}, hours=3)
    wanted = {}
    for i, t in enumerate(at[:4]):
        for h in range(3):
            start = t.replace(minute=0) - dt.timedelta(hours=h)
            n, v = wanted.get(start, (0, 0))
            wanted[start] = (n + 1, v + i + 1)
    got = {(r.k, r.start): (r.n, r.v) for r in totals.collect()}
    assert got == {(k, s): nv for s, nv in wanted.items() for k in ("a", None)}
    assert "Union" not in _plan(totals)


def test_registered_queries_bound_the_bytes_of_a_task(spark):
    """a task takes 16 MB of shuffle or 32 MB of a file, however many there are."""
    entry.queries()["featured_story"](spark, FOLDER)
    assert int(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes").rstrip("b")) == 16 << 20
    assert int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b")) == 32 << 20


def test_ranking_stores_only_what_is_asked_for(spark, monkeypatch):
    """the ranked rows are checkpointed, so columns that the query drops must go before."""
    from storylens.operators import search as SR

    given, rank = [], SR.global_rank
    monkeypatch.setattr(SR, "global_rank", lambda df, *rest: given.append(df.columns) or rank(df, *rest))
    ranked = entry.queries()["hybrid_rank"](spark, FOLDER)
    assert given == [["story_id", "importance", "last_pub", "score"]]
    assert ranked.columns == ["story_id", "importance", "last_pub", "score", "position"]
