"""Packing, SimHash, embedding near-duplicates, chats and the pipeline against plain code."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from storylens.catalog.check import compare, connect
from storylens.llm import chat, embedding_dedup, packing, simhash
from storylens.llm.common import hot_join, prepare, table
from storylens.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
ODD_TEXTS = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "a b"), (-5, "A b\x0bC d É"), (-5, "A b\x0bC d É"), (None, "x y z"), (None, None)]


@pytest.fixture(scope="module")
def documents(spark):
    prepare(spark)
    odd = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string")
    return table(spark, FOLDER, "documents").select("doc_id", "text").union(odd).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_hot_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr("storylens.llm.common.HOT_KEYS", 10)
    facts = spark.range(900).selectExpr("id", "if(id % 3 = 0, 0, id % 50) as a", "if(id % 7 = 0, null, 'x') as b")
    dim = spark.range(40).selectExpr("id as a", "'x' as b", "id * 2 as v")
    for keys in (["a"], ["a", "b"]):
        right = dim if len(keys) == 2 else dim.drop("b")
        want = facts.join(right, keys).select("id", "v").collect()
        assert sorted(hot_join(facts, right, *keys).select("id", "v").collect()) == sorted(want)
    assert hot_join(facts.limit(0), dim, "a", "b").collect() == []


def joined(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def lowest(ids):
    some = [i for i in ids if i is not None]
    return min(some) if some else None


def plain_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    texts = ["", "one", "one two", "One TWO three", "a b c " * 400, "é x y", None]
    assert simhash.fingerprints([t or "" for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]


def test_simhash_against_all_pairs(documents, empty):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    roots = joined(len(rows), pairs)
    members = defaultdict(list)
    for i, r in enumerate(roots):
        members[r].append(rows[i][0])
    expected = sorted(str((rows[i][0], format(prints[i], "016x"), lowest(members[roots[i]]))) for i in range(len(rows)))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in simhash.op7(documents).collect()) == expected
    assert simhash.op7(empty).collect() == []


def test_links_of_a_crowded_part(spark, monkeypatch):
    """Many fingerprints share a part; chunks must not lose links, nor links at exactly two bits."""
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 1 << 62))
    made = [base]
    for _ in range(300):
        a, b = rng.integers(0, 62, 2)
        made.append(made[int(rng.integers(0, len(made)))] ^ (1 << int(a)) ^ ((1 << int(b)) * int(rng.integers(0, 2))))
    prints = sorted(set(made))
    monkeypatch.setattr(simhash, "CHUNK", 16)
    df = spark.createDataFrame([(p,) for p in prints], "fp long").distinct()
    got = [(r.a, r.b) for r in simhash.links(df).collect()]
    at = {p: i for i, p in enumerate(prints)}
    assert all((a ^ b).bit_count() <= 2 for a, b in got)
    every = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert joined(len(prints), [(at[a], at[b]) for a, b in got]) == joined(len(prints), every)


def test_packing_round_trip(documents, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.op4(documents).collect()
    counts = defaultdict(int)
    for r in documents.collect():
        ids = np.array(model.encode(r.text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        for k, (start, n) in enumerate(packing.cut(len(ids))):
            counts[r.doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
    for r in rows:
        counts[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] -= 1
    assert not any(counts.values())
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.LENGTH
    bound = packing.lower_bound(np.array([r.length for r in rows]))
    assert bound <= len(sequences) <= 1.01 * bound + 1
    assert packing.op4(empty).collect() == []


def test_cut_and_encoder():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)]
    assert packing.cut(2050) == [(0, 2), (2, 1024), (1026, 1024)]
    encode = packing.encoder()
    for text in ("", " " * 5000, "<|endoftext|>x", "a" * 5000, "'s  x"):
        from tokenizers import Tokenizer
        import public_tokenizers

        model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        assert encode(text).tolist() == model.encode(text, add_special_tokens=False).ids


def test_bounds_hold():
    rng = np.random.default_rng(0)
    for top in (100, 500, 700, 1023):
        lengths = rng.integers(1, top + 1, 300)
        bins, offsets = packing.best_fit(lengths)
        assert packing.lower_bound(lengths) <= bins.max() + 1
        assert np.bincount(bins, weights=lengths).max() <= 1024
    assert packing.lower_bound(np.full(10, 513)) == 10  # volume alone says 6
    assert packing.lower_bound(np.full(9, 342)) == 5  # at most two to a bin


def test_partitions_exchange_documents(spark):
    items = spark.range(4000).selectExpr(
        "id as doc_id", "0 as piece", "0L as start", "250 + pmod(xxhash64(id), 200) as length", "0L as ids_crc32", "id as uid"
    )
    alone = packing.pack(items, part_items=100, rounds=0).select("sequence_id").distinct().count()
    rows = packing.pack(items, part_items=100, rounds=3).collect()
    used = len({r.sequence_id for r in rows})
    assert len(rows) == 4000 and used <= alone
    assert packing.lower_bound(np.array([r.length for r in rows])) <= used


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for group in range(12):
        center = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 90))):
            rows.append((n, (center + rng.normal(size=16) * rng.choice([0.05, 0.2])).astype(np.float32).tolist(), group % 3))
            n += 1
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(5)]  # copies
    n += 5
    odd = [None, [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0]]
    rows += [(n + i, v, 0) for i, v in enumerate(odd)]
    n += len(odd)
    rows += [(n, rows[0][1], None), (n + 1, rows[0][1], None), (rows[0][0], rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")

    def able(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        if not able(a[1], a[2]) or not able(b[1], b[2]) or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93

    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if linked(rows[i], rows[j])]
    roots = joined(len(rows), pairs)
    degree = np.bincount([i for p in pairs for i in p], minlength=len(rows))
    members = defaultdict(list)
    for i, r in enumerate(roots):
        members[r].append(rows[i][0])
    expected = sorted((rows[i][0], int(degree[i]), min(members[roots[i]]), rows[i][0] == min(members[roots[i]])) for i in range(len(rows)))
    got = sorted(map(tuple, embedding_dedup.op6(df).collect()))
    assert got == expected
    assert embedding_dedup.op6(df.limit(0)).collect() == []


def test_embeddings_of_a_large_label(spark):
    """One label with a common direction and planted pairs: no pair is lost, also over several tiles and chunks."""
    rng = np.random.default_rng(8)
    n = 12_000
    own = rng.normal(size=(n, 64))
    own /= np.sqrt((own * own).sum(1, keepdims=True))
    own[n // 2 :] = 0.93 * own[: n // 2] + 0.35 * own[n // 2 :]
    x = (own + 1.2 * np.eye(64)[0]).astype(np.float32)
    u = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    a, b = np.nonzero(np.triu(u @ u.T >= 0.93, 1))
    assert len(a) > n // 4
    roots = joined(n, zip(a.tolist(), b.tolist()))
    degree = np.bincount(np.concatenate((a, b)), minlength=n)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(n), "embedding": list(x), "label": 1}), "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (int(degree[i]), roots[i]) for i in range(n)}


def test_embedding_passes_and_whole_labels(spark, monkeypatch):
    """Passes over several parts, a label too alike for passes, and one that fits a block, against all pairs."""
    import pandas as pd

    monkeypatch.setattr(embedding_dedup, "MOST", 11)
    rng = np.random.default_rng(12)
    own = rng.normal(size=(13_000, 24))
    own[9000:10500] = 0.95 * own[:1500] + 0.3 * own[9000:10500]
    own[10500:11700] += 2.6 * np.sqrt(24) * np.eye(24)[1]
    label = np.repeat([1, 2, 3], [10_500, 1_200, 1_300])
    own[11_700:] = own[11_700] + 0.2 * rng.normal(size=(1_300, 24))  # a dense group, larger than a window
    vectors = pd.DataFrame({"vec_id": range(len(own)), "embedding": list(own.astype(np.float32)), "label": label})
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    _, distinct = embedding_dedup.classes(df)
    passes = {r.label: r.passes for r in embedding_dedup.plan_passes(distinct, 0.93).collect()}
    assert 1 < passes[1] <= embedding_dedup.MOST < passes[2]
    exact = sorted(map(tuple, embedding_dedup.near_duplicates(df, exact=True).collect()))
    assert sum(r[1] for r in exact) > 2 * 1300
    assert sorted(map(tuple, embedding_dedup.op6(df).collect())) == exact


def test_chats_against_sql(spark):
    con = connect(FOLDER)
    assert compare(QUERIES["op8_chat_format"](spark, FOLDER), con, ORACLES["op8_chat_format"]) is None


def test_chat_snapshots(spark, monkeypatch):
    prepare(spark)
    turn = lambda c, *texts: [(c, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    rows = (
        turn(1, "a") + turn(2, "a", "b") + turn(3, "a", "b", "c") + turn(4, "a", "x") + turn(5, "a", "x")
        + turn(6, "b", "c") + turn(7, "") + turn(8, None) + turn(9, *map(str, range(600)))
        + [(None, 0, "user", "n"), (None, None, None, None), (10, 0, "user", "a"), (10, 0, "user", "a")]
    )
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "SLOT", 50)
    out = defaultdict(str)
    copies = {}
    for r in sorted(chat.op8(df).collect(), key=lambda r: (str(r.conv_id), r.part)):
        out[r.conv_id] += r.rendered
        copies[r.conv_id] = r.copies
    assert set(out) == {3, 4, 6, 7, 8, 9, 10, None}
    assert copies[4] == 2 and copies[3] == 1
    assert out[3] == "<|user|>\na\n<|assistant|>\nb\n<|user|>\nc\n"
    assert out[None] == "<||>\n\n<|user|>\nn\n" and out[9].count("<|user|>") == 300
    assert chat.op8(df.limit(0)).collect() == []


def test_pipeline_stages(spark, tmp_path):
    docs = table(spark, FOLDER, "documents")
    odd = spark.createDataFrame(
        [(-1, None, "s"), (-1, None, "s"), (None, "one two three four", None), (-7, "password=hunter2222 ok", "t")],
        "doc_id long, text string, source string",
    )
    bench = table(spark, FOLDER, "benchmark").first().text
    leak = spark.createDataFrame([(-8, "start " + bench + " end", "t")], "doc_id long, text string, source string")
    copies = docs.filter("doc_id < 20").selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars")
    at = docs.unionByName(odd, True).unionByName(leak, True).unionByName(copies)
    at = at.selectExpr("*", "source as score", "n_chars as fp", "'m' as matches", "1 as predicted", "2 as `a.b`")
    columns, before = at.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, at, FOLDER).write.parquet(str(tmp_path / name))
        before, at = at, spark.read.parquet(str(tmp_path / name))
        assert at.columns == columns, name
        ids = {r.doc_id for r in at.select("doc_id").collect()}
        if name == "toxicity":
            assert {-1, None, -7, -8} <= ids and at.count() > 0.7 * before.count()
        if name == "simhash_dedup":
            prints = [plain_fingerprint(r.text) for r in at.select("text").collect()]
            assert len(set(prints)) == len(prints)  # no copy is left
            assert {plain_fingerprint(r.text) for r in before.select("text").collect()} >= set(prints)
            assert not any(i is not None and i >= 100000 for i in ids) and at.filter("doc_id = -1").count() <= 1
        if name == "decontamination":
            assert -8 not in ids and at.count() >= before.count() - 30
    assert at.filter("text like '%hunter2222%'").count() == 0 and at.filter("text = '[REDACTED] ok'").count() == 1
    assert at.filter("doc_id = -7").first().n_chars == len("[REDACTED] ok")
    packed = corpus_pipeline.STAGES[-1][1](spark, at, FOLDER)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in at.collect()}


def test_pipeline_of_nothing(spark, tmp_path):
    at = table(spark, FOLDER, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, FOLDER).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        assert at.count() == 0


def test_pipeline_is_its_stages(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
