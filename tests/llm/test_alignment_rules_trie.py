"""Token alignment, URL rules and the conversation trie against plain code."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import urljoin, urlsplit

import pytest

from storylens.catalog.check import compare, connect
from storylens.llm import conversation_trie, token_alignment, url_rules
from storylens.llm.common import prepare, table
from storylens.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
ODD = [
    "a", " ", "  a", "a  b \n\n c", "▁x y", "x ▁ y", "don't it's  ", "<|endoftext|> hi <s> </s> <unk> <0x41>", "é́ 😶‍🌫️ ⠿⠿ x",
    "\x00 a \x1f b c", "a​ b　 c", "ﬁ ½ x² y", "\n", "\t\t a", "a " * 50, "ß" * 300, "日本語 のテキスト です", "x\u0085 y \x1c z",
    "é a ́b", "￿ a", "a b   c", "one.\nTwo,three\n\nfour \n five", "x" * 40000, "ab, " * 30000,
]


# --- alignment ---


def plain_alignment(aligner, text):
    """Tokens one by one: numbers, groups and linked pairs of a text."""
    spaced = " " + (text or "")
    if len(spaced) == 1:
        return (0, 0, 0, 0), "", Counter()
    a = aligner.a.encode(spaced, add_special_tokens=False).ids
    b = aligner.b.encode(text)
    if any(b"".join(t[i] for i in ids) != spaced.encode() for ids, t in ((a, aligner.a_bytes), (b, aligner.b_bytes))):
        return (0, 0, 0, 0), "", Counter()
    owner = []
    for ids, of in ((a, aligner.a_bytes), (b, aligner.b_bytes)):
        owner.append([k for k, i in enumerate(ids) for _ in of[i]])
    links = Counter((a[x], b[y]) for x, y in set(zip(*owner)))
    groups, lo, n = [], 0, len(owner[0])
    for at in range(1, n + 1):
        if at == n or all(of[at] != of[at - 1] for of in owner):
            one = [",".join(str(ids[k]) for k in sorted(set(of[lo:at]))) for ids, of in zip((a, b), owner)]
            groups.append("|".join(one))
            lo = at
    return (len(a), len(b), len(groups), sum(links.values())), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def plain_op11(rows):
    aligner = token_alignment.Aligner()
    each = [(doc_id, *plain_alignment(aligner, text)) for doc_id, text in rows]
    count = Counter(pair for *_, links in each for pair in links)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return sorted(
        ((str(i), *n, sum(k for p, k in of.items() if count[p] == most[p[0]]), sum(k * count[p] for p, k in of.items()), sha)
         for i, n, sha, of in each)
    )


def test_alignment_equals_plain_code(spark):
    prepare(spark)
    rng = random.Random(3)
    letters = " \n\t.,'a bcXé😶⠿▁́日0 9\x00  \x1c_-"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    docs = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    rows = docs + [(-k, t) for k, t in enumerate([None, "", *ODD, ODD[3], *made], 1)] + [(None, "null id"), (5, docs[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as uid", "'x' as links", "2 as n_a")
    want = plain_op11(rows)
    for broadcast in (token_alignment.BROADCAST_PAIRS, 0):
        found, pairs = token_alignment.align(df.select("doc_id", "text"), broadcast_pairs=broadcast)
        got = found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == want
    assert pairs.filter("best").select("a_id").distinct().count() == pairs.select("a_id").distinct().count()
    assert token_alignment.op11(df).count() == len(rows)


def test_alignment_forgets_and_takes_other_vocabularies_whole(spark, monkeypatch):
    texts = ODD[:12] + ["some words, and more words."] * 3
    want = [plain_alignment(token_alignment.Aligner(), t)[:2] for t in texts]
    monkeypatch.setattr(token_alignment, "REMEMBERED", 3)
    aligner = token_alignment.Aligner()
    assert [(g[:4], g[4]) for t in texts for g in aligner([t])] == want
    aligner.split = None  # as with a vocabulary whose pieces span the cuts
    assert [(g[:4], g[4]) for g in aligner(texts)] == want


def test_alignment_of_nothing(spark):
    prepare(spark)
    assert token_alignment.op11(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- URL rules ---


def page(url, *tags):
    return url, "<!DOCTYPE html><html><head>" + "".join(tags) + "</head><body>text</body></html>"


def canonical(href, quote='"'):
    return f"<link href={quote}{href}{quote} rel='canonical' />"


PAGES = [
    page("http://x.example.com/a", canonical("https://y.example.com/de/1")),  # blocked by its canonical address
    page("https://x.example.com/b", "<META HTTP-EQUIV=refresh CONTENT=\"0; URL='/a'\">"),  # by way of the page above
    page("http://x.example.com/a?p=1&q=2"),
    page("http://o.example.com/c", canonical("//p.example.com/de/2"), canonical("http://q.example.net/en/5")),  # allow wins
    page("http://p.example.com/de/2#top"),  # its own rule
    page("http://o.example.com/d/e/f", canonical("../g?x=1&amp;y=2")),
    page("http://o.example.com/d/g?x=1&y=2", canonical("./../../de/h")),
    page("http://o.example.com/de/h"),
    page("http://O.Example.COM/de", "<link rel='stylesheet' href='http://a.net/'>", canonical("mailto:someone@a.net")),
    page("http://z.example.com", canonical("http://z.example.com/")),
    page("http://z.example.com/", canonical("#here"), canonical("")),
    page("http://u.org/fr/1", canonical("http://b.net/")),
    page("http://u.org/es/1", canonical("http://b.net/", "'")),
    page("http://u.org/es/2", canonical("http://u.org/es/1", "")),
    page("HTTP://NET?x"), page("http://net/x"), page("http://notnet/x"), page("http://a.net:80/x"), page("a.net/en/"),
    page("no url at all"), (None, None), ("http://a.net/", None), ("", ""), page("://a.net/q"), page("http://b.b.net/en/"),
]


def plain_rules(pages):
    def parts(url):
        if url is None or "://" not in url:
            return "", "", None
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        query = re.match(r"[^?#]*(\?[^#]*)?", rest)[1] or ""
        return host, path, host + urlsplit(urljoin("http://h/", path or "/")).path + query

    def rule(host, path):
        fits = [
            (len(h + p), v == "allow", h + p, v) for v, h, p in url_rules.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        return max(fits)[2:] if fits else (None, None)

    edges, decided = defaultdict(set), {}
    for url, html in pages:
        if url is None or "://" not in url:
            continue
        for tag in re.findall(r"(?i)<(?:link|meta)[^>]*>", html or ""):
            href = None
            if re.search(r"(?i)rel=['\"]?canonical", tag):
                href = (re.search("href=\"([^\"]*)\"|href='([^']*)'|href=([^ >]*)", tag) or [""])
                href = next((g for g in href.groups() if g is not None), "")
            elif re.search("(?i)http-equiv=refresh", tag):
                href = re.search("(?i)url='([^']*)'", tag)[1]
            if not href or href.startswith(("#", "mailto:")):
                continue
            target = urljoin(url, href.replace("&amp;", "&"))
            ends = [parts(u)[2] for u in (url, target)]
            edges[ends[0]].add(ends[1])
            edges[ends[1]].add(ends[0])
            for end, u in zip(ends, (url, target)):
                host, path, _ = parts(u)
                decided[end] = rule(host, urlsplit(urljoin("http://h/", path or "/")).path)[1]
    out = []
    for url, _ in pages:
        host, path, key = parts(url)
        name, verdict = rule(host, path)
        seen, todo = {key}, [key]
        while todo:
            for other in edges.get(todo.pop(), ()):
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        of = {decided.get(k) for k in seen}
        alias = "block" if "block" in of and "allow" not in of else "allow"
        out.append((host, path, name, verdict or alias))
    return out


def test_url_rules_equal_plain_code(spark):
    prepare(spark)
    pages = PAGES + PAGES[:3] * 20
    df = spark.createDataFrame([(i, *p, "x", 3) for i, p in enumerate(pages)], "page_id long, url string, html string, rule string, _node int")
    got = sorted(url_rules.op12(df).collect())
    assert [tuple(r)[1:5] for r in got] == plain_rules(pages)
    assert {r.decided_by for r in got} == {"rule", "alias", "default"}
    judged = url_rules.judge(df, url_rules.RULES)
    assert judged.count() == len(pages)
    plan = judged._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_url_rules_take_redirects_and_chains(spark):
    prepare(spark)
    chain = [(f"http://c.test/{i}", f"http://c.test/{i + 1}") for i in range(40)] + [("http://c.test/40", "http://d.net/"), (None, "http://c.test/1")]
    pages = spark.createDataFrame([(i, f"https://c.test/{i}", None) for i in range(42)], "page_id long, url string, html string")
    redirects = spark.createDataFrame(chain, "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in url_rules.judge(pages, url_rules.RULES, redirects).collect()}
    assert got == {i: "block" if i < 41 else "allow" for i in range(42)}


def test_url_rules_of_nothing(spark):
    prepare(spark)
    assert url_rules.op12(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# --- conversations ---


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(of)] for c, of in own.items()}
    full = {}
    for c, of in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        full[c] = tuple(turns.get(base, [])[:h] + of[h:])
    members = defaultdict(list)
    for c, of in full.items():
        for d in range(len(of) + 1):
            members[of[:d]].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(of) - 1) * words
    out = []
    for k, of in members.items():
        ended = sorted(c for c in of if len(full[c]) == len(k))
        sha = hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest()
        parent = min(members[k[:-1]]) if k else None
        out.append((min(of), len(k), parent, len(of), kids[k], leaves[k], saved[k], sha))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(5)
    rows = []
    for c in range(-25, 140):
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi there", "ok", "a b\tc\x0bd", "", " é "])))
    rows += [(200, t, "user", "again and again") for t in range(50)] + [(220, t, "user", "again and again") for t in range(50)]
    rows += [(300, None, None, None), (300, None, "user", None), (300, 1, None, "x"), (300, 1, None, "x"), (None, 0, "user", "lost")]
    rows += [(320, 7, "user", str(k)) for k in range(9)]  # one turn number for all
    return rows


def test_trie_equals_plain_code_whatever_the_bands(spark, chats, monkeypatch):
    prepare(spark)
    df = spark.createDataFrame(chats, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as depth", "2 as pos")
    want = plain_trie(chats)
    assert sorted(map(tuple, conversation_trie.op13(df).collect()), key=str) == want
    monkeypatch.setattr(conversation_trie, "SLOT", 4)  # long conversations and many ends cross slots
    turns, convs = conversation_trie.rebuilt(conversation_trie.ordered_turns(df))
    assert sorted(map(tuple, conversation_trie.trie(turns, convs, 5).collect()), key=str) == want


def test_trie_of_turnless_and_no_conversations(spark):
    prepare(spark)
    schema = "conv_id long, turn long, role string, text string"
    # Turns before its h-th come from a conversation that isn't there.
    lonely = [(c, 0, "user", "x") for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0]
    got = conversation_trie.op13(spark.createDataFrame(lonely, schema)).collect()
    assert [tuple(r) for r in got] == plain_trie(lonely) and len(got) == 1
    assert conversation_trie.op13(spark.createDataFrame([], schema)).collect() == []
    assert conversation_trie.op13(spark.createDataFrame([(None, 1, "user", "x")], schema)).collect() == []


@pytest.mark.parametrize("name", ["op12_url_rules", "op13_conversation_trie"])
def test_sql_agrees(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None
