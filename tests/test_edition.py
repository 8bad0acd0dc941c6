import random

import pytest
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.operators import edition as E
from tidewire.operators import graph
from tidewire.operators.graph import components
from tidewire.sources import feeds as I

NOW = 1_700_000_000_000
H = 3_600_000
ARTICLE = "idx long, source_id string, source string, tier string, source_type string, title string, url string, published_ms long, summary string, max_items int, title_include string"


def article(idx, title="t", url=None, ms=NOW, tier="Tech & General", source="s", kind="news", summary="", cap=None, inc=None):
    return (idx, source, source, tier, kind, title, url or f"https://e.com/{idx}", ms, summary, cap, inc)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ARTICLE)


def ids(df):
    return sorted(r["idx"] for r in df.collect())


def test_normalize(spark):
    src = C.sources_df(spark)
    kind = "source_id string, pos long, title string, link string, iso_date string, pub_date string, snippet string"
    rows = [
        ("krebs", 0, " A &amp; B ", "\n https://e.com/a \n", "2024-01-01T00:00:00Z", None, " x " * 300), ("krebs", 1, None, "https://e.com", "2024-01-01T00:00:00Z", None, None), ("krebs", 2, "&nbsp;", "https://e.com", "2024-01-01T00:00:00Z", None, None),
        ("krebs", 3, "t", "javascript:alert(1)", "2024-01-01T00:00:00Z", None, None), ("krebs", 4, "t", "https://e.com", "", "Mon, 1 Jan 2024 02:00:00 CEST", None), ("krebs", 5, "t", "https://e.com", None, "never", None), ("nobody", 6, "t", "https://e.com", "2024-01-01T00:00:00Z", None, None),
        ("cisa", 0, "t", " ", "2024-01-01T00:00:00Z", None, None),
    ]
    out = {r["idx"]: r for r in E.normalize(spark.createDataFrame(rows, kind), src).collect()}
    assert sorted(out) == [0, 4]
    assert out[0]["title"] == "A & B" and out[0]["url"] == "https://e.com/a" and out[0]["summary"].endswith("x…") and len(out[0]["summary"]) <= 400
    assert out[4]["published_ms"] == 1704067200000 and out[4]["summary"] == ""


def test_lookback_is_inclusive(spark):
    df = frame(spark, article(1, ms=NOW - 24 * H), article(2, ms=NOW - 24 * H - 1), article(3, ms=NOW - 72 * H, kind="cert"), article(4, ms=NOW + H), article(5, ms=None))
    assert ids(E.within_lookback(df, NOW)) == [1, 3, 4]


def test_cap_takes_the_newest_and_reorders(spark):
    df = frame(spark, *(article(10 + k, ms=NOW - abs(k - 3) * H, cap=2) for k in range(5)), article(20, source="o", ms=NOW - 9 * H), article(21, source="o", ms=NOW), article(30, source="z", cap=0))
    out = sorted((r["idx"], r["published_ms"], r["source_id"]) for r in E.newest(df).collect())
    assert out == [(10, NOW, "s"), (11, NOW - H, "s"), (20, NOW - 9 * H, "o"), (21, NOW, "o"), (30, NOW, "z")]


def test_include_before_lookback_before_cap(spark):
    df = frame(spark, article(1, "exploit a", ms=NOW - 2 * H, cap=1, inc="(?i)exploit"), article(2, "other", ms=NOW, cap=1, inc="(?i)exploit"), article(3, "exploit old", ms=NOW - 90 * H, cap=1, inc="(?i)exploit"))
    assert [r["title"] for r in E.source_window(df, NOW).collect()] == ["exploit a"]


def test_dedupe(spark):
    df = frame(
        spark,
        article(1, "Same Title!", "https://a.com/1", NOW), article(2, "same title", "https://b.com/2", NOW - 1), article(3, "third", "https://B.com/2/?utm_source=x", NOW + 5),  # a chain: the earliest stays
        article(4, "🔥", "https://c.com/1"), article(5, "🔥🔥", "https://c.com/2"),  # empty titles join nothing
        article(6, "tie", "https://d.com/1", tier="Tech & General"), article(7, "tie", "https://d.com/2", tier="Government"), article(8, "TIE", "https://d.com/3", tier="Government"),
        article(9, "bad date", "https://e.com/9", None), article(10, "bad date", "https://e.com/10", NOW + 10**9),
    )
    once = E.dedupe(df)
    assert ids(once) == [2, 4, 5, 7, 10]
    assert ids(E.dedupe(once)) == [2, 4, 5, 7, 10]


def test_dedupe_does_not_depend_on_partitions(spark):
    r = random.Random(3)
    df = frame(spark, *(article(k, f"t{r.randrange(60)}", f"https://e.com/{r.randrange(60)}", NOW - r.randrange(5)) for k in range(150)))
    assert ids(E.dedupe(df)) == ids(E.dedupe(df.repartition(7).orderBy(F.rand(1))))


@pytest.mark.parametrize("one_task", [graph.ONE_TASK, 0])
@pytest.mark.parametrize("seed", range(3))
def test_components_are_brute_force(spark, monkeypatch, seed, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    r = random.Random(seed)
    edges = [(r.randrange(100), r.randrange(100)) for _ in range(70)] + [(200 + k, 201 + k) for k in range(40)] + [(5, 5), (300, 301), (None, 3)]
    got = {x["v"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    least = {}
    for v in root:
        least.setdefault(find(v), []).append(v)
    assert got == {v: min(vs) for vs in least.values() for v in vs}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scores_and_order(spark):
    df = frame(spark, article(1, tier="Government", ms=NOW - 3 * H), article(2, ms=NOW - 5 * 60_000), article(3, ms=NOW + 71 * 24 * H), article(4, ms=None), article(5, ms=NOW + H))
    out = {r["idx"]: r for r in E.ranked(E.derive(df), NOW).collect()}
    assert round(out[1]["score"], 9) == round(1.5 * 0.5**0.5, 9) and out[3]["score"] == 1.0 and out[4]["score"] == 0.0
    assert sorted(out, key=lambda k: out[k]["rank"]) == [1, 3, 5, 2, 4]


def test_composition(spark):
    df = frame(spark, article(1, "Zero-day in x CVE-2024-1111"), article(2, "Market news"), article(3, "CVE-2024-2222 patch, CVE-2024-1111", ms=NOW - H), article(4, "Ransomware wave"))
    ed = E.compose(df, NOW).orderBy("edition_pos").collect()
    assert [(r["section"], r["idx"], r["rank"]) for r in ed] == [("Vulnerabilities", 1, 1), ("Vulnerabilities", 3, 2), ("Ransomware", 4, 1), ("Industry/Policy", 2, 1)]
    assert [(r["cve"], r["pos"]) for r in E.unique_cves(E.compose(df, NOW)).orderBy("pos").collect()] == [("CVE-2024-1111", 1), ("CVE-2024-2222", 2)]
    assert [len(r["articles"]) for r in E.grouped(E.compose(df, NOW)).orderBy("section_pos").collect()] == [2, 1, 1]
    with pytest.raises(E.Rejected):
        E.admitted(E.compose(df.limit(0), NOW))


def test_gates_and_items(spark):
    rss = '<?xml version="1.0"?><rss version="2.0"><channel><title>c</title><item><title>A &amp;amp; B</title><link>https://e.com/1</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item><item><title>B</title></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>C</title><link href="https://e.com/c"/><updated>2024-01-02T00:00:00Z</updated><summary>s</summary></entry></feed>'
    rows = [("krebs", 200, "text/html", rss), ("cisa", 200, "text/html", rss), ("talos", 200, "application/atom+XML", atom), ("unit42", 500, "text/xml", rss), ("cccs", 200, None, rss), ("schneier", 200, "text/xml", "x" * (C.BODY_BYTES + 1)), ("volexity", 200, "text/xml", "not xml")]
    gated = I.gated(spark.createDataFrame(rows, "source_id string, status int, content_type string, body string"), C.sources_df(spark))
    assert {r["source_id"]: r["outcome"] for r in gated.collect()} == {"krebs": "ok", "cisa": "content type", "talos": "ok", "unit42": "status", "cccs": "content type", "schneier": "size", "volexity": "ok"}
    got = sorted((r["source_id"], r["pos"], r["title"], r["link"]) for r in I.items(gated).collect())
    assert got == [("krebs", 0, "A &amp; B", "https://e.com/1"), ("krebs", 1, "B", None), ("talos", 0, "C", "https://e.com/c")]


def read(spark, body):
    return [tuple(r)[1:] for r in I.items(spark.createDataFrame([("s", "ok", body)], "source_id string, outcome string, body string")).select("source_id", "title", "link", "iso_date", "pub_date", "snippet").collect()]


def test_rdf_feed(spark):
    body = """<rdf:RDF xmlns="http://purl.org/rss/1.0/" xmlns:rdf="r" xmlns:dc="d"><channel rdf:about="x"><title>c</title><items><rdf:Seq><rdf:li rdf:resource="a"/></rdf:Seq></items></channel>
      <item rdf:about="a"><title>One</title><link>https://e.com/1</link><description>text</description><dc:date>2024-01-02T03:04:05+09:00</dc:date></item><item><title>Two</title></item></rdf:RDF>"""
    assert read(spark, body) == [("One", "https://e.com/1", "2024-01-02T03:04:05+09:00", None, "text"), ("Two", None, None, None, None)]


def test_atom_links_and_content(spark):
    body = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">A</title><link rel="replies" href="https://e.com/r"/><link rel="alternate" href="https://e.com/a"/><link rel="edit" href="https://e.com/e"/>
      <published>2024-01-02T00:00:00Z</published><updated>2024-01-03T00:00:00Z</updated><summary>short</summary><content type="html">&lt;p&gt;Full &amp;amp; long&lt;/p&gt;</content></entry>
      <entry><title>B</title><link href="https://e.com/b"/><link rel="self" href="https://e.com/s"/><updated>2024-01-03T00:00:00Z</updated></entry></feed>"""
    assert read(spark, body) == [("A", "https://e.com/a", "2024-01-02T00:00:00Z", None, "Full & long"), ("B", "https://e.com/b", "2024-01-03T00:00:00Z", None, None)]


def test_rss_snippets_are_text(spark):
    html = "&lt;p&gt;Hello &lt;b&gt;you&lt;/b&gt;&amp;hellip;&lt;/p&gt;&lt;p&gt;Next&lt;br/&gt;line &amp;lt;tag&amp;gt; &amp;eacute;&lt;/p&gt;"
    body = f'<rss version="2.0" xmlns:dc="d" xmlns:media="m"><channel><item><title>t</title><media:title>m</media:title><link>https://e.com</link><description>{html}</description><dc:date>2024-01-01T00:00:00Z</dc:date></item><item><title>u</title><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate><description><![CDATA[<a href="x">a > b</a> 1 < 2]]></description></item></channel></rss>'
    (a, b) = read(spark, body)
    assert a[:4] == ("t", "https://e.com", "2024-01-01T00:00:00Z", None) and a[4].split() == "Hello you… Next line <tag> é".split()
    assert b[2:4] == (None, "Mon, 01 Jan 2024 00:00:00 GMT") and b[4].startswith("a > b 1")


KEPT = {
    "huntress": (["How Attackers turn tools around", "Compromise leads to Malware", "Inside the attack", "CVE-2024-1 seen"], ["Reports exaggerated", "Counterattacker league", "exploitability talk", "remalwared", "New trojan in a store", "APT29 moves"]),
    "sekoia": (["It was Exploited first", "Gotta Breach them", "New trojan in a store", "APT29 targets", "APT group", "Intrusion at telecom"], ["The future of work", "Hacked routers", "Flaw in router", "adaptation"]),
    "eset-research": (["How the infostealer works", "APT Activity", "Two critical flaws", "Hacked routers", "hack day", "Trojanized app", "Flaw in router"], ["This month in review", "Cybersecurity week", "hacker news", "flawless", "éhack"]),
}


@pytest.mark.parametrize("source", sorted(KEPT))
def test_title_patterns(spark, source):
    assert sorted(C.TITLE_INCLUDE) == sorted(KEPT)
    keep, drop = KEPT[source]
    rows = [(source, k, t, "https://e.com", "2024-01-01T00:00:00Z", None, None) for k, t in enumerate(keep + drop)]
    items = spark.createDataFrame(rows, "source_id string, pos long, title string, link string, iso_date string, pub_date string, snippet string")
    got = {r["title"] for r in E.title_included(E.normalize(items, C.sources_df(spark))).collect()}
    assert got - {"éhack"} == set(keep)


def test_fixture_edition(spark):
    from tidewire.plans import fixture as X

    ed = E.compose(X.articles(spark, NOW), NOW).collect()
    again = E.compose(X.articles(spark, NOW), NOW).collect()
    assert len(ed) == 40 and sorted(map(str, ed)) == sorted(map(str, again))
    count = {s: sum(r["section"] == s for r in ed) for s in C.SECTIONS}
    assert count == {"Vulnerabilities": 10, "Advisories": 9, "Ransomware": 8, "Breaches": 3, "Threat Intelligence": 2, "Tools/Techniques": 2, "Industry/Policy": 6}
    assert {r["tier"] for r in ed} == set(C.WEIGHTS) and {r["source_type"] for r in ed} == set(C.LOOKBACK) and {r["importance"] for r in ed} == {"critical", "high", "normal"}
    assert max(len(r["cves"]) for r in ed) == 12 and sum(r["summary"] == "" for r in ed) == 1 and max(len(r["title"].split()[0]) for r in ed) == 160
    plan = {r["section"]: r["hidden"] for r in __import__("tidewire.operators.views", fromlist=["x"]).section_plan(E.compose(X.articles(spark, NOW), NOW)).collect()}
    assert plan["Vulnerabilities"] == 4 and plan["Advisories"] == 3 and plan["Ransomware"] == 0
    ids = spark.createDataFrame([(c,) for r in ed for c in r["cves"]] + [("CVE-2099-10002",), ("no id",)], "cve string")
    scores = {r["cve"]: (r["state"], r["score"]) for r in X.epss(ids).collect()}
    assert len(scores) == 17 and scores["CVE-2099-10002"] == ("scored", 0.42) and scores["CVE-2099-10001"] == ("no-row", None)
    assert {r["cve"]: r["exploitation"] for r in X.ssvc(ids).where("state = 'assessed'").collect()} == {"CVE-2099-10002": "active", "CVE-2099-10004": "poc"}
    assert X.kev(spark).count() == 2


def test_site_url():
    assert C.site_url({"SITE_URL": " https://x.example/ "}) == "https://x.example" and C.site_url({}) == C.site_url({"SITE_URL": " "}) == "http://localhost:4000"
    with pytest.raises(ValueError):
        C.site_url({}, production=True)


def test_ranks_of_a_large_group(spark):
    from tidewire.operators.ranking import ranked_within

    r = random.Random(4)
    rows = [(k, "hot" if k % 3 else f"g{k % 5}", r.randrange(20)) for k in range(600)]
    out = ranked_within(spark.createDataFrame(rows, "k int, g string, x int"), "g", [F.desc("x"), F.col("k")]).collect()
    for g in {g for _, g, _ in rows}:
        want = [k for k, _, _ in sorted((x for x in rows if x[1] == g), key=lambda x: (-x[2], x[0]))]
        assert [x["k"] for x in sorted((x for x in out if x["g"] == g), key=lambda x: x["rank"])] == want
        assert sorted(x["rank"] for x in out if x["g"] == g) == list(range(1, len(want) + 1))
    assert ranked_within(spark.createDataFrame([], "k int, g string, x int"), "g", [F.col("k")]).count() == 0
