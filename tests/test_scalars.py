import pytest
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import scalars as S
from tidewire.functions import udfs as U


def one(spark, f, *values, kind="string"):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} {kind}" for n in names))
    return df.select(f(*names).alias("r")).first()["r"]


def many(spark, f, cases, kind="string"):
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], f"k int, x {kind}")
    got = {r["k"]: r["r"] for r in df.select("k", f("x").alias("r")).collect()}
    assert [(x, got[k]) for k, (x, _) in enumerate(cases)] == cases


def test_decode_entities(spark):
    many(spark, U.decode_entities, [("a &amp; b", "a & b"), ("&amp;lt;", "&lt;"), ("&#38;amp;", "&amp;"), ("&#x41;&#X42;", "AB"), ("&TRADE;", "™"), ("&bogus;", "&bogus;"), ("&#0;", "&#0;"), ("&#xD800;", "&#xD800;"), ("&#x110000;", "&#x110000;"), ("&#12ab;", "&#12ab;"), ("&amp", "&amp"), (None, None), ("", "")])


def test_title_keys_agree(spark):
    cases = [("  Hello,   World! ", "hello world"), ("Zero-Day: CVE-2024-1", "zero day cve 2024 1"), ("🔥🔥", ""), ("Über Étude", "über étude"), ("a b", "a b"), (None, None)]
    many(spark, S.title_key, cases)
    many(spark, U.title_key, [*cases, ("ﬁle Ⅳ", "file iv")])


URLS = [
    ("https://Example.COM/path/", "example.com/path"), ("http://example.com", "example.com/"), ("http://example.com:80/a", "example.com/a"), ("https://e.com:8443/a#x", "e.com:8443/a"),
    ("https://e.com/a?utm_source=x&b=2&a=1&ref=q", "e.com/a?a=1&b=2"), ("https://e.com/a?UTM_x=1&FBCLID=2", "e.com/a"), ("https://e.com/a?b=2&a=1&b=1", "e.com/a?a=1&b=2&b=1"), ("https://e.com/a?x", "e.com/a?x="), ("  not a url ", "not a url"), (None, None),
]


def test_url_keys_agree(spark):
    many(spark, S.url_key, URLS)
    many(spark, U.url_key, [*URLS, ("https://e.com/a/../b/./c", "e.com/b/c"), ("https://e.com/a b", "e.com/a%20b"), ("https://e.com/?q=a b", "e.com/?q=a+b"), ("mailto:x@y", "mailto:x@y")])


def test_truncate_summary(spark):
    word = "abcdefghi "
    long = word * 60
    got = one(spark, S.truncate_summary, long)
    assert len(got) <= C.SUMMARY_CHARS and got.endswith("i…")
    many(spark, S.truncate_summary, [("x" * 400, "x" * 400), ("x" * 401, "x" * 399 + "…"), ("a " + "x" * 500, "a " + "x" * 397 + "…"), ("y" * 300 + ",; " + "x" * 200, "y" * 300 + "…"), ("", ""), (None, None)])
    again = one(spark, S.truncate_summary, got)
    assert again == got
    assert one(spark, S.truncate_summary, "😀" * 500) == "😀" * 399 + "…"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Fri, 18 Sep 26 12:00:00 +0000", 1789732800000), ("Tue, 10 Jun 2025 14:30:00 CEST", 1749558600000), ("10 Jun 2025 14:30 CET", 1749562200000), ("Tue, 10 Jun 2025 14:30:00 GMT", 1749565800000), ("2025-06-10T14:30:00Z", 1749565800000),
        ("2025-06-10", 1749513600000), ("Wed, 10 Jun 2025 14:30:00 EST", 1749583800000), ("soon", None), ("", None), ("x" * 65, None), (None, None), (" 10 Jun 2025 14:30:00 +0000 ", 1749565800000),
    ],
)
def test_feed_dates(spark, text, want):
    assert one(spark, lambda c: F.unix_millis(S.feed_date(c)), text) == want


def test_cves(spark):
    f = lambda c: F.array_join(S.cves(c, F.lit("")), ",")
    many(spark, f, [("cve-2024-1234 and CVE-2024-1234, CVE-2023-99999", "CVE-2024-1234,CVE-2023-99999"), ("CVE-2024-12345678", ""), ("CVE-2024-123", ""), ("xCVE-2024-1234y", "CVE-2024-1234")])
    many(spark, S.is_cve, [("CVE-2024-1234", True), ("CVE-2024-1234\n", False), ("cve-2024-1234", False), (None, False)])
    assert one(spark, lambda c: F.size(S.cves(c, F.lit(""))), "CVE-2024-" + "1" * 150_000) == 0


@pytest.mark.parametrize(
    ("title", "summary", "want"),
    [
        ("New CVE-2024-1 found", "", "Vulnerabilities"), ("Ransomware hits", "exploit", "Ransomware"), ("Data leaks", "", "Breaches"), ("Vendor warns", "", "Advisories"), ("APT29 moves", "", "Industry/Policy"), ("APTs move", "", "Threat Intelligence"),
        ("TA505 again", "", "Threat Intelligence"), ("toolkit", "", "Industry/Policy"), ("étool", "", "Tools/Techniques"), ("tools", "", "Tools/Techniques"), ("nothing", "a patched flaw", "Vulnerabilities"), ("brain worm", "", "Industry/Policy"), ("", "", "Industry/Policy"), ("patches", "", "Vulnerabilities"),
    ],
)
def test_classify(spark, title, summary, want):
    assert one(spark, S.classify, title, summary) == want


@pytest.mark.parametrize(
    ("text", "section", "cves", "want"),
    [
        ("Actively exploited bug", "X", [], ("critical", "Actively exploited")), ("0days", "X", [], ("critical", "Zero-day")), ("added to KEV", "X", [], ("critical", "CISA KEV")), ("kev notes", "X", [], ("normal", None)), ("Patch now please", "X", [], ("critical", "Emergency patch")),
        ("CVSS score of 9.8", "X", [], ("high", "Critical severity")), ("rce", "X", [], ("high", "Remote compromise")), ("plain", "X", ["a"], ("high", "CVE assigned")), ("plain", "X", ["a", "b"], ("high", "2 CVEs")), ("plain", "Breaches", [], ("high", "Breach")), ("plain", "X", [], ("normal", None)),
    ],
)
def test_importance(spark, text, section, cves, want):
    df = spark.createDataFrame([(text, section, cves)], "t string, s string, c array<string>")
    a, b = S.signals("t")
    level, reason = S.importance("a", "b", "s", "c")
    assert tuple(df.withColumns({"a": a, "b": b}).select(level, reason).first()) == want


def test_labels(spark):
    many(spark, U.fixed2, [(0.145, "0.14"), (1.005, "1.00"), (0.125, "0.13"), (0.5, "0.50"), (None, None)], kind="double")
    now = 1_700_000_000_000
    many(spark, lambda c: S.relative_time(F.col(c), now), [(now + 5, "just now"), (now - 59_999, "just now"), (now - 60_000, "1m ago"), (now - 3_599_999, "59m ago"), (now - 100 * 3_600_000, "100h ago")], kind="long")
    ts = lambda f: lambda c: f(F.col(c).try_cast("timestamp"))
    many(spark, ts(S.utc_short), [("2024-03-05T07:08:09Z", "Mar 5, 07:08 UTC"), ("never", "unknown time")])
    many(spark, ts(S.rfc822), [("2024-03-05T07:08:09Z", "Tue, 05 Mar 2024 07:08:09 GMT")])
    many(spark, S.escape_xml, [("a<b>&\"'\x00\x07￾", "a&lt;b&gt;&amp;&quot;&apos;"), ("😀\t", "😀\t")])
    many(spark, S.slug, [("Tools/Techniques", "tools-techniques"), ("Threat Intelligence", "threat-intelligence")])


def test_article_id_is_the_hash(spark):
    import base64
    import hashlib

    for url in ("https://example.com/", "", "é"):
        assert one(spark, S.article_id, url) == base64.urlsafe_b64encode(hashlib.sha256(url.encode()).digest())[:12].decode()


def test_dates_counts_units(spark):
    many(spark, S.real_date, [("2024-02-29", True), ("2024-02-30", False), ("0050-01-01", False), ("2024-1-01", False), ("2024-01-01\n", False), (None, False)])
    many(spark, S.count_of, [(1.5, 2), (-1.0, 0), (float("nan"), 0), (float("inf"), 0), (None, 0), (2.4, 2)], kind="double")
    units = lambda w, b: one(spark, S.write_units, w, b, kind="long")
    assert [units(0, 9), units(1, 0), units(1, 8193), units(4, 40_000), units(2, 16_384)] == [0, 1, 2, 8, 2]
    many(spark, S.grouped, [(1234567.4, "1,234,567"), (0.5, "1")], kind="double")


def test_catalogue():
    all_ = C.sources()
    assert len(all_) == 51 and len({s["source_id"] for s in all_}) == 51 and len({s["url"] for s in all_}) == 51
    assert {s["tier"] for s in all_} == set(C.WEIGHTS) and {s["source_type"] for s in all_} <= set(C.LOOKBACK)
    assert sum(s["max_items"] == 5 for s in all_) == 6 and all(s["url"].startswith("https://") for s in all_)
    assert sorted(C.KEYWORDS) == sorted(set(C.SECTIONS) - {C.REST})


def test_native_keys_are_those_of_the_full_rules(spark):
    """Every URL that counts as clean, and every ASCII title, has the key that the full rules give."""
    import random
    import re

    r = random.Random(9)
    piece = lambda chars, n: "".join(r.choice(chars) for _ in range(r.randint(0, n)))
    urls = ["https://e.com", "http://e.com/", "https://e.com//a//", "https://e.com/a?", "https://e.com/?a&b=&=c&&utm_x=1&ref=2&REF=3#f", "https://1.2.3.4/a", "https://e.1/a", "https://e.com/.hidden/..a/..."]
    for _ in range(1500):
        urls.append(r.choice(["http", "https", "HTTP", "ftp"]) + "://" + piece("ae1-", 4) + r.choice(["e.com", "a.example.org", "e.com:443", ""]) + "/" + piece("/a.~-_A" + r.choice(["", "% é"]), 12) + r.choice(["", "?" + piece("ab=&utm_*.-" + r.choice(["", "+%~"]), 14), "#" + piece("ab=/", 5)]))
    clean = [u for u in urls if re.match(U.CLEAN_URL, u)]
    assert len(clean) > 100
    many(spark, U.url_key, [(u, U.key_of_url(u)) for u in urls])
    many(spark, S.url_key, [(u, U.key_of_url(u)) for u in clean])
    titles = [piece("aA1 -_\t.éﬁÅ", 12) for _ in range(300)] + ["A\x1cB", "a\x0bb", "\x85x"]
    many(spark, U.title_key, [(t, U.key_of_title(t)) for t in titles])
