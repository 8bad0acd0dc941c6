import itertools
import json

import pytest
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.operators import enrich as N
from tidewire.operators import views as V

NOW = 1_700_000_000_000


def entry(cve="CVE-2023-1111", added="2023-01-02", due="2023-02-01", ransom="Known", **more):
    return {"cveID": cve, "dateAdded": added, "dueDate": due, "knownRansomwareCampaignUse": ransom, **more}


def kev(spark, entries):
    return N.kev_entries(spark.createDataFrame([(json.dumps({"vulnerabilities": entries}),)], "body string"), NOW)


def test_kev_entries(spark):
    bad = [entry("CVE-1-1"), entry(added="2023-02-30"), entry(added="2021-11-02"), entry(added="2023-11-16"), entry(due=None), entry(due="x"), entry(added=20230102), "text", 7, None, entry("CVE-2023-1111\n")]
    good = [entry(), entry("CVE-2023-2222", due="", ransom="known"), entry(added="2023-05-05", ransom="Unknown"), entry("CVE-2023-3333", added="2023-11-15")]
    out = {r["cve"]: (r["added"], r["due"], r["ransomware"]) for r in N.kev_slim(kev(spark, bad + good)).collect()}
    assert out == {"CVE-2023-1111": ("2023-01-02", "2023-02-01", True), "CVE-2023-2222": ("2023-01-02", "", False), "CVE-2023-3333": ("2023-11-15", "2023-02-01", True)}


@pytest.mark.parametrize(
    ("bad", "good", "how", "want"),
    [(0, 10, {}, None), (1, 99, {}, None), (2, 99, {}, "schema drift"), (0, 9, {}, "too few"), (0, 10, {"declared": 11}, "count"), (0, 10, {"declared": 10}, None), (0, 10, {"max_slim": 50}, "too large"), (0, 0, {}, "too few")],
)
def test_kev_gate(spark, bad, good, how, want):
    rows = [entry("no")] * bad + [entry(f"CVE-2023-{1000 + k}") for k in range(good)]
    assert N.kev_gate(kev(spark, rows), min_entries=10, **how).first()["rejected"] == want


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('{"count":2,"vulnerabilities":%s}', None), ('{"count":2.0,"vulnerabilities":%s}', None), ('{"vulnerabilities":%s}', None), ('{"count":3,"vulnerabilities":%s}', "count"), ('{"count":null,"vulnerabilities":%s}', "count"),
        ('{"count":"2","vulnerabilities":%s}', "count"), ("[]", "not an object"), ("cut off", "not an object"), ('{"count":0}', "no entries"), ('{"vulnerabilities":{}}', "no entries"), ('{"vulnerabilities":[]}', "too few"),
    ],
)
def test_kev_count_is_that_of_the_body(spark, body, want):
    entry = {"dateAdded": "2023-01-01", "dueDate": "", "knownRansomwareCampaignUse": "Known"}
    entries = json.dumps([{"cveID": f"CVE-2024-100{k}", **entry} for k in range(2)])
    bodies = spark.createDataFrame([(7, body % entries if "%s" in body else body), (8, '{"count":2,"vulnerabilities":%s}' % entries)], "id int, body string")
    out = {r["id"]: r["rejected"] for r in N.kev_gate(N.kev_entries(bodies, NOW, ["id"]), N.kev_declared(bodies, ["id"]), min_entries=1, by=["id"]).collect()}
    assert out == {7: want, 8: None}



def test_body_that_is_no_catalogue(spark):
    for body in ("[]", "no json", '{"vulnerabilities":{}}', "{}"):
        assert N.kev_slim(N.kev_entries(spark.createDataFrame([(body,)], "body string"), NOW)).count() == 0


def test_epss(spark):
    ids = [f"CVE-2023-{1000 + k}" for k in range(7)]
    selected = N.epss_selected(spark.createDataFrame([(c, k + 1) for k, c in enumerate(ids)], "cve string, pos int"), cap=6, size=2)
    assert sorted((r["cve"], r["batch"]) for r in selected.collect() if r["batch"] is not None) == [(c, k // 2) for k, c in enumerate(ids[:6])]
    row = lambda c, e, d="2023-11-01": {"cve": c, "epss": e, "date": d}
    ok = lambda *data, **more: json.dumps({"status": "OK", "total": len(data), "data": list(data), **more})
    answers = spark.createDataFrame([(0, ok(row(ids[0].lower(), "1.5"), row(ids[1], "bad"))), (1, ok(row(ids[2], 0.25)))], "batch int, body string")
    out = {r["cve"]: (r["state"], r["score"]) for r in N.epss_states(selected, answers).collect()}
    assert out == {ids[0]: ("scored", 1.0), ids[1]: ("unavailable", None), ids[2]: ("scored", 0.25), ids[3]: ("no-row", None), ids[4]: ("unavailable", None), ids[5]: ("unavailable", None), ids[6]: ("unavailable", None)}
    for body in (ok(row(ids[0], "0.1"), total=2), ok(row(ids[0], "0.1"), status="NO"), ok(*[row(ids[0], "0.1")] * 3), '{"status":"OK","total":0,"data":{}}', "<html>", '{"status":"OK","total":"0","data":[]}'):
        states = N.epss_states(selected, spark.createDataFrame([(0, body)], "batch int, body string")).where("cve = 'CVE-2023-1000'").first()
        assert states["state"] == "unavailable", body
    assert N.epss_states(selected, spark.createDataFrame([(0, ok())], "batch int, body string")).where("cve = 'CVE-2023-1000'").first()["state"] == "no-row"
    twice = ok(row(ids[0], "x"), row(ids[0], "0.3"))
    assert N.epss_states(selected, spark.createDataFrame([(0, twice)], "batch int, body string")).where("cve = 'CVE-2023-1000'").first()["score"] == 0.3


ID = "CVE-2023-1234"


def record(options=(("Exploitation", "poc"), ("Automatable", "no"), ("Technical Impact", "partial")), version="2.0.3", cid=ID, meta=ID, boxes=1, metrics=1, org=C.ADP_ORG):
    content = {"id": cid, "version": version, "options": [{k: v} for k, v in options]}
    box = {"providerMetadata": {"orgId": org}, "metrics": [{"other": {"type": "ssvc", "content": content}}] * metrics + [{"cvss": 1}]}
    return {"cveMetadata": {"cveId": meta}, "containers": {"adp": [box] * boxes + [{"providerMetadata": {"orgId": "x"}}]}}


GOOD = dict(record())
CASES = [
    (record(), "assessed"), (record(org="other"), "not-assessed"), ({"cveMetadata": {"cveId": ID}, "containers": {}}, "not-assessed"), ({"cveMetadata": {"cveId": ID}, "containers": {"adp": "x"}}, "unavailable"), ({"cveMetadata": {"cveId": ID}}, "unavailable"),
    (record(meta="CVE-2023-9999"), "unavailable"), (record(cid="CVE-2023-9999"), "unavailable"), (record(version="1.0.0"), "unavailable"), (record(boxes=2), "unavailable"), (record(metrics=0), "unavailable"), (record(metrics=2), "unavailable"),
    (record(options=(("Exploitation", "maybe"), ("Automatable", "no"), ("Technical Impact", "total"))), "unavailable"), (record(options=(("Exploitation", "none"), ("Automatable", "no"))), "unavailable"),
    (record(options=(("Exploitation", "none"), ("Exploitation", "none"), ("Technical Impact", "total"))), "unavailable"), (record(options=(("Exploitation", 1), ("Automatable", "no"), ("Technical Impact", "total"))), "unavailable"), ([], "unavailable"), (None, "unavailable"),
]


def test_ssvc_records(spark):
    for body, want in CASES:
        got = N.ssvc_parsed(spark.createDataFrame([(ID, json.dumps(body))], "cve string, body string")).first()
        assert got["state"] == want, (body, want, got)
    assert N.ssvc_parsed(spark.createDataFrame([(ID, json.dumps(record()))], "cve string, body string")).first()["exploitation"] == "poc"


def test_outage_matrix(spark):
    """Whatever fails, no state is null, no id is lost, and nothing reads as a denial that wasn't one."""
    ids = spark.createDataFrame([(f"CVE-2023-{1000 + k}", k + 1) for k in range(4)], "cve string, pos int")
    slim = spark.createDataFrame([("CVE-2023-1000", "2023-01-01", "", True)], "cve string, added string, due string, ransomware boolean")
    cards = spark.createDataFrame([(1, [f"CVE-2023-{1000 + k}" for k in range(4)])], "edition_pos int, cves array<string>")
    answer = json.dumps({"status": "OK", "total": 1, "data": [{"cve": "CVE-2023-1001", "epss": "0.2", "date": "2023-01-01"}]})
    for kev_ok, epss_ok, ssvc_ok in itertools.product((True, False), repeat=3):
        kev_s = N.kev_states(ids, slim, known=kev_ok)
        epss_s = N.epss_states(N.epss_selected(ids), spark.createDataFrame([(0, answer if epss_ok else "<html>")], "batch int, body string"))
        sel = N.ssvc_selection(ids, kev_s, epss_s, cards, kev_known=kev_ok)
        parsed = N.ssvc_parsed(spark.createDataFrame([(r["cve"], '{"cveMetadata":{"cveId":"%s"},"containers":{}}' % r["cve"]) for r in sel.where("choice = 'lookup'").collect()] if ssvc_ok else [], "cve string, body string"))
        out = {r["cve"]: r for r in N.enriched(ids, kev_s, epss_s, sel, parsed).collect()}
        assert len(out) == 4
        for c, r in out.items():
            listed = c.endswith("1000")
            assert r["kev_state"] == (("listed" if listed else "not-listed") if kev_ok else "unavailable")
            assert r["epss_state"] == (("scored" if c.endswith("1001") else "no-row") if epss_ok else "unavailable")
            assert r["ssvc_state"] == ("skipped" if kev_ok and listed else "not-assessed" if ssvc_ok else "unavailable")
        h = N.health(N.enriched(ids, kev_s, epss_s, sel, parsed), "ok" if kev_ok else "unavailable").first()
        assert (h["epss_status"], h["ssvc_status"]) == ("ok" if epss_ok else "unavailable", "ok" if ssvc_ok else "unavailable")
        parts = [w for w, ok in (("KEV data unavailable", kev_ok), ("EPSS data unavailable", epss_ok), ("SSVC data unavailable", ssvc_ok)) if not ok]
        assert h["notice"] == (" · ".join(parts) or None)
    assert [N.kev_health(x, NOW) for x in (None, NOW, NOW - 72 * 3_600_000, NOW - 72 * 3_600_000 - 1, NOW + 9)] == ["unavailable", "ok", "ok", "stale", "ok"]


def test_chip_order(spark):
    rows = [("CVE-2023-0001", "listed", "2023-01-01", None, None, None), ("CVE-2023-0002", "listed", "2023-05-01", None, None, None), ("CVE-2023-0003", "not-listed", None, "poc", "scored", 0.9), ("CVE-2023-0004", "not-listed", None, "active", "scored", 0.1), ("CVE-2023-0005", "not-listed", None, None, "scored", 0.99), ("CVE-2023-0006", "not-listed", None, None, "no-row", None), ("CVE-2023-0007", "unavailable", None, "none", "unavailable", None)]
    states = spark.createDataFrame(rows, "cve string, kev_state string, added string, ssvc string, epss_state string, score double")
    cards = spark.createDataFrame([(1, [f"CVE-2023-000{k}" for k in (7, 6, 5, 4, 3, 2, 1)] + ["bad"]), (2, ["CVE-2023-0006"]), (3, [])], "edition_pos int, cves array<string>")
    out = N.chips(cards, states).orderBy("edition_pos", "chip_rank").collect()
    assert [r["cve"][-1] for r in out if r["edition_pos"] == 1] == list("2143576") and {r["overflow"] for r in out if r["edition_pos"] == 1} == {4}
    assert [r["overflow"] for r in out if r["edition_pos"] == 2] == [0] and not [r for r in out if r["edition_pos"] == 3]
    assert [r["cve"][-1] for r in N.chips(cards).where("edition_pos = 1").orderBy("chip_rank").collect()] == list("7654321")


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, ([], "all", False, False, True)), ("{", ([], "all", False, False, True)), ("[]", ([], "all", False, False, True)), ('{"sections":["Breaches","x","Breaches",1],"minImportance":"high","unreadOnly":true,"keyShortcuts":false}', (["Breaches"], "high", True, False, False)),
        ('{"sections":"Breaches","minImportance":"max","unreadOnly":1,"flaggedOnly":"true","keyShortcuts":0}', ([], "all", False, False, True)),
    ],
)
def test_prefs(spark, raw, want):
    assert tuple(V.parse_prefs(spark.createDataFrame([(1, raw)], "user_id int, prefs string")).first())[1:] == want


def test_marks(spark):
    kind = "user_id int, article_id int, kind string, at_ms long"
    marks = spark.createDataFrame([(1, 1, "read", NOW), (1, 2, "read", NOW - C.MARK_MS), (1, 3, "read", NOW + 5)], kind)
    live = V.live_marks(marks, NOW)
    assert sorted(r["article_id"] for r in live.collect()) == [1, 3]
    change = spark.createDataFrame([(1, 1, "read"), (1, 1, "read"), (1, 9, "flag")], "user_id int, article_id int, kind string")
    assert sorted(tuple(r) for r in V.toggle_marks(live, change, 7).collect()) == [(1, 3, "read", NOW + 5), (1, 9, "flag", 7)]
    assert sorted(tuple(r) for r in V.add_marks(live, change, 7).collect()) == [(1, 1, "read", NOW), (1, 3, "read", NOW + 5), (1, 9, "flag", 7)]


def test_section_plan(spark):
    rows = [(0, "A", "s")] * 9 + [(1, "B", "s")] * 8 + [(2, "C", "t")]
    out = {r["section"]: (r["visible"], r["hidden"]) for r in V.section_plan(spark.createDataFrame(rows, "section_pos int, section string, source string")).collect()}
    assert out == {"A": (6, 3), "B": (8, 0), "C": (1, 0)}


def test_toggle_section(spark):
    df = spark.createDataFrame([(["a"], "a"), ([], "b"), (["a"], "b")], "s array<string>, x string")
    assert [r[0] for r in df.select(V.toggle_section(F.col("s"), F.col("x"))).collect()] == [[], ["b"], ["a", "b"]]
