"""Queries of ingest gates, enrichment, views, logs and streams over the stand-in relations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import scalars as S
from tidewire.operators import budget as B
from tidewire.operators import edition as E
from tidewire.operators import enrich as N
from tidewire.operators import views as V
from tidewire.plans import edition_queries as Q
from tidewire.plans import standins as A
from tidewire.plans.edition_queries import LEVEL, TO_EDITION, chain, edition, rel, sources
from tidewire.plans.store import save
from tidewire.sources import feeds as I
from tidewire.sources import logs as L
from tidewire.sources import sinks as K
from tidewire.streaming import refresh as R

NOW = A.NOW_MS
DAY = 86_400_000

# ---- ingest ----

_BODIES = """SELECT d.doc_id, d.source AS source_id, CASE d.doc_id % 8 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS status,
  CASE d.doc_id % 5 WHEN 0 THEN 'text/HTML; charset=utf-8' WHEN 1 THEN 'application/json' ELSE 'application/rss+XML' END AS content_type, d.text AS body FROM {documents} d"""


#: Numbers of items that a feed covers.
FEED_ITEMS = 1000


def _feed_bodies(spark, sf) -> DataFrame:
    """Feeds of each source, each of the items of FEED_ITEMS numbers in order: RSS 2.0, RSS 1.0 and Atom by the source's number, with marked-up snippets."""
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), S.escape_xml(value), F.lit(f"</{name}>"))
    at = F.col("iso_date").cast("timestamp")
    html = F.concat(F.lit("<p class='a'>"), S.escape_xml(F.coalesce("snippet", F.lit(""))), F.lit("</p><i></i>&nbsp;"))
    rows = Q.items(spark, sf).withColumn("kind", F.substring("source_id", 4, 9).cast("int") % 3)
    own = F.concat(tag("title", F.col("title")), tag("link", F.col("link")), tag("description", html))
    rss = F.concat(F.lit("<item>"), own, tag("media:title", F.lit("other")), tag("pubDate", S.rfc822(at)), F.lit("</item>"))
    rdf = F.concat(F.lit("<item rdf:about='x'>"), own, tag("dc:date", F.col("iso_date")), F.lit("</item>"))
    link = F.concat(F.lit("<link rel='replies' href='https://e.org/r'/><link rel='alternate' href='"), S.escape_xml(F.trim("link")), F.lit("'/><link rel='edit' href='https://e.org/e'/>"))
    atom = F.concat(F.lit("<entry>"), tag("title", F.col("title")), link, tag("updated", F.col("iso_date")), tag("summary", F.lit("short")), F.lit("<content type='html'>"), S.escape_xml(html), F.lit("</content></entry>"))
    rows = rows.withColumn("item", F.when(F.col("kind") == 0, rss).when(F.col("kind") == 1, rdf).otherwise(atom))
    rows = rows.withColumn("source_id", F.concat_ws("/", "source_id", F.floor(F.col("pos") / FEED_ITEMS).cast("string")))
    body = rows.groupBy("source_id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), "").alias("items"))
    head = F.when(F.col("kind") == 0, '<rss version="2.0" xmlns:media="urn:m"><channel>').when(F.col("kind") == 1, '<rdf:RDF xmlns="http://purl.org/rss/1.0/" xmlns:rdf="urn:r" xmlns:dc="urn:d"><channel><title>c</title></channel>').otherwise('<feed xmlns="http://www.w3.org/2005/Atom">')
    tail = F.when(F.col("kind") == 0, "</channel></rss>").when(F.col("kind") == 1, "</rdf:RDF>").otherwise("</feed>")
    return body.select("source_id", F.lit("ok").alias("outcome"), F.concat(head, "items", tail).alias("body"))


def q01(spark, sf):
    """Feed items from XML of three kinds."""
    return I.items(_feed_bodies(spark, sf)).select("source_id", F.col("pos").cast("long").alias("pos"), "title", "link", "pub_date", "iso_date", "snippet")


def q02(spark, sf):
    return I.gated(rel(spark, sf, _BODIES), sources(spark, sf)).select("doc_id", "outcome")


_ANSWERS = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN CAST(NULL AS INT) WHEN 1 THEN 500 ELSE 200 END AS status, CASE event_id % 4 WHEN 0 THEN '<html>' ELSE props END AS body FROM {events}"""


def q20(spark, sf):
    return I.json_answers(rel(spark, sf, _ANSWERS), 9).select("event_id", "ok", "reason")


#: Chains of one to eight hops out of all events: of every 36 in a row the first is a chain, the next two another, and so on.
_HOPS = """SELECT event_id - (event_id % 36) + k AS chain, CAST(event_id % 36 - k * (k + 1) / 2 AS INT) AS hop,
  CASE WHEN event_id % 37 = 0 THEN 'http://a.example.com/x' WHEN event_id % 41 = 0 THEN 'https://b.example.com/' ELSE 'https://A.example.com/' || CAST(event_id AS STRING) END AS url
  FROM (SELECT event_id, CAST(floor((sqrt(8 * (event_id % 36) + 1) - 1) / 2) AS INT) AS k FROM {events})"""


def q20b(spark, sf):
    return I.redirect_ok(rel(spark, sf, _HOPS))


# ---- enrichment ----

#: Entries of a catalogue.
KEV_ENTRIES = 500


def _kev_bodies(spark, sf) -> DataFrame:
    """Catalogues with the entries of all parts, KEV_ENTRIES each. Some ids, days and due days are bad, some ids come twice, and the declared count is right, absent, wrong or null."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    k, c = F.col("p_partkey"), F.floor(F.col("p_partkey") / KEV_ENTRIES)
    bad = c % 3 != 1
    entry = F.struct(
        F.when(bad & (k % 97 == 0), F.concat(F.lit("CVE-24-"), k.cast("string"))).otherwise(F.concat(F.lit("CVE-2024-"), (F.lit(10000) + k - k % 7 % 2).cast("string"))).alias("cveID"),
        F.when(bad & (k % 89 == 0), "2024-02-30").otherwise(F.concat(F.lit("2023-"), F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("dateAdded"),
        F.when(k % 3 == 0, "").otherwise("2024-03-01").alias("dueDate"), F.when(k % 2 == 0, "Known").otherwise("Unknown").alias("knownRansomwareCampaignUse"),
    )
    lists = part.select(c.alias("catalogue"), k.alias("k"), F.to_json(entry).alias("e")).groupBy("catalogue").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda x: x["e"]), ",").alias("list"), F.count("*").alias("n"))
    kind, n = F.col("catalogue") % 4, F.col("n").cast("string")
    count = F.when(kind == 0, F.concat(F.lit('"count":'), n, F.lit(","))).when(kind == 1, "").when(kind == 2, F.concat(F.lit('"count":'), (F.col("n") + 1).cast("string"), F.lit(","))).otherwise('"count":null,')
    return lists.select("catalogue", F.concat(F.lit("{"), count, F.lit('"vulnerabilities":['), "list", F.lit("]}")).alias("body"))


def q21(spark, sf):
    return N.kev_slim(N.kev_entries(_kev_bodies(spark, sf), NOW, ["catalogue"]), ["catalogue"])


def q21g(spark, sf):
    """The gate of each catalogue: counts and why it is rejected."""
    bodies = _kev_bodies(spark, sf)
    return N.kev_gate(N.kev_entries(bodies, NOW, ["catalogue"]), N.kev_declared(bodies, ["catalogue"]), min_entries=450, max_slim=1 << 30, by=["catalogue"]).select("catalogue", "n", "valid", "skipped", "rejected")


_KEV_SQL = f"""
e AS (SELECT p_partkey AS k, p_partkey // {KEV_ENTRIES} AS catalogue, CASE WHEN p_partkey // {KEV_ENTRIES} % 3 <> 1 AND p_partkey % 97 = 0 THEN 'CVE-24-' || p_partkey ELSE 'CVE-2024-' || (10000 + p_partkey - p_partkey % 7 % 2) END AS cve,
  CASE WHEN p_partkey // {KEV_ENTRIES} % 3 <> 1 AND p_partkey % 89 = 0 THEN '2024-02-30' ELSE '2023-' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') END AS added,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '2024-03-01' END AS due, p_partkey % 2 = 0 AS ransomware FROM part),
v AS (SELECT *, regexp_full_match(cve, 'CVE-[0-9]{{4}}-[0-9]{{4,7}}') AND try_cast(added AS DATE) IS NOT NULL AS valid FROM e),
s AS (SELECT catalogue, cve, arg_min(added, k) AS added, arg_min(due, k) AS due, arg_min(ransomware, k) AS ransomware FROM v WHERE valid GROUP BY catalogue, cve)
"""


def _ids(spark, sf) -> DataFrame:
    """Ids of an edition stand-in: the first appearance of the ids that the documents' numbers make."""
    return rel(spark, sf, "SELECT cve, CAST(row_number() OVER (ORDER BY p) AS INT) AS pos FROM (SELECT 'CVE-2024-' || CAST(10000 + (doc_id * 7) % 900 AS STRING) AS cve, min(doc_id) AS p FROM {documents} GROUP BY 1)")


_IDS = "ids AS (SELECT cve, row_number() OVER (ORDER BY p) AS pos FROM (SELECT 'CVE-2024-' || (10000 + (doc_id * 7) % 900)::VARCHAR AS cve, min(doc_id) AS p FROM documents GROUP BY 1))"


def _epss_answers(spark, sf, selected: DataFrame) -> DataFrame:
    """Answers to the batches: every fourth is malformed; ids without a score have no row, some scores are invalid."""
    scores = rel(spark, sf, A.EPSS)
    row = F.struct(F.lower("cve").alias("cve"), F.when(F.substring("cve", -1, 1) == "7", "n/a").otherwise(F.format_string("%.4f", F.col("score"))).alias("epss"), F.col("day").alias("date"))
    got = selected.where("batch is not null").join(scores, "cve", "left").groupBy("batch").agg(F.collect_list(F.when(F.col("score").isNotNull(), row)).alias("data"))
    status = F.when(F.col("batch") % 4 == 3, "ERR").otherwise("OK")
    return got.select("batch", F.to_json(F.struct(status.alias("status"), F.size("data").alias("total"), "data")).alias("body"))


def _epss(spark, sf) -> DataFrame:
    selected = N.epss_selected(_ids(spark, sf))
    return N.epss_states(selected, _epss_answers(spark, sf, selected))


_EPSS_SQL = f"""
{_IDS}, es AS ({A.duck_sql(A.EPSS)}), ks AS ({A.duck_sql(A.KEV)}), vs AS ({A.duck_sql(A.SSVC)}),
b AS (SELECT cve, pos, CASE WHEN pos <= 500 THEN (row_number() OVER (PARTITION BY pos <= 500 ORDER BY cve) - 1) // 50 END AS batch FROM ids),
epss AS (SELECT b.cve, CASE WHEN batch IS NULL OR batch % 4 = 3 OR (score IS NOT NULL AND right(b.cve, 1) = '7') THEN 'unavailable' WHEN score IS NOT NULL THEN 'scored' ELSE 'no-row' END AS state, score, day FROM b LEFT JOIN es USING (cve)),
kev AS (SELECT i.cve, CASE WHEN k.cve IS NULL THEN 'not-listed' ELSE 'listed' END AS state, added, ransomware FROM ids i LEFT JOIN ks k USING (cve))
"""


def q22(spark, sf):
    return _epss(spark, sf)


def _cards(spark, sf) -> DataFrame:
    """Cards with several ids each, some of them malformed."""
    return rel(spark, sf, "SELECT doc_id AS edition_pos, array('CVE-2024-' || CAST(10000 + (doc_id * 7) % 900 AS STRING), 'CVE-2024-' || CAST(10000 + (doc_id * 7 + 455) % 900 AS STRING), 'CVE-24-1', 'CVE-2024-' || CAST(10000 + (doc_id * 7 + 91) % 900 AS STRING), 'CVE-2024-' || CAST(10000 + (doc_id * 7 + 630) % 900 AS STRING), 'CVE-2024-' || CAST(10000 + (doc_id * 7 + 14) % 900 AS STRING)) AS cves FROM {documents}")


_CARDS = "cards AS (SELECT doc_id AS e, unnest([0, 455, 91, 630, 14]) AS d, unnest([0, 1, 3, 4, 5]) AS p FROM documents), seen AS (SELECT e, p, 'CVE-2024-' || (10000 + (e * 7 + d) % 900)::VARCHAR AS cve FROM cards)"
_PRE = f"""{_EPSS_SQL}, {_CARDS},
pre0 AS (SELECT kev.cve, kev.state AS ks, added, epss.state AS es, CASE WHEN epss.state = 'scored' THEN score END AS sc FROM kev JOIN epss USING (cve)),
pre1 AS (SELECT s.e, s.cve, row_number() OVER (PARTITION BY s.e ORDER BY (CASE WHEN ks = 'listed' THEN 0 ELSE 1 END), CASE WHEN ks = 'listed' THEN added END DESC NULLS LAST, sc DESC NULLS LAST, p) AS r FROM seen s LEFT JOIN pre0 USING (cve)),
vis AS (SELECT DISTINCT cve FROM pre1 WHERE r <= 3),
sel AS (SELECT cve, 'skipped' AS choice, NULL AS priority FROM pre0 WHERE ks = 'listed' UNION ALL
  SELECT cve, CASE WHEN r <= 100 THEN 'lookup' ELSE 'overflow' END, r FROM (SELECT cve, row_number() OVER (ORDER BY (vis.cve IS NOT NULL) DESC, sc DESC NULLS LAST, pre0.cve) AS r FROM pre0 LEFT JOIN vis USING (cve) WHERE ks <> 'listed')),
ssvc AS (SELECT s.cve, CASE s.choice WHEN 'skipped' THEN 'skipped' WHEN 'overflow' THEN 'unavailable' ELSE CASE WHEN v.exploitation IS NOT NULL THEN 'assessed' WHEN CAST(right(s.cve, 2) AS INT) % 3 = 0 THEN 'unavailable' ELSE 'not-assessed' END END AS state, v.exploitation FROM sel s LEFT JOIN vs v USING (cve)),
states AS (SELECT pre0.cve, ks AS kev_state, CASE WHEN ks = 'listed' THEN added END AS added, es AS epss_state, sc AS score, ssvc.state AS ssvc_state, CASE WHEN ssvc.state = 'assessed' THEN exploitation END AS ssvc FROM pre0 JOIN ssvc USING (cve))
"""


def _ssvc_records(spark, sf, looked: DataFrame) -> DataFrame:
    """Records of looked-up ids: with an assessment, without one, or malformed."""
    known = looked.join(rel(spark, sf, A.SSVC), "cve", "left")
    content = F.concat(F.lit('{"id":"'), F.col("cve"), F.lit('","version":"2.0.3","options":[{"Exploitation":"'), F.col("exploitation"), F.lit('"},{"Automatable":"yes"},{"Technical Impact":"total"}]}'))
    box = F.concat(F.lit(f'{{"providerMetadata":{{"orgId":"{C.ADP_ORG}"}},"metrics":[{{"other":{{"type":"ssvc","content":'), content, F.lit("}}]}"))
    odd = F.substring("cve", -2, 2).cast("int") % 3 == 0
    adp = F.when(F.col("exploitation").isNotNull(), F.concat(F.lit(',"adp":['), box, F.lit("]"))).when(odd, ',"adp":"none"').otherwise(',"adp":[{"providerMetadata":{"orgId":"other"}}]')
    return known.select("cve", F.concat(F.lit('{"cveMetadata":{"cveId":"'), F.col("cve"), F.lit('"},"containers":{"cna":{}'), adp, F.lit("}}")).alias("body"))


def _stages(spark, sf):
    ids, kev, epss = _ids(spark, sf), N.kev_states(_ids(spark, sf), rel(spark, sf, A.KEV)), save(_epss(spark, sf), "epss")
    selection = save(N.ssvc_selection(ids, kev, epss, _cards(spark, sf)), "selection")
    parsed = N.ssvc_parsed(_ssvc_records(spark, sf, selection.where("choice = 'lookup'").select("cve")))
    return ids, kev, epss, selection, parsed


def states(spark, sf) -> DataFrame:
    ids, kev, epss, selection, parsed = _stages(spark, sf)
    return N.enriched(ids, kev, epss, selection, parsed)


def q23(spark, sf):
    ids, kev, epss, selection, parsed = _stages(spark, sf)
    return selection.join(parsed.select("cve", "state"), "cve", "left").select("cve", "choice", "priority", F.when(F.col("choice") == "lookup", F.coalesce("state", F.lit("unavailable"))).otherwise(F.when(F.col("choice") == "skipped", "skipped").otherwise("unavailable")).alias("state"))


def q24(spark, sf):
    return states(spark, sf)


def q25(spark, sf):
    return N.health(states(spark, sf), N.kev_health(NOW - 80 * 3_600_000, NOW), NOW - 80 * 3_600_000)


def q26(spark, sf):
    return N.chips(_cards(spark, sf), states(spark, sf)).where(F.col("chip_rank") <= C.CHIPS).select("edition_pos", "chip_rank", "cve", S.nvd_url("cve").alias("href"), "overflow", "kev", "strong")


# ---- views ----

def q30(spark, sf):
    return V.feed_items(edition(spark, sf), V.feeds_df(spark)).select("slug", "feed_rank", "id", S.feed_path("slug", "xml").alias("path"))


_SITE = ("https://news.example.org", "Tidewire", "Security news in sections")


def q31(spark, sf):
    """RSS text of each feed."""
    return K.rss(V.feed_items(edition(spark, sf), V.feeds_df(spark)), sources(spark, sf), NOW, *_SITE)


def q32(spark, sf):
    """JSON Feed text of each feed."""
    return K.json_feed(V.feed_items(edition(spark, sf), V.feeds_df(spark)), NOW, *_SITE)


def feeds(spark, sf) -> tuple[DataFrame, DataFrame]:
    """RSS and JSON Feed texts of each feed, of one edition."""
    items = save(V.feed_items(edition(spark, sf), V.feeds_df(spark)), "feed-items")
    return K.rss(items, sources(spark, sf), NOW, *_SITE), K.json_feed(items, NOW, *_SITE)


def q33(spark, sf):
    return V.section_plan(edition(spark, sf))


def _articles(spark, sf) -> DataFrame:
    """Articles for readers: the importance and section of every document, by its numbers."""
    return rel(spark, sf, "SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'high' ELSE 'normal' END AS importance, CASE doc_id % 3 WHEN 0 THEN 'Vulnerabilities' WHEN 1 THEN 'Breaches' ELSE 'Advisories' END AS section FROM {documents}")


_ARTICLES = "art AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS lv, CASE doc_id % 3 WHEN 0 THEN 'Vulnerabilities' WHEN 1 THEN 'Breaches' ELSE 'Advisories' END AS section FROM documents)"
_PREFS = """SELECT user_id, CASE user_id % 6 WHEN 0 THEN '{{"minImportance":"high","unreadOnly":true}}' WHEN 1 THEN '{{"sections":["Breaches","Nowhere","Breaches",7],"flaggedOnly":true}}' WHEN 2 THEN 'not json' WHEN 3 THEN '{{"minImportance":"loud","unreadOnly":"yes","keyShortcuts":false}}' WHEN 4 THEN '{{"sections":["Advisories","Vulnerabilities"],"minImportance":"critical"}}' END AS prefs FROM (SELECT DISTINCT user_id FROM {events})"""
_PREFS_SQL = """prefs AS (SELECT user_id, CASE user_id % 6 WHEN 0 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS lv0, user_id % 6 = 0 AS un, user_id % 6 = 1 AS fl, user_id % 6 <> 3 AS ks, CASE user_id % 6 WHEN 1 THEN ['Breaches'] WHEN 4 THEN ['Advisories', 'Vulnerabilities'] ELSE [] END AS sections FROM (SELECT DISTINCT user_id FROM events))"""


def _reader_view(spark, sf) -> DataFrame:
    """What each reader's marks and preferences make of the articles with which they had to do: all that they marked."""
    marks = V.live_marks(rel(spark, sf, A.MARKS).withColumnRenamed("article", "article_id"), NOW)
    seen = marks.select("user_id", F.col("article_id").alias("id")).distinct().join(_articles(spark, sf), "id")
    return V.with_marks(seen, marks).join(V.parse_prefs(rel(spark, sf, _PREFS)), "user_id")


_VIEW = f"""{_ARTICLES}, {_PREFS_SQL}, m AS ({A.duck_sql(A.MARKS)}), lm AS (SELECT * FROM m WHERE {NOW} - at_ms < {C.MARK_MS}),
mm AS (SELECT user_id, article, bool_or(kind = 'read') AS r, bool_or(kind = 'flag') AS f FROM lm GROUP BY ALL),
vw AS (SELECT mm.user_id, id, lv, section, r, f, lv0, un, fl, sections, lv >= lv0 AND (NOT un OR NOT r) AND (NOT fl OR f) AS ok FROM mm JOIN art ON art.id = mm.article JOIN prefs USING (user_id))"""


def _min_rank():
    return F.when(F.col("min_importance") == "critical", 2).when(F.col("min_importance") == "high", 1).otherwise(0)


def q34(spark, sf):
    rows = _reader_view(spark, sf)
    return rows.where(V.visible(_min_rank(), F.col("unread_only"), F.col("flagged_only")) & V.section_selected(F.col("sections"))).select("user_id", "id", "section")


def q35(spark, sf):
    ok = V.visible(_min_rank(), F.col("unread_only"), F.col("flagged_only"))
    rows = _reader_view(spark, sf).groupBy("user_id", "section").agg(F.count_if(ok).alias("n"), F.any_value("min_importance").alias("min_importance"), F.any_value("unread_only").alias("unread_only"), F.any_value("flagged_only").alias("flagged_only"), F.any_value("sections").alias("sections"))
    kept = rows.where((F.col("n") > 0) | ~V.has_filters(F.col("min_importance"), F.col("unread_only"), F.col("flagged_only")))
    out = kept.groupBy("user_id").agg(F.sum("n").alias("n"), F.count("*").alias("shown"), F.max(F.size("sections")).alias("selected"))
    return out.select("user_id", "n", S.count_label("n").alias("label"), S.status_message("selected", "shown").alias("message"))


def q36(spark, sf):
    ok = V.visible(_min_rank(), F.col("unread_only"), F.col("flagged_only"))
    level = S.importance_rank("importance")
    return _reader_view(spark, sf).groupBy("user_id").agg(F.count("*").alias("n_all"), F.count_if(level >= 1).alias("n_high"), F.count_if(level >= 2).alias("n_critical"), F.count_if(~F.col("is_read")).alias("unread"), F.count_if("is_flagged").alias("flagged"), F.count_if(ok).alias("shown"), F.count_if(ok & ~F.col("is_read")).alias("shown_unread"))


def q37(spark, sf):
    p = V.parse_prefs(rel(spark, sf, _PREFS))
    return p.select("user_id", F.array_join("sections", ",").alias("sections"), "min_importance", "unread_only", "flagged_only", "key_shortcuts", F.array_join(V.toggle_section(F.col("sections"), F.lit("Breaches")), ",").alias("toggled"))


def q38(spark, sf):
    marks = V.live_marks(rel(spark, sf, A.MARKS).withColumnRenamed("article", "article_id"), NOW)
    change = rel(spark, sf, "SELECT user_id, event_id % 97 AS article_id, 'read' AS kind FROM {events} WHERE event_type = 'view'")
    return V.add_marks(V.toggle_marks(marks, change, NOW), change, NOW + 1)


def q39(spark, sf):
    """Union, intersection and difference of readers who read and who flag."""
    m = rel(spark, sf, A.MARKS)
    a, b = m.where("kind = 'read'").select("user_id", "article"), m.where("kind = 'flag'").select("user_id", "article")
    parts = [(a.union(b).distinct(), "union"), (a.intersect(b), "intersect"), (a.join(b, ["user_id", "article"], "left_anti").distinct(), "except"), (a.unionAll(b), "union_all")]
    out = None
    for df, name in parts:
        one = df.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("op", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# ---- logs ----

def _budget(spark, sf) -> DataFrame:
    return rel(spark, sf, A.BUDGET)


def _messages(spark, sf) -> DataFrame:
    rows = _budget(spark, sf)
    st = F.when(F.col("pos") % 3 == 0, "assessed").when(F.col("pos") % 3 == 1, "not-assessed").otherwise("odd")
    return rows.withColumn("message", L.format_line(F.col("p"), F.col("ok"), {k: F.col(k) for k in C.BUDGET_KEYS[2:]}, st))


def _log_lines(spark, sf) -> DataFrame:
    """Records as the platform's tool prints them: every eleventh is of another type, every thirteenth has keys in another order."""
    m = F.when(F.col("pos") % 13 == 0, F.replace("message", F.lit('"ok":1,"ms"'), F.lit('"ms":1,"ok"'))).otherwise(F.col("message"))
    at = F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    data = F.struct(at.alias("timestamp"), F.concat(F.lit("r"), F.col("pos").cast("string")).alias("requestId"), F.concat(F.lit("/p"), (F.col("pos") % 3).cast("string"), F.lit("?q=secret")).alias("requestPath"), m.alias("message"))
    kind = F.when(F.col("pos") % 11 == 0, "request").otherwise("log")
    return _messages(spark, sf).select(F.to_json(F.struct(kind.alias("type"), data.alias("data"))).alias("value"))


def q40(spark, sf):
    r = L.runtime_rows(_log_lines(spark, sf))
    return r.select("ts", "rid", "path", "dep", *(F.col(f"line.{k}").alias(k) for k in C.BUDGET_KEYS), F.col("line.st").alias("st"))


_LINE = f"""ln AS (SELECT *, CASE WHEN p = 'ssvc' THEN CASE pos % 3 WHEN 0 THEN 'assessed' WHEN 1 THEN 'not-assessed' ELSE 'failed' END END AS st FROM ({A.duck_sql(A.BUDGET)}))"""


def _req(spark, sf) -> DataFrame:
    """Request rows from orders of customers: feed paths and cache results."""
    return rel(spark, sf, "SELECT e.event_id AS pos, CASE e.event_id % 5 WHEN 0 THEN '/feed.xml' WHEN 1 THEN '/feed/all.json' WHEN 2 THEN '/feeds' ELSE '/' END AS path, CASE e.event_id % 4 WHEN 0 THEN 'STALE' WHEN 1 THEN 'miss' ELSE 'HIT' END AS cache FROM {events} e WHERE e.event_type = 'purchase'")


def keyed_rows(spark, sf) -> DataFrame:
    return _messages(spark, sf).select(F.col("pos"), L.row_key(F.lit("budget"), (F.col("pos") % 400).cast("string"), F.col("p"), (F.col("pos") % 7).cast("string")).alias("key"))


def q41(spark, sf):
    rows = keyed_rows(spark, sf)
    seen = rows.where("pos < 50").select("key")
    return B.take_new(rows.withColumn("key", F.when(F.col("pos") % 100 != 99, F.col("key"))), seen)


def q42(spark, sf):
    return _messages(spark, sf).withColumn("back", L.parse_line(F.col("message"))).select("pos", "message", F.col("back.bytes").alias("bytes"), F.col("back.st").alias("st"), B.render_reads(F.col("n") * 3, F.col("bytes") % 700).alias("reads"), B.valid_capture(F.col("n"), F.col("rcR")).alias("valid"))


def q43(spark, sf):
    return B.islands(rel(spark, sf, A.POLLS), (NOW - 20 * DAY, NOW - 5 * DAY))


def q43c(spark, sf):
    polls = rel(spark, sf, A.POLLS)
    return B.coverage(polls).join(B.default_period(polls).hint("broadcast")).select(F.round("covered_min", 6).alias("covered_min"), F.round("period_min", 6).alias("period_min"), "from_ms", "to_ms")


def q44(spark, sf):
    s = B.producer_stats(_budget(spark, sf))
    all_units = s.where("p <> 'render'").agg(F.sum("units").alias("all_units"))
    return s.join(all_units.hint("broadcast")).select("p", "lines", "ok", "fail", "rcw", "units", "median_bytes", "cpu_ms", F.round(F.col("units") / F.col("all_units") * 100, 1).alias("split_pct"), B.meter_status(F.col("units"), F.lit(43200.0), F.lit(9000)).alias("status"))


def q44r(spark, sf):
    return B.read_units(_budget(spark, sf), _req(spark, sf))


def q45(spark, sf):
    """Lines of the report."""
    lines = B.report(_budget(spark, sf), _req(spark, sf), rel(spark, sf, A.POLLS), {"writes": 200_000, "reads": 1_000_000, "cpu_s": 14_400}, least=0.0)
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


def _capture_rows(spark, sf) -> DataFrame:
    """Rows of overlapping polls: each comes again in the next one."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("at"), F.sha1(F.concat_ws("|", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("user_id").cast("string"))).alias("key"), "event_type")
    return ev.unionByName(ev)


def q46(spark, sf):
    out = R.run_capture(spark, _capture_rows(spark, sf))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"))


def q46g(spark, sf):
    return B.missed_polls(rel(spark, sf, A.POLLS), 30 * 60_000)


def q47(spark, sf):
    """The edition renewed by a stream of items."""
    feed = sources(spark, sf)
    compose = lambda batch: E.admitted(E.compose(E.source_window(E.normalize(batch, feed), NOW), NOW))
    return R.run_refresh(spark, Q.items(spark, sf), compose).select("edition_pos", "section", "id")


def q48(spark, sf):
    """Counts by windows of 15 minutes."""
    return R.windowed_counts(spark.read.parquet(f"{sf}/events.parquet")).select(F.unix_millis("window_start").alias("window_ms"), "event_type", "n")


def q49(spark, sf):
    """Counts over all combinations of section, importance and type of source."""
    ed = edition(spark, sf)
    return ed.cube("section", "importance", "source_type").agg(F.count("*").alias("n")).select(F.coalesce("section", F.lit("*")).alias("section"), F.coalesce("importance", F.lit("*")).alias("importance"), F.coalesce("source_type", F.lit("*")).alias("source_type"), "n")


def q22u(spark, sf):
    """Request URLs of the batches."""
    return N.epss_urls(N.epss_selected(_ids(spark, sf)), "https://scores.example.org/epss")


def q38s(spark, sf):
    """Marks after every reader marks what is shown as read."""
    marks = V.live_marks(rel(spark, sf, A.MARKS).withColumnRenamed("article", "article_id"), NOW)
    ok = V.visible(_min_rank(), F.col("unread_only"), F.col("flagged_only")) & V.section_selected(F.col("sections"))
    return V.mark_shown(_reader_view(spark, sf), marks, ok, NOW + 2)


def q41r(spark, sf):
    """Rows of a capture file by kind and validity; every ninth line is cut off, every seventh of an unknown kind."""
    at = F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    k = F.when(F.col("pos") % 7 == 0, "other").otherwise("budget")
    row = F.concat(F.lit('{"k":"'), k, F.lit('","ts":"'), at, F.lit('","rid":"r","path":"/","dep":"d","line":'), F.substr("message", F.lit(8)), F.lit("}"))
    lines = _messages(spark, sf).select(F.when(F.col("pos") % 9 == 0, F.left(row, F.lit(30))).otherwise(row).alias("value"))
    return L.read_rows(lines).groupBy(F.coalesce("k", F.lit("-")).alias("k"), "valid").agg(F.count("*").alias("n"))


GAPS = """SELECT 'capture' AS stream, CAST({epoch} AS BIGINT) * 1000 - 600000 AS from_ms, CAST({epoch} AS BIGINT) * 1000 + event_id % 7 AS to_ms, event_id % 5 <> 0 AS ok, CASE WHEN event_id % 10 = 0 THEN 'timeout' END AS failure, event_id % 11 = 0 AS truncated, event_id % 13 = 0 AS ex, event_id FROM {events} e WHERE event_type = 'error'"""


def q46p(spark, sf):
    """What a capture couldn't read."""
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    one = F.array(F.struct((F.col("from_ms") + 5).alias("start"), F.lit(None).cast("long").alias("end")))
    polls = rel(spark, sf, GAPS).withColumn("excluded", F.when(F.col("ex"), one).otherwise(none))
    return B.gap_rows(polls, 600_000, 60_000)


QUERIES = {
    "q22_epss_urls": q22u, "q38_mark_shown": q38s, "q41_read_rows": q41r, "q46_gap_rows": q46p,
    "q01_feed_items": q01, "q02_body_gates": q02, "q20_json_gate": q20, "q20_redirects": q20b, "q21_kev": q21, "q21_kev_gate": q21g, "q22_epss": q22, "q23_ssvc": q23, "q24_enrichment": q24, "q25_health": q25, "q26_chips": q26,
    "q30_feed_scope": q30, "q31_rss": q31, "q32_json_feed": q32, "q33_section_plan": q33, "q34_visible": q34, "q35_visible_counts": q35, "q36_reader_counts": q36, "q37_prefs": q37, "q38_marks": q38, "q39_set_operations": q39,
    "q40_log_rows": q40, "q41_take_new": q41, "q42_budget_line": q42, "q43_islands": q43, "q43_coverage": q43c, "q44_producers": q44, "q44_reads": q44r, "q45_report": q45, "q46_capture": q46, "q46_missed_polls": q46g, "q47_refresh": q47, "q48_windows": q48, "q49_cube": q49,
}

_UNITS = "CASE WHEN rcW = 0 THEN 0 ELSE rcW * greatest(1, ceil(bytes / rcW / 8192.0)) END"


def _esc(x: str) -> str:
    """Text for XML."""
    out = f"regexp_replace({x}, '[^\\x09\\x0A\\x0D\\x20-\\x{{D7FF}}\\x{{E000}}-\\x{{FFFD}}\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


_RFC = "strftime(make_timestamp({ms} * 1000), '%a, %d %b %Y %H:%M:%S GMT')"
_ISO = "strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(({ms} % 1000)::VARCHAR, 3, '0') || 'Z'"
_NAMES = ", ".join(f"({k}, '{slug}', '{title}', {'NULL' if low is None else low}, {'NULL' if sec is None else repr(sec)})" for k, (slug, title, low, sec) in enumerate(V.feeds()))
_FEEDS = f"""fd(k, slug, feed_title, low, sec) AS (VALUES {_NAMES}),
fi AS (SELECT slug, feed_title, CASE slug WHEN 'all' THEN 'security news' ELSE feed_title END AS said, ed.*, row_number() OVER (PARTITION BY slug ORDER BY published_ms DESC, edition_pos) AS feed_rank FROM ed JOIN fd ON CASE WHEN sec IS NOT NULL THEN sec = section ELSE {LEVEL} >= coalesce(low, 0) END),
su AS (SELECT name, url AS source_url FROM src)"""
_LINE6 = "chr(10) || '      "
_RSS = f"""SELECT slug, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:tw="{K.NAMESPACE}">' || chr(10) || '  <channel>' || chr(10) || '    <title>{_SITE[1]}: ' || {_esc('any_value(said)')} || '</title>' || chr(10)
  || '    <link>{_SITE[0]}/</link>' || chr(10) || '    <description>{_SITE[2]}</description>' || chr(10) || '    <language>en</language>' || chr(10) || '    <atom:link href="{_SITE[0]}' || CASE slug WHEN 'all' THEN '/feed' ELSE '/feed/' || slug END || '.xml" rel="self" type="application/rss+xml"/>' || chr(10)
  || '    <lastBuildDate>' || {_RFC.format(ms=NOW)} || '</lastBuildDate>' || chr(10) || '    <ttl>15</ttl>' || chr(10) || '    <generator>{_SITE[1]}</generator>' || chr(10) || string_agg(item, chr(10) ORDER BY feed_rank) || chr(10) || '  </channel>' || chr(10) || '</rss>' || chr(10) AS body FROM (
SELECT slug, said, feed_rank, '    <item>' || {_LINE6}<title>' || {_esc('title')} || '</title>' || {_LINE6}<link>' || {_esc('url')} || '</link>' || {_LINE6}<guid isPermaLink="true">' || {_esc('url')} || '</guid>' || {_LINE6}<pubDate>' || {_RFC.format(ms='published_ms')} || '</pubDate>'
  || CASE WHEN summary <> '' THEN {_LINE6}<description>' || {_esc('summary')} || '</description>' ELSE '' END || {_LINE6}<source url="' || {_esc('source_url')} || '">' || {_esc('source')} || '</source>' || {_LINE6}<category domain="{K.NAMESPACE}/section">' || {_esc('section')} || '</category>'
  || {_LINE6}<category domain="{K.NAMESPACE}/importance">' || importance || '</category>' || array_to_string(list_transform(cves, lambda c: {_LINE6}<category domain="https://nvd.nist.gov/vuln/detail">' || c || '</category>'), '') || {_LINE6}<tw:importance>' || importance || '</tw:importance>'
  || CASE WHEN importance_reason IS NOT NULL THEN {_LINE6}<tw:reason>' || {_esc('importance_reason')} || '</tw:reason>' ELSE '' END || {_LINE6}<tw:section>' || {_esc('section')} || '</tw:section>' || {_LINE6}<tw:sourceTier>' || {_esc('tier')} || '</tw:sourceTier>' || {_LINE6}<tw:sourceType>' || source_type || '</tw:sourceType>'
  || array_to_string(list_transform(cves, lambda c: {_LINE6}<tw:cve>' || c || '</tw:cve>'), '') || chr(10) || '    </item>' AS item FROM fi JOIN su ON su.name = fi.source) GROUP BY slug"""
_J = "to_json({0})::VARCHAR"
_JSON = f"""SELECT slug, '{{"version":"https://jsonfeed.org/version/1.1","title":' || {_J.format(f"'{_SITE[1]}: ' || any_value(said)")} || ',"home_page_url":"{_SITE[0]}/","feed_url":"{_SITE[0]}' || CASE slug WHEN 'all' THEN '/feed' ELSE '/feed/' || slug END || '.json","description":"{_SITE[2]}","language":"en","_tidewire":{{"about":"{_SITE[0]}/feeds","generated_at":"' || {_ISO.format(ms=NOW)}
  || '","refresh_seconds":900,"scope":"' || slug || '"}},"items":[' || string_agg(item, ',' ORDER BY feed_rank) || ']}}' AS body FROM (
SELECT slug, said, feed_rank, '{{"id":' || {_J.format('url')} || ',"url":' || {_J.format('url')} || ',"title":' || {_J.format('title')} || CASE WHEN summary <> '' THEN ',"summary":' || {_J.format('summary')} || ',"content_text":' || {_J.format('summary')} ELSE ',"content_text":' || {_J.format('title')} END
  || ',"date_published":"' || {_ISO.format(ms='published_ms')} || '","authors":[{{"name":' || {_J.format('source')} || '}}],"tags":' || {_J.format("list_concat([section, importance], cves)")} || ',"_tidewire":{{"source":' || {_J.format('source')} || ',"source_tier":' || {_J.format('tier')} || ',"source_type":' || {_J.format('source_type')} || ',"section":' || {_J.format('section')}
  || ',"importance":' || {_J.format('importance')} || ',"importance_reason":' || coalesce({_J.format('importance_reason')}, 'null') || ',"cves":' || {_J.format('cves')} || '}}}}' AS item FROM fi) GROUP BY slug"""
_ITEMS01 = f"""WITH items AS ({A.duck_sql(A.ITEMS)}), x AS (SELECT *, CAST(substr(source_id, 4) AS INT) % 3 AS kind, row_number() OVER (PARTITION BY source_id, pos // {FEED_ITEMS} ORDER BY pos) - 1 AS nth FROM items)
SELECT source_id || '/' || pos // {FEED_ITEMS} AS source_id, nth AS pos, trim(title) AS title, trim(link) AS link, CASE WHEN kind = 0 THEN {_RFC.format(ms='published_ms')} END AS pub_date, CASE WHEN kind > 0 THEN {_ISO.format(ms='published_ms')} END AS iso_date, {Q._trim("coalesce(snippet, '')")} AS snippet FROM x"""
_REPORT = f"""WITH b AS ({A.duck_sql(A.BUDGET)}), s0 AS (SELECT p, count(*) AS lines, count_if(ok = 1) AS ok, count_if(ok = 0) AS fail, sum(rcW)::BIGINT AS rcw, sum({_UNITS})::BIGINT AS units, coalesce(ceil(quantile_cont(bytes, 0.5) FILTER (WHERE ok = 1)), 0)::BIGINT AS mb, sum(cpuMs)::BIGINT AS cpu FROM b GROUP BY p),
ps(k, p) AS (VALUES {', '.join(f"({k}, '{p}')" for k, p in enumerate(C.PRODUCERS))}), s AS (SELECT k, p, coalesce(lines, 0) AS lines, coalesce(ok, 0) AS ok, coalesce(fail, 0) AS fail, coalesce(rcw, 0) AS rcw, coalesce(units, 0) AS units, coalesce(mb, 0) AS mb, coalesce(cpu, 0) AS cpu FROM ps LEFT JOIN s0 USING (p)),
w AS (SELECT * FROM ({A.duck_sql(A.POLLS)}) WHERE ok), o AS (SELECT from_ms AS s, to_ms AS e, max(to_ms) OVER (ORDER BY from_ms, to_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM w WHERE to_ms > from_ms), i AS (SELECT s, e, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o),
c AS (SELECT (SELECT sum(d) FROM (SELECT max(e) - min(s) AS d FROM i GROUP BY k)) / 60000.0 AS c, (greatest(max(to_ms), min(from_ms) + 86400000) - min(from_ms)) / 60000.0 AS w FROM w),
m AS (SELECT ceil(ceil(quantile_cont(bytes, 0.5) FILTER (WHERE ok = 1 AND p = 'edition')) / 8192.0) AS ed, ceil(ceil(quantile_cont(bytes, 0.5) FILTER (WHERE ok = 1 AND p = 'kev')) / 8192.0) AS kv, count_if(p = 'render') AS n, sum(greatest(0, rcR - 2)) FILTER (WHERE p = 'render') AS more FROM b), r AS (SELECT count(*) AS miss FROM events WHERE event_type = 'purchase' AND event_id % 5 IN (0, 1) AND event_id % 4 IN (0, 1)),
mt AS (SELECT 12 AS line, 'writes' AS name, (SELECT sum(units) FROM s)::DOUBLE AS t, 200000 AS most UNION ALL SELECT 13, 'reads', (SELECT n * (ed + kv) + more + miss * ed FROM m, r), 1000000 UNION ALL SELECT 14, 'compose cpu ms', (SELECT cpu FROM s WHERE p = 'edition'), 14400000)
SELECT line::INTEGER AS line, text FROM (
SELECT 0 AS line, printf('coverage: %d/%d min (%.1f%%)', round(c)::BIGINT, round(w)::BIGINT, c / w * 100) AS text FROM c UNION ALL VALUES (1, ''), (2, '| producer | lines/day | ok/fail | write ops/day | write units/day | median bytes | cpu s/day |'), (3, '| --- | ---: | ---: | ---: | ---: | ---: | ---: |'), (9, ''), (10, '| meter | measured per day | projected 30-day month | allotment | % of allotment | status |'), (11, '| --- | ---: | ---: | ---: | ---: | --- |'), (15, ''), (16, 'write split by producer (units):')
UNION ALL SELECT 4 + k, printf('| %s | %.1f | %d/%d | %.1f | %.1f | %d | %.1f%s |', p, lines * 1440 / c, ok, fail, rcw * 1440 / c, units * 1440 / c, mb, cpu * 1440 / c / 1000, CASE p WHEN 'ssvc' THEN ' (overlapping, not summed)' ELSE '' END) FROM s, c
UNION ALL SELECT line, printf('| %s | %.1f | %s | %s | %.1f%% | %s |', name, t * 1440 / c, format('{{:,}}', round(t * 1440 / c * 30)::BIGINT), format('{{:,}}', most::BIGINT), t * 1440 / c * 30 / most * 100, CASE WHEN t * 1440 * 30 > c * most THEN 'OVER-100' WHEN t * 1440 * 30 * 100 > c * most * 60 THEN 'OVER-60' ELSE 'OK' END) FROM mt, c
UNION ALL SELECT 17 + k, printf('- %s: %.1f%%', p, units * 100.0 / (SELECT sum(units) FROM s)) FROM s WHERE p <> 'render')"""
ORACLES = {
    "q01_feed_items": _ITEMS01,
    "q31_rss": chain(*TO_EDITION, _FEEDS) + _RSS,
    "q32_json_feed": chain(*TO_EDITION, _FEEDS) + _JSON,
    "q45_report": _REPORT,
    "q22_epss_urls": f"WITH {_EPSS_SQL} SELECT batch, 'https://scores.example.org/epss?cve=' || string_agg(cve, ',' ORDER BY cve) || '&limit=100' AS url FROM b WHERE batch IS NOT NULL GROUP BY batch",
    "q38_mark_shown": f"WITH {_VIEW} SELECT user_id, article AS article_id, kind, at_ms FROM lm UNION ALL SELECT user_id, id, 'read', {NOW + 2} FROM vw WHERE ok AND NOT r AND (len(sections) = 0 OR list_contains(sections, section))",
    "q41_read_rows": "SELECT CASE WHEN event_id % 9 = 0 THEN '-' WHEN event_id % 7 = 0 THEN 'other' ELSE 'budget' END AS k, event_id % 9 <> 0 AND event_id % 7 <> 0 AS valid, count(*) AS n FROM events GROUP BY ALL",
    "q46_gap_rows": "WITH p AS (" + A.duck_sql(GAPS) + "), m AS (SELECT *, max(CASE WHEN ok THEN to_ms END) OVER (ORDER BY to_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p) SELECT DISTINCT * FROM (SELECT stream, from_ms AS gap_from, to_ms AS gap_to, coalesce(failure, 'cli-exit') AS reason FROM p WHERE NOT ok UNION ALL SELECT stream, from_ms, to_ms, 'truncated' FROM p WHERE truncated UNION ALL SELECT stream, from_ms + 5, to_ms, 'excluded' FROM p WHERE ex UNION ALL SELECT stream, b, to_ms, 'missed-poll' FROM m WHERE to_ms - b > 540000)",
    "q02_body_gates": f"WITH s AS ({A.duck_sql(A.SOURCES)}), b AS ({A.duck_sql(_BODIES)}) SELECT doc_id, CASE WHEN status <> 200 THEN 'status' WHEN NOT (contains(lower(content_type), 'xml') OR (allow_html AND contains(lower(content_type), 'html'))) THEN 'content type' WHEN strlen(body) > coalesce(max_body_bytes, 2097152) THEN 'size' ELSE 'ok' END AS outcome FROM b JOIN s USING (source_id)",
    "q20_json_gate": "WITH a AS (" + A.duck_sql(_ANSWERS) + ") SELECT event_id, reason IS NULL AS ok, reason FROM (SELECT event_id, CASE WHEN status IS NULL THEN 'network' WHEN status <> 200 THEN 'status' WHEN strlen(body) > 9 THEN 'size' WHEN body LIKE '<%' THEN 'json' END AS reason FROM a)",
    "q20_redirects": "WITH h AS (" + A.duck_sql(_HOPS) + "), x AS (SELECT chain, hop, lower(regexp_extract(url, '^https://([^/?#]+)', 1)) AS host FROM h), f AS (SELECT chain, arg_min(host, hop) AS first FROM x GROUP BY chain) SELECT chain, bool_and(host = first AND host <> '') AND max(hop) <= 5 AS ok FROM x JOIN f USING (chain) GROUP BY chain",
    "q21_kev": f"WITH {_KEV_SQL} SELECT catalogue, cve, added, due, ransomware FROM s",
    "q21_kev_gate": f"WITH {_KEV_SQL}, n AS (SELECT catalogue, count(*) AS n, count_if(NOT valid) AS skipped FROM v GROUP BY catalogue), m AS (SELECT catalogue, count(*) AS valid FROM s GROUP BY catalogue) SELECT catalogue, n, coalesce(valid, 0) AS valid, skipped, CASE WHEN catalogue % 4 IN (2, 3) THEN 'count' WHEN skipped > n * 0.01 THEN 'schema drift' WHEN coalesce(valid, 0) < 450 THEN 'too few' END AS rejected FROM n LEFT JOIN m USING (catalogue)",
    "q22_epss": f"WITH {_EPSS_SQL} SELECT cve, state, CASE WHEN state = 'scored' THEN score END AS score, CASE WHEN state = 'scored' THEN day END AS date FROM epss",
    "q23_ssvc": f"WITH {_PRE} SELECT sel.cve, choice, priority, state FROM sel JOIN ssvc USING (cve)",
    "q24_enrichment": f"WITH {_PRE} SELECT cve, kev_state, added, epss_state, score, ssvc_state, ssvc FROM states",
    "q25_health": f"""WITH {_PRE}, h AS (SELECT count(*) AS er, count_if(epss_state = 'unavailable') AS eu, count_if(ssvc_state <> 'skipped') AS sr, count_if(ssvc_state = 'unavailable') AS su FROM states),
      t AS (SELECT *, CASE WHEN er = 0 OR eu = 0 THEN 'ok' WHEN eu = er THEN 'unavailable' ELSE 'partial' END AS es, CASE WHEN sr = 0 OR su = 0 THEN 'ok' WHEN su = sr THEN 'unavailable' ELSE 'partial' END AS ss FROM h)
      SELECT 'stale' AS kev_status, er AS epss_requested, eu AS epss_unavailable, sr AS ssvc_requested, su AS ssvc_unavailable, es AS epss_status, ss AS ssvc_status, concat_ws(' · ', 'KEV data from 2024-01-28', CASE es WHEN 'unavailable' THEN 'EPSS data unavailable' WHEN 'partial' THEN 'EPSS partially unavailable' END, CASE ss WHEN 'unavailable' THEN 'SSVC data unavailable' WHEN 'partial' THEN 'SSVC partially unavailable' END) AS notice FROM t""",
    "q26_chips": f"""WITH {_PRE}, c AS (SELECT s.e, s.cve, kev_state = 'listed' AS k, score, count(*) OVER (PARTITION BY s.e) AS n, row_number() OVER (PARTITION BY s.e ORDER BY (CASE WHEN kev_state = 'listed' THEN 0 ELSE 1 END), CASE WHEN kev_state = 'listed' THEN added END DESC NULLS LAST, (CASE WHEN kev_state = 'listed' THEN 2 WHEN ssvc = 'active' THEN 0 WHEN ssvc = 'poc' THEN 1 ELSE 2 END), score DESC NULLS LAST, p) AS r FROM seen s LEFT JOIN states USING (cve))
      SELECT e AS edition_pos, r AS chip_rank, cve, 'https://nvd.nist.gov/vuln/detail/' || cve AS href, greatest(0, n - 3) AS overflow, coalesce(k, false) AS kev, score >= 0.1 AS strong FROM c WHERE r <= 3""",
    "q30_feed_scope": chain(*TO_EDITION) + f"""SELECT slug, row_number() OVER (PARTITION BY slug ORDER BY published_ms DESC, edition_pos) AS feed_rank, id, CASE WHEN slug = 'all' THEN '/feed.xml' ELSE '/feed/' || slug || '.xml' END AS path FROM (
      SELECT 'all' AS slug, * FROM ed UNION ALL SELECT 'high', * FROM ed WHERE {LEVEL} >= 1 UNION ALL SELECT 'critical', * FROM ed WHERE {LEVEL} >= 2 UNION ALL SELECT regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g'), * FROM ed)""",
    "q33_section_plan": chain(*TO_EDITION) + "SELECT section, count(*) AS n, count(DISTINCT source) AS n_sources, CASE WHEN count(*) - 6 >= 3 THEN 6 ELSE count(*) END AS visible, CASE WHEN count(*) - 6 >= 3 THEN count(*) - 6 ELSE 0 END AS hidden FROM ed GROUP BY section",
    "q34_visible": f"WITH {_VIEW} SELECT user_id, id, section FROM vw WHERE ok AND (len(sections) = 0 OR list_contains(sections, section))",
    "q35_visible_counts": f"WITH {_VIEW}, g AS (SELECT user_id, section, count_if(ok) AS n, any_value(lv0) AS lv0, any_value(un) AS un, any_value(fl) AS fl, any_value(sections) AS sections FROM vw GROUP BY ALL), k AS (SELECT user_id, sum(n)::BIGINT AS n, count(*) AS shown, max(len(sections)) AS sel FROM g WHERE n > 0 OR NOT (lv0 > 0 OR un OR fl) GROUP BY user_id) SELECT user_id, n, ', ' || n || CASE WHEN n = 1 THEN ' article' ELSE ' articles' END AS label, CASE WHEN sel = 0 THEN 'Showing all ' || shown ELSE 'Showing ' || sel || ' of ' || shown END || CASE WHEN shown = 1 THEN ' section' ELSE ' sections' END AS message FROM k",
    "q36_reader_counts": f"WITH {_VIEW} SELECT user_id, count(*) AS n_all, count_if(lv >= 1) AS n_high, count_if(lv >= 2) AS n_critical, count_if(NOT r) AS unread, count_if(f) AS flagged, count_if(ok) AS shown, count_if(ok AND NOT r) AS shown_unread FROM vw GROUP BY user_id",
    "q37_prefs": f"WITH {_PREFS_SQL} SELECT user_id, array_to_string(sections, ',') AS sections, CASE lv0 WHEN 2 THEN 'critical' WHEN 1 THEN 'high' ELSE 'all' END AS min_importance, un AS unread_only, fl AS flagged_only, ks AS key_shortcuts, array_to_string(CASE WHEN list_contains(sections, 'Breaches') THEN list_filter(sections, lambda x: x <> 'Breaches') ELSE list_append(sections, 'Breaches') END, ',') AS toggled FROM prefs",
    "q38_marks": f"WITH m AS ({A.duck_sql(A.MARKS)}), lm AS (SELECT * FROM m WHERE {NOW} - at_ms < {C.MARK_MS}), ch AS (SELECT DISTINCT user_id, event_id % 97 AS article, 'read' AS kind FROM events WHERE event_type = 'view') SELECT coalesce(lm.user_id, ch.user_id) AS user_id, coalesce(lm.article, ch.article) AS article_id, coalesce(lm.kind, ch.kind) AS kind, CASE WHEN lm.at_ms IS NULL THEN {NOW} WHEN ch.user_id IS NULL THEN lm.at_ms ELSE {NOW} + 1 END AS at_ms FROM lm FULL JOIN ch ON lm.user_id = ch.user_id AND lm.article = ch.article AND lm.kind = ch.kind",
    "q39_set_operations": f"WITH m AS ({A.duck_sql(A.MARKS)}), a AS (SELECT user_id, article FROM m WHERE kind = 'read'), b AS (SELECT user_id, article FROM m WHERE kind = 'flag') SELECT user_id, count(*) AS n, 'union' AS op FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY user_id UNION ALL SELECT user_id, count(*), 'intersect' FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY user_id UNION ALL SELECT user_id, count(*), 'except' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY user_id UNION ALL SELECT user_id, count(*), 'union_all' FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY user_id",
    "q40_log_rows": f"WITH {_LINE} SELECT strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ts, 'r' || pos AS rid, '/p' || pos % 3 AS path, '' AS dep, p, ok, ms, cpuMs, n, bytes, rcW, rcR, kvCmd, st FROM ln WHERE pos % 11 <> 0 AND NOT (pos % 13 = 0 AND ok = 1)",
    "q41_take_new": f"WITH b AS ({A.duck_sql(A.BUDGET)}), r AS (SELECT pos, sha1('budget|' || pos % 400 || '|' || p || '|' || pos % 7) AS k FROM b), x AS (SELECT pos, CASE WHEN pos % 100 <> 99 THEN k END AS key FROM r) SELECT pos, key FROM x WHERE key IS NULL OR (key NOT IN (SELECT k FROM r WHERE pos < 50) AND pos IN (SELECT min(pos) FROM x WHERE key IS NOT NULL GROUP BY key))",
    "q42_budget_line": f"""WITH {_LINE} SELECT pos, 'budget {{"p":"' || p || '","ok":' || ok || ',"ms":' || ms || ',"cpuMs":' || cpuMs || ',"n":' || n || ',"bytes":' || bytes || ',"rcW":' || rcW || ',"rcR":' || rcR || ',"kvCmd":' || kvCmd || CASE WHEN p = 'ssvc' THEN ',"st":"' || st || '"}}' ELSE '}}' END AS message, bytes, st, 2 + least(n * 3, 100) + ceil(least(bytes % 700, 500) / 50.0)::BIGINT AS reads, n >= 1 AND rcR >= 1 AND n <= 50 AND n >= rcR + 5 AS valid FROM ln""",
    "q43_islands": f"WITH w AS (SELECT greatest(from_ms, {NOW - 20 * DAY}) AS s, least(to_ms, {NOW - 5 * DAY}) AS e FROM ({A.duck_sql(A.POLLS)}) WHERE ok), o AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM w WHERE e > s), i AS (SELECT s, e, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT min(s) AS start, max(e) AS stop FROM i GROUP BY k",
    "q43_coverage": f"WITH w AS (SELECT * FROM ({A.duck_sql(A.POLLS)}) WHERE ok), o AS (SELECT from_ms AS s, to_ms AS e, max(to_ms) OVER (ORDER BY from_ms, to_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM w WHERE to_ms > from_ms), i AS (SELECT s, e, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o), c AS (SELECT max(e) - min(s) AS d FROM i GROUP BY k) SELECT round((SELECT sum(d) FROM c) / 60000.0, 6) AS covered_min, round((max(to_ms) - min(from_ms)) / 60000.0, 6) AS period_min, min(from_ms) AS from_ms, greatest(max(to_ms), min(from_ms) + 86400000) AS to_ms FROM w",
    "q44_producers": f"WITH b AS ({A.duck_sql(A.BUDGET)}), s AS (SELECT p, count(*) AS lines, count_if(ok = 1) AS ok, count_if(ok = 0) AS fail, sum(rcW)::BIGINT AS rcw, sum({_UNITS})::BIGINT AS units, ceil(quantile_cont(bytes, 0.5) FILTER (WHERE ok = 1))::BIGINT AS median_bytes, sum(cpuMs)::BIGINT AS cpu_ms FROM b GROUP BY p) SELECT *, round(units * 100.0 / (SELECT sum(units) FROM s WHERE p <> 'render'), 1) AS split_pct, CASE WHEN units > 9000 THEN 'OVER-100' WHEN units > 5400 THEN 'OVER-60' ELSE 'OK' END AS status FROM s",
    "q44_reads": f"WITH b AS ({A.duck_sql(A.BUDGET)}), m AS (SELECT ceil(ceil(quantile_cont(bytes, 0.5) FILTER (WHERE ok = 1 AND p = 'edition')) / 8192.0) AS ed, ceil(ceil(quantile_cont(bytes, 0.5) FILTER (WHERE ok = 1 AND p = 'kev')) / 8192.0) AS kv, count_if(p = 'render') AS n, sum(greatest(0, rcR - 2)) FILTER (WHERE p = 'render') AS more FROM b), r AS (SELECT count(*) AS miss FROM events WHERE event_type = 'purchase' AND event_id % 5 IN (0, 1) AND event_id % 4 IN (0, 1)) SELECT (n * (ed + kv) + more + miss * ed)::BIGINT AS units, true AS known FROM m, r",
    "q46_capture": "SELECT event_type, count(DISTINCT (strftime(ts, '%Y-%m-%d %H:%M:%S'), user_id)) AS n, count(DISTINCT (strftime(ts, '%Y-%m-%d %H:%M:%S'), user_id)) AS n_keys FROM events GROUP BY event_type",
    "q46_missed_polls": f"WITH w AS (SELECT * FROM ({A.duck_sql(A.POLLS)}) WHERE ok) SELECT stream, b AS gap_from, from_ms AS gap_to FROM (SELECT stream, from_ms, max(to_ms) OVER (ORDER BY from_ms, to_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM w) WHERE from_ms - b > 1800000",
    "q47_refresh": chain(*TO_EDITION) + "SELECT edition_pos, section, id FROM ed",
    "q48_windows": "SELECT epoch_ms(time_bucket(INTERVAL 15 MINUTE, ts)) AS window_ms, event_type, count(*) AS n FROM events GROUP BY ALL",
    "q49_cube": chain(*TO_EDITION) + "SELECT coalesce(section, '*') AS section, coalesce(importance, '*') AS importance, coalesce(source_type, '*') AS source_type, count(*) AS n FROM ed GROUP BY CUBE (section, importance, source_type)",
}


def _counts(sql: str) -> str:
    """Conditional counts as BIGINT; DuckDB's are wider."""
    out, at = "", 0
    while (start := sql.find("count_if(", at)) >= 0:
        depth, end = 0, start + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        out, at = out + sql[at:end] + "::BIGINT", end
    return out + sql[at:]


ORACLES = {name: _counts(sql) for name, sql in ORACLES.items()}
