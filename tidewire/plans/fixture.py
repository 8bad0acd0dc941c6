"""A made-up edition of forty stories and its catalogues: the same for the same moment, without any feed.

It fills every section (two of them beyond the cap, one just at it), has every tier and type of source and every importance, one incident that
three sources report, a title of twelve ids, one of 160 characters without a space, and a story without a summary. Hosts are reserved ones and ids are of 2099.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import config as C

#: Name, tier and type of the made-up sources.
SOURCES = [
    ("Sample Wire", "Tech & General", "news"), ("Sample Labs", "Security Research", "research"), ("Sample Notices", "Enterprise Security", "advisory"), ("Sample CERT", "Government", "cert"),
    ("Sample Ministry", "Government", "government"), ("Sample Maker", "Enterprise Security", "vendor"), ("Sample Intel", "Threat Intelligence", "research"), ("Sample Review", "Executive News", "news"),
]
#: Products that stories are about.
THINGS = "archive reader, login library, storage array, content plugin, camera firmware, print server, network switch, mail gateway, backup suite, meter reader".split(", ")
#: A title for each thing, by section; as many stories as said.
STORIES = {
    "Vulnerabilities": (6, "A vulnerability in a made-up {thing}"),
    "Advisories": (9, "Advisory for operators of a made-up {thing}"),
    "Ransomware": (8, "Made-up malware turns up on a {thing}"),
    "Threat Intelligence": (2, "A made-up nation-state group looks at a {thing}"),
    "Tools/Techniques": (2, "A detection framework for a made-up {thing}"),
    "Industry/Policy": (4, "The market for a made-up {thing} grows"),
}
#: Stories with titles of their own: number of the source, title, summary.
OWN = [
    (0, "Edition of made-up stories: this title says so", "The same at any time."),
    (7, "Word" * 40, ""),
    (1, "CVE-2099-10001: a flaw that a ransomware crew uses", "Actively exploited in a made-up product."),
    (2, "CVE-2099-10002 and CVE-2099-10003 in a made-up gateway", "No fix date is given."),
    (6, "CVE-2099-10004 has public code", "Proof-of-concept exploit released for CVE-2099-10005 too."),
    (3, "Bulletin on " + ", ".join(f"CVE-2099-300{k:02}" for k in range(1, 13)), "Twelve ids."),
    (0, "Made-up freight firm confirms breach of its portal", "First report of one incident."),
    (7, "Portal breach hits customers of a made-up freight firm", "Second report of it."),
    (1, "What the breach of a made-up freight portal means", "Third report of it."),
]


def articles(spark: SparkSession, now_ms: int) -> DataFrame:
    """The stories as windowed articles, each some minutes old, in the order of the fan-out."""
    rows = [(k, s, t, said) for k, (s, t, said) in enumerate(OWN)]
    for section, (n, title) in STORIES.items():
        rows += [(len(rows) + k, (len(section) + k) % len(SOURCES), title.format(thing=THINGS[k]), f"A story about {THINGS[k]} number {k}, made up.") for k in range(n)]
    out = []
    for k, s, title, summary in rows:
        name, tier, kind = SOURCES[s]
        out.append((k, name.lower().replace(" ", "-"), name, tier, kind, title, f"https://{name.split()[1].lower()}.example.test/story-{k}", now_ms - (5 + 3 * k) * 60_000, summary, None, None))
    return spark.createDataFrame(out, "idx long, source_id string, source string, tier string, source_type string, title string, url string, published_ms long, summary string, max_items int, title_include string")


def kev(spark: SparkSession) -> DataFrame:
    """Slim entries of a made-up catalogue."""
    return spark.createDataFrame([("CVE-2099-10001", "2099-01-05", "2099-01-26", True), ("CVE-2099-10003", "2099-01-12", "", False)], "cve string, added string, due string, ransomware boolean")


def epss(ids: DataFrame) -> DataFrame:
    """(cve, state, score, date) of every valid id of `ids`, each once: two have scores, the others no row; none is unavailable."""
    have = ids.sparkSession.createDataFrame([("CVE-2099-10002", "scored", 0.42, "2099-01-15"), ("CVE-2099-10004", "scored", 0.03, "2099-01-15")], "cve string, state string, score double, date string")
    return _stated(ids, have, "no-row")


def ssvc(ids: DataFrame) -> DataFrame:
    """(cve, state, exploitation, automatable, impact) of every valid id: one is exploited, one has public code, the others aren't assessed."""
    have = ids.sparkSession.createDataFrame([("CVE-2099-10002", "assessed", "active", "yes", "total"), ("CVE-2099-10004", "assessed", "poc", "no", "partial")], "cve string, state string, exploitation string, automatable string, impact string")
    return _stated(ids, have, "not-assessed")


def _stated(ids: DataFrame, have: DataFrame, rest: str) -> DataFrame:
    return ids.where(F.col("cve").rlike(C.CVE_ID)).select("cve").distinct().join(have, "cve", "left").fillna({"state": rest})
