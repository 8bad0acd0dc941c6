"""Relations that stand in for feeds, catalogues and logs, derived from generic tables by SQL that Spark and DuckDB both run.

Each template names its tables in braces. In Spark they are DataFrames, in DuckDB views. The clock is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The moment of every query: 2024-02-01T00:00:00Z.
NOW_MS = 1706745600000

PHRASES = [
    "CVE-2024-{n} patched in gateway", "Zero-day actively exploited in mail server", "New toolkit for brain worm research", "Ransomware gang hits hospital", "Agency adds CVE-2023-12345 and CVE-2024-99999 to KEV",
    "kev conference notes", "Data leak at retailer", "Vendor warns of critical flaw", "TA505 campaign widens", "Acme &amp; Co framework", "Nothing of note", "Proof-of-concept exploit released for CVE-2024-{n}",
    "Supply-chain attack on registry", "Patch now: CVE-2024-123", "Threat actors use APT tools", "Compromised accounts sold", "Advisory: remote code execution in CVE-2022-{n}, CVE-2022-{n}",
]


def _phrase() -> str:
    """The phrase of an article, with a number of five digits where it has room for one."""
    n = "CAST(10000 + d.doc_id % 300 AS STRING)"
    out = []
    for k, p in enumerate(PHRASES):
        parts = [f"'{x}'" for x in p.split("{n}")]
        out.append(f"WHEN {k} THEN " + f" || {n} || ".join(parts))
    return f"CASE d.doc_id % {len(PHRASES)} " + " ".join(out) + " END"


#: Sources of documents as feeds: type and tier by number, newest-3 cap for two of them, title words for two.
SOURCES = """
SELECT s.source AS source_id, CAST(s.n AS INT) AS source_pos, 'Feed ' || s.source AS name,
  CASE s.n % 6 WHEN 0 THEN 'Government' WHEN 1 THEN 'Security Research' WHEN 2 THEN 'Threat Intelligence' WHEN 3 THEN 'Enterprise Security' WHEN 4 THEN 'Executive News' ELSE 'Tech & General' END AS tier,
  CASE s.n % 5 WHEN 0 THEN 'cert' WHEN 1 THEN 'news' WHEN 2 THEN 'vendor' WHEN 3 THEN 'research' ELSE 'advisory' END AS source_type,
  'https://feeds.example.org/' || s.source AS url, s.n % 4 = 0 AS allow_html, CASE WHEN s.n % 7 = 3 THEN 3 END AS max_items,
  CASE WHEN s.n % 6 = 2 THEN CAST(6000 AS BIGINT) END AS max_body_bytes, CASE WHEN s.n % 9 = 4 THEN '(?i)CVE-|ransomware|zero-day|exploit' END AS title_include
FROM (SELECT source, CAST(substr(source, 4) AS INT) AS n FROM {documents} WHERE source IS NOT NULL GROUP BY source) s
"""

#: Feed items: a phrase and a document's first line as title, a page's URL as link, an event's time within four days of now.
ITEMS = f"""
SELECT d.doc_id AS pos, d.source AS source_id, {_phrase()} || ' ' || split_part(d.text, chr(10), 1) AS title, ' ' || p.url || ' ' AS link,
  {NOW_MS} + 3600000 - CAST({{epoch}} % 345600 AS BIGINT) * 1000 AS published_ms, d.text AS snippet
FROM {{documents}} d JOIN {{events}} e ON e.event_id = d.doc_id JOIN {{pages}} p ON p.page_id = d.doc_id % (SELECT count(*) FROM {{pages}})
"""

#: Catalogue entries, each of a part: one in five ids is listed, two of three have a score, half an assessment.
KEV = """
SELECT 'CVE-2024-' || CAST(10000 + 5 * p_partkey AS STRING) AS cve, '2023-' || lpad(CAST(1 + p_size % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + p_partkey % 28 AS STRING), 2, '0') AS added, p_size % 2 = 0 AS ransomware
FROM {part}
"""
EPSS = """
SELECT 'CVE-2024-' || CAST(10000 + CAST(floor(p_partkey * 1.5) AS BIGINT) AS STRING) AS cve, round((p_retailprice - 900) / 100, 4) AS score, '2024-01-31' AS day FROM {part}
"""
SSVC = """
SELECT 'CVE-2024-' || CAST(10000 + 2 * p_partkey AS STRING) AS cve, CASE p_size % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'poc' ELSE 'none' END AS exploitation FROM {part}
"""

#: Costs of producers from events.
BUDGET = """
SELECT event_id AS pos, CASE event_type WHEN 'view' THEN 'edition' WHEN 'click' THEN 'kev' WHEN 'error' THEN 'ssvc' WHEN 'signup' THEN 'epss' ELSE 'render' END AS p, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END AS ok,
  CAST(floor(value * 10) AS BIGINT) AS ms, CAST(floor(value * 7) AS BIGINT) AS cpuMs, CAST(event_id % 50 AS BIGINT) AS n, CAST(floor(value * 977) AS BIGINT) AS bytes, CAST(event_id % 4 AS BIGINT) AS rcW,
  CAST(event_id % 9 AS BIGINT) AS rcR, CAST(0 AS BIGINT) AS kvCmd, {epoch} AS s, user_id FROM {events} e
"""
#: Polls: of every nine one failed, and of some it isn't known how they ended.
POLLS = """
SELECT event_id AS pos, 'capture' AS stream, CASE WHEN event_id % 31 <> 7 THEN event_id % 9 <> 4 END AS ok, CAST({epoch} AS BIGINT) * 1000 AS from_ms, CAST({epoch} AS BIGINT) * 1000 + CAST(floor(value * 6000) AS BIGINT) AS to_ms FROM {events} e WHERE event_type = 'view'
"""
#: Readers' marks: clicks read, signups flag; the article is a document's.
MARKS = f"""
SELECT e.user_id, e.event_id % (SELECT count(*) FROM {{documents}}) AS article, CASE WHEN e.event_type = 'click' THEN 'read' ELSE 'flag' END AS kind,
  max({NOW_MS} - (e.event_id % 12) * 86400000) AS at_ms FROM {{events}} e WHERE e.event_type IN ('click', 'signup') GROUP BY 1, 2, 3
"""

TABLES = ("documents", "events", "pages", "part", "customer", "nation", "region", "orders", "lineitem", "supplier", "labels")


def spark_sql(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """The relation of a template over the tables of a folder."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in template}
    return spark.sql(template.replace("{epoch}", "unix_seconds(CAST(e.ts AS TIMESTAMP))").replace("split_part(d.text, chr(10), 1)", "coalesce(split_part(d.text, chr(10), 1), '')"), **used)


def duck_sql(template: str) -> str:
    """The same as SQL for DuckDB."""
    out = template.replace("{epoch}", "CAST(floor(epoch(e.ts)) AS BIGINT)")
    for t in TABLES:
        out = out.replace(f"{{{t}}}", t)
    return out.replace("AS STRING)", "AS VARCHAR)")
