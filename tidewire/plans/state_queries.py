"""Queries of what is kept from batch to batch: stories, versions of dimensions, polls, histories, marks and published sets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import budget as B
from tidewire.operators import dimensions as D
from tidewire.plans import edition_queries as Q
from tidewire.plans import keyed, serving_queries
from tidewire.plans import standins as A
from tidewire.plans.edition_queries import TO_DEDUPE, chain, rel
from tidewire.plans.store import new_path, save
from tidewire.sources import paged, publish
from tidewire.streaming import refresh as R
from tidewire.streaming import stories, timers

NOW, HOUR = A.NOW_MS, 3_600_000
BATCHES = 10


def q50(spark, sf):
    """Deduplication of the windowed articles in ten batches: the stories are those of all at once."""
    articles, state = save(Q.windowed(spark, sf), "windowed"), new_path(spark, "stories")
    for number in range(BATCHES):
        stories.extend(articles.where(F.pmod(F.xxhash64("idx"), F.lit(BATCHES)) == number), state, number, buckets=16)
    return stories.survivors(articles, state).select("idx", "source", "title")


# ---- versions of dimensions ----

#: Attempts to renew a dimension; one in five fails, and all do on four days of eleven.
_ATTEMPTS = """SELECT CASE event_id % 4 WHEN 0 THEN 'edition' WHEN 1 THEN 'kev' WHEN 2 THEN 'epss' ELSE 'ssvc' END AS dimension, {epoch} * 1000 AS at_ms,
  event_id % 5 <> 0 AND CAST(floor({epoch} / 86400.0) AS BIGINT) % 11 NOT IN (3, 4, 5, 6) AS ok FROM {events} e"""
_CLOCKS = "SELECT DISTINCT CAST(floor({epoch} / 3600.0) AS BIGINT) * 3600000 AS clock_ms FROM {events} e"
_LIMITS = " ".join(f"WHEN '{d}' THEN {ms}" for d, ms in D.MAX_AGE.items())
_CADENCES = " ".join(f"WHEN '{d}' THEN {s * 1000}" for d, s in D.C.REFRESH_SECONDS.items())


def _clocks(clocks: DataFrame, dimensions: list[str]) -> DataFrame:
    return clocks.withColumn("dimension", F.explode(F.array(*map(F.lit, dimensions))))


def q51(spark, sf):
    """The version of each dimension that every hour sees, of those that attempts under its cadence made."""
    versions = D.refreshes(rel(spark, sf, _ATTEMPTS))
    return D.as_of(_clocks(rel(spark, sf, _CLOCKS), list(D.MAX_AGE)), versions)


#: Hours before now at which versions of the dimensions were fetched, and moments that look at them.
_VERSIONS = {"kev": (100, 50, 2), "epss": (70, 30, 1), "ssvc": (55, 20, 9)}
_MOMENTS = (120, 90, 60, 24, 0)
#: What the versions say: of the newer ones more parts, and scores that have risen.
_SAID = """SELECT '{d}' AS dimension, {ms} AS version_ms, 'CVE-2024-' || CAST({cve} AS STRING) AS cve, CASE WHEN '{d}' = 'epss' THEN round((p_retailprice - 900) / 150 + {k} / 100.0, 4) END AS score,
  CASE WHEN '{d}' = 'ssvc' THEN CASE p_size % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'poc' ELSE 'none' END END AS exploitation FROM {{part}}"""
_CVES = {"kev": "10000 + (7 - {k}) * p_partkey", "epss": "10000 + CAST(floor(p_partkey * (2.5 - {k} / 2.0)) AS BIGINT)", "ssvc": "10000 + (3 - {k}) * p_partkey"}
_ROWS = " UNION ALL ".join(_SAID.format(d=d, ms=NOW - h * HOUR, k=k, cve=_CVES[d].format(k=k)) for d, hours in _VERSIONS.items() for k, h in enumerate(hours))
_ASKED = "SELECT DISTINCT 'CVE-2024-' || CAST(10000 + (doc_id * 7) % 900 AS STRING) AS cve FROM {documents}"


def q52(spark, sf):
    """What three catalogues in three versions each say of the ids at several moments."""
    rows = save(rel(spark, sf, _ROWS), "versions")
    at = save(D.as_of(_clocks(spark.createDataFrame([(NOW - h * HOUR,) for h in _MOMENTS], "clock_ms long"), ["kev", "epss", "ssvc"]), rows.select("dimension", "version_ms").distinct()), "seen")
    health = at.groupBy("clock_ms").pivot("dimension", ["kev", "epss", "ssvc"]).agg(F.max("state"))
    health = health.select("clock_ms", F.concat_ws(",", "kev", "epss", "ssvc").alias("health"))
    return D.states_at(rel(spark, sf, _ASKED), at, rows).join(F.broadcast(health), "clock_ms")  # a row for each moment


# ---- polls ----

#: Milliseconds between polls and of a poll's window, and lines of a page.
_EVERY, _LONG, _PAGE = 6 * HOUR, 6 * HOUR + HOUR // 2, 5000


def _landed(spark, sf) -> tuple[str, int, int]:
    """Pages of the windows' events as a platform's tool would give them, where the source looks for them; the first window's start and the end of all.

    Of seven polls one failed and has no page; of some an interval is excluded.
    """
    events = rel(spark, sf, "SELECT event_id AS id, event_type AS event, {epoch} * 1000 AS t FROM {events} e")
    ends = events.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    start, last = ends["a"] // _EVERY * _EVERY, ends["b"]
    n = (last - start) // _EVERY + 1
    k = F.floor((F.col("t") - start) / _EVERY)
    in_both = (k > 0) & ((F.col("t") - start) % _EVERY < _LONG - _EVERY)
    lines = events.withColumn("k", F.explode(F.when(in_both, F.array(k, k - 1)).otherwise(F.array(k)))).where("k % 7 <> 3")
    sizes = spark.range(n).select(F.col("id").alias("k")).where("k % 7 <> 3").join(lines.groupBy("k").agg(F.count("*").alias("c")), "k", "left")
    sizes = sizes.select("k", F.greatest(F.lit(1), F.ceil(F.coalesce("c", F.lit(0)) / _PAGE)).cast("int").alias("pages"))
    line = F.to_json(F.struct(F.lit("log").alias("type"), "id", "event"))
    rows = lines.join(sizes, "k").select("k", F.pmod(F.xxhash64("id"), F.col("pages")).cast("int").alias("p"), F.lit(0).alias("last"), line.alias("value"))
    each = sizes.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
    more = F.col("p") + 1 < F.col("pages")
    paging = F.struct(more.alias("hasMore"), F.when(more, F.concat(F.lit("p"), (F.col("p") + 1).cast("string"))).alias("next"))
    excluded = F.when((F.col("p") == 0) & (F.col("k") % 5 == 2), F.array(F.struct((F.col("k") * _EVERY + start + 1000).cast("string").alias("start"))))
    said = each.select("k", "p", F.lit(1).alias("last"), F.to_json(F.struct(F.lit("summary").alias("type"), paging.alias("pagination"), excluded.alias("excludedIntervals"))).alias("value"))
    pages = rows.unionByName(said).select((F.col("k") * _EVERY + start).alias("from_ms"), F.when(F.col("p") == 0, paged.FIRST).otherwise(F.concat(F.lit("p"), F.col("p").cast("string"))).alias("page"), "last", "value")
    path = new_path(spark, "pages")
    pages.repartition("from_ms", "page").sortWithinPartitions("from_ms", "page", "last").select("from_ms", "page", "value").write.partitionBy("from_ms", "page").text(path)
    return path, start, last + _LONG


def q53(spark, sf):
    """Lines and gaps of a capture that polls paged logs as a stream: each line once, however many windows bring it."""
    path, start, until = _landed(spark, sf)
    paged.register(spark)
    polls = spark.readStream.format("paged_logs").option("pages", path).option("startMs", start).option("intervalMs", _EVERY).option("windowMs", _LONG).option("untilMs", until).load()
    line = F.from_json("value", "type string, id long, event string")
    rows = polls.where("kind <> 'poll'").withColumn("x", F.when(F.col("kind") == "line", line)).where("kind = 'gap' or x.type = 'log'")
    rows = rows.select(F.timestamp_millis("from_ms").alias("at"), F.concat_ws("|", "kind", "x.id", "gap_from", "gap_to", "reason").alias("key"), "kind", "x.id", "x.event", "gap_from", "gap_to", "reason")
    out, check = new_path(spark, "capture"), new_path(spark, "capture-state")
    R.capture(rows, out, check).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select("kind", "id", "event", "gap_from", "gap_to", "reason")


# ---- history, timers, marks and published sets ----

def q54(spark, sf):
    """New rows of a capture against a long history: keys of the first events and of all line items."""
    rows, history = serving_queries.keyed_rows(spark, sf), new_path(spark, "history")
    old = rel(spark, sf, "SELECT sha1(CAST(concat(l_orderkey, '-', l_linenumber) AS BINARY)) AS key FROM {lineitem}")
    keyed.append(old.unionByName(rows.where("pos < 50").select("key")).distinct(), history, 0)
    return B.take_new_kept(rows.withColumn("key", F.when(F.col("pos") % 100 != 99, F.col("key"))), history, 1)


def _streamed(rows: DataFrame, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def _collected(stream: DataFrame, name: str) -> DataFrame:
    """What a stream appends, when it has taken all that is there."""
    out, check = new_path(stream.sparkSession, name), new_path(stream.sparkSession, f"{name}-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def q55(spark, sf):
    """Missed polls as a stream finds them by its timers."""
    polls = rel(spark, sf, serving_queries.GAPS).select("stream", "to_ms", "ok")
    return _collected(timers.overdue_polls(_streamed(polls, "polls"), 540_000), "gaps").where("reason = 'missed-poll'").select("stream", "gap_from", "gap_to").distinct()


def q56(spark, sf):
    """Marks by a stream of actions with state that expires: marks of old, then toggles, then additions."""
    old = rel(spark, sf, A.MARKS).select("user_id", F.col("article").alias("article_id"), "kind", F.lit("add").alias("action"), "at_ms")
    change = rel(spark, sf, "SELECT DISTINCT user_id, event_id % 97 AS article_id, 'read' AS kind FROM {events} WHERE event_type = 'view'")
    later = [change.select("*", F.lit(a).alias("action"), F.lit(NOW + d).cast("long").alias("at_ms")) for a, d in (("toggle", 1), ("add", 2))]
    actions = old.unionByName(later[0]).unionByName(later[1])
    return timers.latest_marks(_collected(timers.live_marks(_streamed(actions, "actions")), "marks"))


def q57(spark, sf):
    """All feeds of both kinds, published as one set over an older one and read back."""
    path = new_path(spark, "feeds")
    publish.publish(spark.createDataFrame([("old.xml", "of the set before")], "name string, body string"), path)
    rss, json_feed = serving_queries.feeds(spark, sf)
    publish.publish(rss.select(F.concat("slug", F.lit(".xml")).alias("name"), "body").unionByName(json_feed.select(F.concat("slug", F.lit(".json")).alias("name"), "body")), path)
    return publish.published(spark, path)


QUERIES = {"q50_incremental_dedupe": q50, "q51_versions_as_of": q51, "q52_states_as_of": q52, "q53_paged_capture": q53, "q54_take_new_history": q54, "q55_overdue_polls": q55, "q56_live_marks": q56, "q57_published_feeds": q57}

_STATES = f"""
WITH rows AS ({A.duck_sql(_ROWS)}), ids AS ({A.duck_sql(_ASKED)}), clocks(clock_ms) AS (VALUES {', '.join(f'({NOW - h * HOUR}::BIGINT)' for h in _MOMENTS)}),
v AS (SELECT clock_ms, {', '.join(f"(SELECT max(version_ms) FROM rows WHERE dimension = '{d}' AND version_ms <= clock_ms) AS {d}" for d in _VERSIONS)} FROM clocks),
h AS (SELECT *, {" || ',' || ".join(f"CASE WHEN {d} IS NULL THEN 'unavailable' WHEN clock_ms - {d} <= {D.MAX_AGE[d]} THEN 'ok' ELSE 'stale' END" for d in _VERSIONS)} AS health FROM v)
SELECT h.clock_ms, ids.cve, health, CASE WHEN kev IS NULL THEN 'unavailable' WHEN k.cve IS NOT NULL THEN 'listed' ELSE 'not-listed' END AS kev_state, CASE WHEN epss IS NULL THEN 'unavailable' WHEN e.cve IS NOT NULL THEN 'scored' ELSE 'no-row' END AS epss_state, e.score,
  CASE WHEN k.cve IS NOT NULL THEN 'skipped' WHEN ssvc IS NULL THEN 'unavailable' WHEN s.cve IS NOT NULL THEN 'assessed' ELSE 'not-assessed' END AS ssvc_state
FROM ids JOIN h ON true LEFT JOIN rows k ON k.dimension = 'kev' AND k.version_ms = kev AND k.cve = ids.cve LEFT JOIN rows e ON e.dimension = 'epss' AND e.version_ms = epss AND e.cve = ids.cve LEFT JOIN rows s ON s.dimension = 'ssvc' AND s.version_ms = ssvc AND s.cve = ids.cve
"""
ORACLES = {
    "q50_incremental_dedupe": chain(*TO_DEDUPE) + "SELECT idx, source, title FROM dd",
    "q51_versions_as_of": f"""WITH a AS ({A.duck_sql(_ATTEMPTS)}), v AS (SELECT dimension, min(at_ms) AS version_ms FROM a WHERE ok GROUP BY dimension, at_ms // CASE dimension {_CADENCES} END),
      c AS (SELECT dimension, clock_ms FROM ({A.duck_sql(_CLOCKS)}), (VALUES {', '.join(f"('{d}')" for d in D.MAX_AGE)}) x(dimension))
      SELECT c.dimension, clock_ms, version_ms, clock_ms - version_ms AS age_ms, CASE WHEN version_ms IS NULL THEN 'unavailable' WHEN clock_ms - version_ms <= CASE c.dimension {_LIMITS} END THEN 'ok' ELSE 'stale' END AS state
      FROM c ASOF LEFT JOIN v ON c.dimension = v.dimension AND c.clock_ms >= v.version_ms""",
    "q52_states_as_of": _STATES,
    "q53_paged_capture": f"""WITH e AS (SELECT event_id AS id, event_type AS event, CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS t FROM events), b AS (SELECT min(t) // {_EVERY} * {_EVERY} AS s, max(t) AS z FROM e),
      k AS (SELECT id, event, (t - s) // {_EVERY} AS k, (t - s) % {_EVERY} < {_LONG - _EVERY} AS again FROM e, b), w AS (SELECT s + k * {_EVERY} AS a, k FROM b, range(0, (SELECT (z - s) // {_EVERY} + 1 FROM b)) r(k))
      SELECT 'line' AS kind, id, event, NULL::BIGINT AS gap_from, NULL::BIGINT AS gap_to, NULL AS reason FROM k WHERE k % 7 <> 3 OR (again AND k > 0 AND (k - 1) % 7 <> 3)
      UNION ALL SELECT 'gap', NULL, NULL, a, a + {_LONG}, 'cli-exit' FROM w WHERE k % 7 = 3 UNION ALL SELECT 'gap', NULL, NULL, a + 1000, a + {_LONG}, 'excluded' FROM w WHERE k % 7 <> 3 AND k % 5 = 2""",
    "q54_take_new_history": serving_queries.ORACLES["q41_take_new"],
    "q55_overdue_polls": f"WITH p AS ({A.duck_sql(serving_queries.GAPS)}), m AS (SELECT *, max(CASE WHEN ok THEN to_ms END) OVER (ORDER BY to_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p) SELECT DISTINCT stream, b AS gap_from, to_ms AS gap_to FROM m WHERE to_ms - b > 540000",
    "q56_live_marks": serving_queries.ORACLES["q38_marks"].replace(f"{NOW} + 1", f"{NOW} + 2").replace(f"THEN {NOW} ", f"THEN {NOW} + 1 "),
    "q57_published_feeds": f"SELECT slug || '.xml' AS name, body FROM ({serving_queries.ORACLES['q31_rss']}) UNION ALL SELECT slug || '.json', body FROM ({serving_queries.ORACLES['q32_json_feed']})",
}
