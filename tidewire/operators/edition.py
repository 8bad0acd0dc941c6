"""The edition: feed items are normalised, windowed, deduplicated, derived, ranked and grouped.

Every function takes DataFrames and the moment `now_ms`; `idx` is the place of an item in the fan-out and ends every order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import scalars as S
from tidewire.functions import udfs as U
from tidewire.operators.graph import components
from tidewire.operators.ranking import ranked_within
from tidewire.plans.store import save

#: Room for items of one source in `idx`.
STRIDE = 1 << 32


class Rejected(Exception):
    """A new result that isn't to replace the last good one."""


def _case(of: str, table: dict, kind: str) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(F.col(of) == k, F.lit(v)) if out is None else out.when(F.col(of) == k, F.lit(v))
    return out.cast(kind)


def tier_weight(of: str = "tier") -> Column:
    return _case(of, C.WEIGHTS, "double")


def lookback_hours(of: str = "source_type") -> Column:
    return _case(of, C.LOOKBACK, "int")


def section_pos(of: str = "section") -> Column:
    return _case(of, {s: k for k, s in enumerate(C.SECTIONS)}, "int")


def normalize(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles of items (source_id, pos, title, link, iso_date, pub_date, snippet) that have a title, a web link and a date.

    `sources` is the catalogue of feeds: a table of configuration, far below any broadcast limit.
    """
    # word boundaries of title patterns are those of ASCII words
    include = F.replace("title_include", F.lit(r"\b"), F.lit(S.BOUNDARY)).alias("title_include")
    rows = items.join(F.broadcast(sources.select("source_id", "source_pos", "name", "tier", "source_type", "max_items", include)), "source_id")
    rows = rows.withColumn("title", S.trim(S.decode_entities("title"))).withColumn("url", S.trim("link")).withColumn("ts", S.published("iso_date", "pub_date"))
    rows = rows.where((F.col("title") != "") & F.col("url").rlike(r"^(?i:https?)://[^/?#\s]+") & F.col("ts").isNotNull())
    return rows.select(
        (F.col("source_pos") * F.lit(STRIDE) + F.col("pos")).alias("idx"), "source_id", F.col("name").alias("source"), "tier", "source_type", "title", "url",
        F.unix_millis("ts").alias("published_ms"), S.truncate_summary(S.trim(F.coalesce("snippet", F.lit("")))).alias("summary"), "max_items", "title_include",
    )


def within_lookback(articles: DataFrame, now_ms: int, hours: Column | None = None) -> DataFrame:
    """Articles not older than the lookback of their type, inclusive; an unknown date is out."""
    hours = lookback_hours() if hours is None else hours
    return articles.where(F.col("published_ms") >= F.lit(now_ms) - hours * 3_600_000)


def title_included(articles: DataFrame) -> DataFrame:
    return articles.where("title_include is null or title rlike title_include")


def newest(articles: DataFrame) -> DataFrame:
    """The newest max_items of each source that has such a cap; those are in the order of time from then on."""
    some = articles.where("max_items > 0").withColumn("salt", F.pmod(F.xxhash64("idx"), F.lit(64)))
    newest_first = [F.desc("published_ms"), F.col("idx")]
    # the newest of each part of a source first, so that a source of any size meets one task with a few rows only
    for by in (["source_id", "salt"], ["source_id"]):
        some = some.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*newest_first))).where("r <= max_items")
    lows = articles.where("max_items > 0").groupBy("source_id").agg(F.min("idx").alias("lo"))
    capped = some.join(lows, "source_id").withColumn("idx", F.col("lo") + F.col("r") - 1)
    return articles.where("max_items is null or max_items <= 0").unionByName(capped.select(*articles.columns))


def source_window(articles: DataFrame, now_ms: int) -> DataFrame:
    """Title words, then lookback, then the cap of each source."""
    return newest(within_lookback(title_included(articles), now_ms))


def fan_out(results: DataFrame) -> DataFrame:
    """Articles of the sources that answered; one that failed adds nothing."""
    return results.where("status = 'ok'")


def with_keys(articles: DataFrame) -> DataFrame:
    """Keys by which stories are the same, by the full rules; clean URLs and ASCII titles get them natively."""
    return articles.withColumn("url_key", U.url_key("url")).withColumn("title_key", U.title_key("title"))


def dedupe(articles: DataFrame) -> DataFrame:
    """One article of each group joined by URL or title keys, over any number of steps: the earliest, then of the weightiest tier, then the first.

    A key's articles link to its first one: no more links than articles, whatever the size of a group. An empty title key
    joins nothing. Articles that no key links are out of it from there on; the others meet by a pre-aggregated minimum, not in a window.
    """
    articles = save(articles, "windowed")  # the keys and the survivors are read from it
    keys = with_keys(articles).select("idx", F.explode(F.array(F.concat(F.lit("u"), "url_key"), F.when(F.col("title_key") != "", F.concat(F.lit("t"), "title_key")))).alias("key")).where("key is not null")
    keys = save(keys.select("idx", F.md5(F.col("key").cast("binary")).alias("key")), "keys")
    first = keys.groupBy("key").agg(F.min("idx").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = keys.join(first, "key").where("idx <> b").select(F.col("idx").alias("a"), "b")
    linked = components(links).withColumnRenamed("v", "idx")
    members = linked.join(articles.select("idx", "published_ms", "tier"), "idx")
    best = members.groupBy("root").agg(F.min(F.struct(F.coalesce("published_ms", F.lit((1 << 63) - 1)).alias("t"), (-tier_weight()).alias("w"), F.col("idx").alias("i"))).alias("best"))
    lost = linked.join(best.select(F.col("best.i").alias("idx")), "idx", "left_anti").select("idx")
    return articles.join(lost, "idx", "left_anti")


def derive(articles: DataFrame) -> DataFrame:
    """Section, importance and its reason, id and CVE ids of each article."""
    rows = articles.withColumn("cves", S.cves("title", "summary")).withColumn("section", S.classify("title", "summary")).withColumn("id", S.article_id("url"))
    critical, high = S.signals("_text")
    rows = rows.withColumn("_text", F.concat("title", F.lit("\n"), "summary")).withColumns({"_critical": critical, "_high": high})
    level, reason = S.importance("_critical", "_high", "section", "cves")
    return rows.withColumns({"importance": level, "importance_reason": reason}).drop("_text", "_critical", "_high")


def ranked(articles: DataFrame, now_ms: int) -> DataFrame:
    """Score of each article and its rank in its section."""
    rows = articles.withColumn("score", S.score(tier_weight(), "published_ms", now_ms)).withColumn("section_pos", section_pos())
    rows = save(rows, "derived")  # dealing by range samples its input, which is then not derived twice
    places = ranked_within(rows.select("idx", "section_pos", "score"), "section_pos", [F.desc("score"), F.col("idx")])
    return rows.join(places.select("idx", "rank"), "idx")


def compose(windowed: DataFrame, now_ms: int) -> DataFrame:
    """The edition of windowed articles: ranked in sections, with `edition_pos` in the order in which it is shown."""
    rows = ranked(derive(dedupe(windowed)), now_ms)
    # one row for each section
    before = rows.groupBy("section_pos").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("section_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(before.select("section_pos", "before")), "section_pos").withColumn("edition_pos", F.col("before") + F.col("rank")).drop("before")


def admitted(edition: DataFrame) -> DataFrame:
    """The edition, written, or an error if it has no article: the last good one is then to stay."""
    edition = save(edition, "edition")
    if edition.isEmpty():
        raise Rejected("an edition without articles is not published")
    return edition


def grouped(edition: DataFrame) -> DataFrame:
    """Sections with their articles in order."""
    return edition.groupBy("section_pos", "section").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "title", "url"))).alias("articles"))


def unique_cves(edition: DataFrame) -> DataFrame:
    """(cve, pos) of the valid ids of an edition, by first appearance."""
    seen = edition.select("edition_pos", F.posexplode("cves").alias("p", "cve")).where(S.is_cve("cve"))
    first = seen.groupBy("cve").agg(F.min(F.struct("edition_pos", "p")).alias("at"))
    return first.select("cve", F.row_number().over(Window.orderBy("at", "cve")).cast("long").alias("pos"))  # ids of one edition: few
