"""Published feeds as text: RSS 2.0 and JSON Feed 1.1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import scalars as S

#: Name space of the feeds' own elements.
NAMESPACE = "urn:tidewire:feed:1.0"


def _tag(name: str, value: Column, attributes: str = "") -> Column:
    return F.concat(F.lit(f"      <{name}{attributes}>"), S.escape_xml(value), F.lit(f"</{name}>"))


def rss_items(items: DataFrame, sources: DataFrame) -> DataFrame:
    """`items` (of `feed_items`) with `item`, the XML of each. A source of the catalogue is linked, another only named."""
    rows = items.join(F.broadcast(sources.select(F.col("name").alias("source"), F.col("url").alias("source_url"))), "source", "left")
    ts = F.timestamp_millis("published_ms")
    source = F.when(F.col("source_url").isNotNull(), F.concat(F.lit('      <source url="'), S.escape_xml("source_url"), F.lit('">'), S.escape_xml("source"), F.lit("</source>"))).otherwise(_tag("tw:source", F.col("source")))
    each = lambda name, attributes="": F.transform("cves", lambda c: F.concat(F.lit(f"      <{name}{attributes}>"), c, F.lit(f"</{name}>")))
    lines = F.concat(
        F.array(
            _tag("title", F.col("title")), _tag("link", F.col("url")), _tag("guid", F.col("url"), ' isPermaLink="true"'), _tag("pubDate", S.rfc822(ts)),
            F.when(F.col("summary") != "", _tag("description", F.col("summary"))), source, _tag("category", F.col("section"), f' domain="{NAMESPACE}/section"'), _tag("category", F.col("importance"), f' domain="{NAMESPACE}/importance"'),
        ),
        each("category", ' domain="https://nvd.nist.gov/vuln/detail"'),
        F.array(_tag("tw:importance", F.col("importance")), F.when(F.col("importance_reason").isNotNull(), _tag("tw:reason", F.col("importance_reason"))), _tag("tw:section", F.col("section")), _tag("tw:sourceTier", F.col("tier")), _tag("tw:sourceType", F.col("source_type"))),
        each("tw:cve"),
    )
    return rows.withColumn("item", F.concat(F.lit("    <item>\n"), F.array_join(F.array_compact(lines), "\n"), F.lit("\n    </item>")))


def _with_empty(whole: DataFrame, variants: DataFrame | None) -> DataFrame:
    """Feeds without an item too, if the feeds are given."""
    return whole if variants is None else variants.select("slug", "feed_title").join(whole, ["slug", "feed_title"], "left")


def rss(items: DataFrame, sources: DataFrame, generated_ms: int, site: str, name: str, description: str, variants: DataFrame | None = None) -> DataFrame:
    """(slug, body) of each feed. A feed's items are one edition's: a few hundred."""
    rows = rss_items(items, sources)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feed_rank", "item"))), lambda x: x["item"]), "\n")
    whole = _with_empty(rows.groupBy("slug", "feed_title").agg(body.alias("items")), variants)
    title = F.concat(F.lit(f"{name}: "), F.when(F.col("slug") == "all", "security news").otherwise(F.col("feed_title")))
    at = S.rfc822(F.timestamp_millis(F.lit(generated_ms)))
    return whole.select("slug", F.concat_ws(
        "\n", F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.lit(f'<rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom" xmlns:tw="{NAMESPACE}">'), F.lit("  <channel>"),
        F.concat(F.lit("    <title>"), S.escape_xml(title), F.lit("</title>")), F.concat(F.lit("    <link>"), S.escape_xml(F.lit(site + "/")), F.lit("</link>")), F.concat(F.lit("    <description>"), S.escape_xml(F.lit(description)), F.lit("</description>")),
        F.lit("    <language>en</language>"), F.concat(F.lit('    <atom:link href="'), S.escape_xml(F.concat(F.lit(site), S.feed_path("slug", "xml"))), F.lit('" rel="self" type="application/rss+xml"/>')), F.concat(F.lit("    <lastBuildDate>"), at, F.lit("</lastBuildDate>")),
        F.lit("    <ttl>15</ttl>"), F.concat(F.lit("    <generator>"), S.escape_xml(F.lit(name)), F.lit("</generator>")), F.col("items"), F.lit("  </channel>"), F.lit("</rss>"), F.lit(""),
    ).alias("body"))


def json_items(items: DataFrame) -> DataFrame:
    """`items` with `item`, the JSON of each."""
    some = F.col("summary") != ""
    own = F.struct("source", F.col("tier").alias("source_tier"), "source_type", "section", "importance", "importance_reason", "cves")
    head = [F.col("url").alias("id"), F.col("url"), F.col("title")]
    tail = [S.iso("published_ms").alias("date_published"), F.array(F.struct(F.col("source").alias("name"))).alias("authors"), F.concat(F.array("section", "importance"), "cves").alias("tags"), own.alias("_tidewire")]
    write = lambda *middle: F.to_json(F.struct(*head, *middle, *tail), {"ignoreNullFields": "false"})
    return items.withColumn("item", F.when(some, write(F.col("summary"), F.col("summary").alias("content_text"))).otherwise(write(F.col("title").alias("content_text"))))


def json_feed(items: DataFrame, generated_ms: int, site: str, name: str, description: str, variants: DataFrame | None = None) -> DataFrame:
    """(slug, body) of each feed."""
    rows = json_items(items)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feed_rank", "item"))), lambda x: x["item"]), ",")
    whole = _with_empty(rows.groupBy("slug", "feed_title").agg(body.alias("items")), variants)
    title = F.concat(F.lit(f"{name}: "), F.when(F.col("slug") == "all", "security news").otherwise(F.col("feed_title")))
    head = F.to_json(F.struct(
        F.lit("https://jsonfeed.org/version/1.1").alias("version"), title.alias("title"), F.lit(site + "/").alias("home_page_url"), F.concat(F.lit(site), S.feed_path("slug", "json")).alias("feed_url"), F.lit(description).alias("description"), F.lit("en").alias("language"),
        F.struct(F.lit(site + "/feeds").alias("about"), S.iso(F.lit(generated_ms)).alias("generated_at"), F.lit(900).alias("refresh_seconds"), F.col("slug").alias("scope")).alias("_tidewire"),
    ))
    return whole.select("slug", F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"items":['), F.coalesce("items", F.lit("")), F.lit("]}")).alias("body"))


def write_feeds(feeds: DataFrame, path: str) -> None:
    """One folder of text for each feed."""
    feeds.select("slug", F.col("body").alias("value")).write.mode("overwrite").partitionBy("slug").text(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)


CONTENT_TYPES = {"xml": "application/rss+xml; charset=utf-8", "json": "application/feed+json; charset=utf-8"}


def feed_response(edition: DataFrame, sources: DataFrame, slug: str, fmt: str, generated_ms: int, site: str, name: str, description: str) -> tuple[int, str, str]:
    """(status, content type, body) of a published feed by its path's slug; 404 for one that isn't published."""
    from tidewire.operators import views

    variants = views.feeds_df(edition.sparkSession).where(F.col("slug") == slug)
    if fmt not in CONTENT_TYPES or variants.isEmpty():
        return 404, "text/plain", "Not found"
    items = views.feed_items(edition, variants)
    about = (generated_ms, site, name, description, variants)
    body = rss(items, sources, *about) if fmt == "xml" else json_feed(items, *about)
    return 200, CONTENT_TYPES[fmt], body.first()["body"]
