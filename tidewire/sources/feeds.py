"""Landed feed bodies and JSON answers: gates, XML items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import scalars as S
from tidewire.functions import udfs as U


def gated(bodies: DataFrame, sources: DataFrame) -> DataFrame:
    """`bodies` (source_id, status, content_type, body) with outcome: ok, or why a body is not read."""
    rows = bodies.join(F.broadcast(sources.select("source_id", "allow_html", "max_body_bytes")), "source_id")
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    ok = kind.contains("xml") | (F.col("allow_html") & kind.contains("html"))
    why = F.when(~F.coalesce(F.col("status").between(200, 299), F.lit(False)), "status").when(~ok, "content type").when(F.octet_length("body") > F.coalesce("max_body_bytes", F.lit(C.BODY_BYTES)), "size").otherwise("ok")
    return rows.withColumn("outcome", why)


_ITEM = "ARRAY<STRUCT<title: STRING, link: STRING, pubDate: STRING, `dc:date`: STRING, description: STRING>>"
_ENTRY = "ARRAY<STRUCT<title: STRING, link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>, published: STRING, updated: STRING, content: STRING>>"
#: RSS 2.0 has its items in a channel, RSS 1.0 (RDF) beside it, Atom has entries.
_FEED = f"channel STRUCT<item: {_ITEM}>, item {_ITEM}, entry {_ENTRY}"
#: Tags at which text goes on in a new line, and any tag.
_BREAK, _TAG = r"([^\n])</?(?:h|br|p|ul|ol|li|blockquote|section|table|tr|div)(?:.|\n)*?>([^\n])", r"<(?:.|\n)*?>"


def snippet(html: Column) -> Column:
    """Text of a piece of HTML: without tags, entities decoded."""
    plain = F.regexp_replace(F.regexp_replace(html, _BREAK, "$1\n$2"), _TAG, "")
    return S.trim(U.unescape(F.when(F.contains(html, F.lit("<")), plain).otherwise(html)))


def items(bodies: DataFrame) -> DataFrame:
    """(source_id, pos, title, link, iso_date, pub_date, snippet) of RSS 2.0, RSS 1.0 and Atom bodies; a body that isn't XML has none.

    An entry's link is the first that says `alternate`, else its first; its snippet is of its content, for a summary is no content.
    Atom has ISO dates only, and so has an item without pubDate (dc:date).
    """
    how = {"mode": "PERMISSIVE", "attributePrefix": "_"}
    rows = bodies.where(F.col("outcome") == "ok").select("source_id", F.from_xml(F.col("body"), _FEED, how).alias("f"))
    none = F.lit(None).cast("string")
    of_rss = rows.select("source_id", F.posexplode(F.concat(F.coalesce("f.channel.item", F.expr(f"cast(array() as {_ITEM.replace(': ', ':')})")), F.coalesce("f.item", F.expr(f"cast(array() as {_ITEM.replace(': ', ':')})")))).alias("pos", "x"))
    of_rss = of_rss.select("source_id", "pos", "x.title", "x.link", F.when(F.coalesce("x.pubDate", F.lit("")) == "", F.trim("x.`dc:date`")).alias("iso_date"), F.col("x.pubDate").alias("pub_date"), F.col("x.description").alias("html"))
    of_atom = rows.select("source_id", F.posexplode("f.entry").alias("pos", "x"))
    link = F.coalesce(F.get(F.filter("x.link", lambda k: k["_rel"] == "alternate"), F.lit(0)), F.get("x.link", F.lit(0)))["_href"]
    of_atom = of_atom.select("source_id", "pos", "x.title", link.alias("link"), F.coalesce("x.published", "x.updated").alias("iso_date"), none.alias("pub_date"), F.col("x.content").alias("html"))
    out = of_rss.unionByName(of_atom)
    return out.withColumn("snippet", snippet(F.col("html"))).drop("html")


def json_answers(landed: DataFrame, max_bytes: int, accept: tuple[int, ...] = (200,)) -> DataFrame:
    """`landed` (url, status, body) with ok and reason: a JSON answer of an accepted status within the size limit."""
    why = F.when(F.col("status").isNull(), "network").when(~F.col("status").isin(*accept), "status").when(F.octet_length("body") > max_bytes, "size").when(F.try_parse_json("body").isNull(), "json")
    return landed.withColumn("reason", why).withColumn("ok", F.col("reason").isNull())


def redirect_ok(hops: DataFrame, most: int = 5) -> DataFrame:
    """(chain, ok) of redirect hops (chain, hop, url): https only, always the first host, at most `most` redirects."""
    host = F.lower(F.regexp_extract("url", r"^https://([^/?#]+)", 1))
    rows = hops.withColumn("host", host)
    first = rows.groupBy("chain").agg(F.min_by("host", "hop").alias("first"))
    return rows.join(first, "chain").groupBy("chain").agg(F.bool_and((F.col("host") == F.col("first")) & (F.col("host") != "")).alias("same"), F.max("hop").alias("hops")).select("chain", (F.col("same") & (F.col("hops") <= most)).alias("ok"))
