"""Serving queries on an edition: feeds by scope, section caps, reader filters, counts and marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import scalars as S
from tidewire.operators.ranking import ranked_within

#: Feeds: slug, title, least importance, section.
FEEDS = [("all", "All stories", None, None), ("high", "High and critical", 1, None), ("critical", "Critical only", 2, None)]


def feeds() -> list[tuple[str, str, int | None, str | None]]:
    return FEEDS + [("".join(c if c.isalnum() else "-" for c in s.lower()), s, None, s) for s in C.SECTIONS]


def feeds_df(spark) -> DataFrame:
    """The feeds as rows of an expression: rows of a list would be read by Python workers."""
    kinds = {"slug": "string", "feed_title": "string", "min_rank": "int", "feed_section": "string"}
    rows = (F.struct(*(F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(feed, kinds.items(), strict=True))) for feed in feeds())
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def feed_items(edition: DataFrame, variants: DataFrame) -> DataFrame:
    """Articles of each feed, newest first, ties in the order of the edition (feed_rank). The feeds are ten rows."""
    level = S.importance_rank("importance")
    slim = edition.select("edition_pos", "published_ms", "section", "importance").join(F.broadcast(variants), F.coalesce(F.col("feed_section") == F.col("section"), level >= F.coalesce("min_rank", F.lit(0))))
    places = ranked_within(slim.select("slug", "feed_title", "edition_pos", "published_ms"), "slug", [F.desc("published_ms"), F.col("edition_pos")], "feed_rank")
    return edition.join(places.drop("published_ms"), "edition_pos")


def section_plan(edition: DataFrame) -> DataFrame:
    """(section, n, n_sources, visible, hidden): a section collapses only if that hides enough."""
    n = F.count("*")
    hide = F.col("n") - C.SECTION_CAP >= C.MIN_HIDDEN
    out = edition.groupBy("section_pos", "section").agg(n.alias("n"), F.count_distinct("source").alias("n_sources"))
    return out.select("section", "n", "n_sources", F.when(hide, F.lit(C.SECTION_CAP).cast("long")).otherwise(F.col("n")).alias("visible"), F.when(hide, F.col("n") - C.SECTION_CAP).otherwise(F.lit(0).cast("long")).alias("hidden"))


def parse_prefs(stored: DataFrame) -> DataFrame:
    """(user_id, sections, min_importance, unread_only, flagged_only, key_shortcuts) of stored text (user_id, prefs); each field falls back by itself."""
    v = F.try_parse_json("prefs")
    rows = stored.withColumn("v", v)
    kind = lambda p: F.schema_of_variant(F.try_variant_get("v", p, "variant"))
    text = lambda p: F.when(kind(p) == "STRING", F.try_variant_get("v", p, "string"))
    flag = lambda p: F.when(kind(p) == "BOOLEAN", F.try_variant_get("v", p, "boolean"))
    known = F.array(*(F.lit(s) for s in C.SECTIONS))
    given = F.transform(F.try_variant_get("v", "$.sections", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    given = F.array_distinct(F.filter(given, lambda s: F.coalesce(F.array_contains(known, s), F.lit(False))))
    least = F.when(text("$.minImportance").isin("all", "high", "critical"), text("$.minImportance"))
    return rows.select(
        "user_id", F.coalesce(F.when(F.coalesce(kind("$.sections"), F.lit("")).startswith("ARRAY"), given), F.array().cast("array<string>")).alias("sections"), F.coalesce(least, F.lit("all")).alias("min_importance"),
        F.coalesce(flag("$.unreadOnly"), F.lit(False)).alias("unread_only"), F.coalesce(flag("$.flaggedOnly"), F.lit(False)).alias("flagged_only"), F.coalesce(flag("$.keyShortcuts"), F.lit(True)).alias("key_shortcuts"),
    )


def live_marks(marks: DataFrame, now_ms: int) -> DataFrame:
    """Marks (user_id, article_id, kind, at_ms) that haven't expired; marks of the future stay."""
    return marks.where(F.lit(now_ms) - F.col("at_ms") < C.MARK_MS)


def toggle_marks(marks: DataFrame, toggled: DataFrame, now_ms: int) -> DataFrame:
    """Marks after a toggle of each row of `toggled` (user_id, article_id, kind): what was marked isn't, what wasn't is at `now_ms`."""
    key = ["user_id", "article_id", "kind"]
    new = toggled.select(*key).distinct().withColumn("t", F.lit(True))
    out = marks.join(new, key, "full_outer").where("at_ms is null or t is null")
    return out.select(*key, F.coalesce("at_ms", F.lit(now_ms)).alias("at_ms"))


def add_marks(marks: DataFrame, added: DataFrame, now_ms: int) -> DataFrame:
    """Marks with each row of `added`; one that was there keeps its time."""
    key = ["user_id", "article_id", "kind"]
    return marks.select(*key, "at_ms").unionByName(added.select(*key).distinct().join(marks, key, "left_anti").withColumn("at_ms", F.lit(now_ms)))


def with_marks(articles: DataFrame, marks: DataFrame) -> DataFrame:
    """Articles (user_id, id, ...) with is_read and is_flagged."""
    each = marks.groupBy("user_id", "article_id").agg(F.bool_or(F.col("kind") == "read").alias("r"), F.bool_or(F.col("kind") == "flag").alias("f"))
    out = articles.join(each, (articles["user_id"] == each["user_id"]) & (articles["id"] == each["article_id"]), "left").drop(each["user_id"]).drop("article_id")
    return out.withColumn("is_read", F.coalesce("r", F.lit(False))).withColumn("is_flagged", F.coalesce("f", F.lit(False))).drop("r", "f")


def visible(min_rank: Column | int, unread_only: Column | bool, flagged_only: Column | bool) -> Column:
    """Whether an article passes a reader's filters."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return (S.importance_rank("importance") >= lit(min_rank)) & (~lit(unread_only) | ~F.col("is_read")) & (~lit(flagged_only) | F.col("is_flagged"))


def section_selected(selected: Column) -> Column:
    return (F.size(selected) == 0) | F.array_contains(selected, F.col("section"))


def toggle_section(selected: Column, section: Column) -> Column:
    return F.when(F.array_contains(selected, section), F.array_remove(selected, section)).otherwise(F.array_append(selected, section))


def has_filters(min_importance: Column, unread_only: Column, flagged_only: Column) -> Column:
    return (min_importance != "all") | unread_only | flagged_only


def mark_shown(seen: DataFrame, marks: DataFrame, ok: Column, now_ms: int) -> DataFrame:
    """Marks after a reader marks all that is shown and unread (`seen` as of `with_marks`) as read."""
    new = seen.where(ok & ~F.col("is_read")).select("user_id", F.col("id").alias("article_id"), F.lit("read").alias("kind"))
    return add_marks(marks, new, now_ms)


def step_index(current: Column, count: Column, forward: Column) -> Column:
    """The place to go to among `count` articles, clamped at both ends; -1 if there is none."""
    start = F.when(forward, 0).otherwise(count - 1)
    step = F.when(forward, F.least(current + 1, count - 1)).otherwise(F.greatest(current - 1, F.lit(0)))
    return F.when(count == 0, -1).when(current < 0, start).otherwise(step)
