"""Ranks, running maxima and medians within groups of any size: a group that holds most rows is spread over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.plans.store import fresh, save, tasks


def ranked_within(df: DataFrame, group: str, order: list[Column], name: str = "rank") -> DataFrame:
    """`df` with the place of each row in its group, from 1. `order` must be total within a group.

    Rows are dealt by range of group and order and written once; a row's rank is its place in its part of the group plus the
    rows of the parts before. Only the sizes of the parts, a row for each task and group, meet in one window.
    """
    part, before = fresh(df, "part", "before")
    dealt = save(df.repartitionByRange(tasks(df.sparkSession), F.col(group), *order).withColumn(part, F.spark_partition_id()), "dealt")
    sizes = dealt.groupBy(group, part).agg(F.count("*").alias(before))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy(group, part).orderBy(*order)).cast("long")
    return dealt.withColumn(name, place).join(starts, [group, part]).withColumn(name, F.col(name) + F.col(before)).drop(part, before)


def dealt_in_order(df: DataFrame, group: list[str], order: list[Column]) -> tuple[DataFrame, str]:
    """`df` dealt by range of group and order and written once, and the column that has the number of each row's part."""
    (part,) = fresh(df, "part")
    return save(df.repartitionByRange(tasks(df.sparkSession), *group, *order).withColumn(part, F.spark_partition_id()), "dealt"), part


def running_max(dealt: DataFrame, part: str, group: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """`dealt` with the largest `value` of all rows before each one in its group, null where there is none.

    Each part has its own running maximum, and takes over that of the parts before it; only a row for each part and group meets in one window.
    """
    top, p, *own = fresh(dealt, "top", "p", *(f"g{k}" for k in range(len(group))))
    tops = dealt.groupBy(*(F.col(g).alias(o) for g, o in zip(group, own, strict=True)), F.col(part).alias(p)).agg(F.max(value).alias(top))
    earlier = F.max(top).over(Window.partitionBy(*own).orderBy(p).rowsBetween(Window.unboundedPreceding, -1))
    starts = tops.select(*own, p, earlier.alias(top))
    inside = F.max(value).over(Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    same = F.col(part) == F.col(p)
    for g, o in zip(group, own, strict=True):
        same = same & F.col(g).eqNullSafe(F.col(o))
    return dealt.withColumn(name, inside).join(starts, same).withColumn(name, F.greatest(name, top)).drop(top, p, *own)


#: Ranges that a round of a selection counts for each group.
RANGES = 4096


def medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, lower, upper): the two middle values of the whole numbers `value` of each group, equal where their number is odd.

    Selection by counting: each round counts the values of equal ranges between bounds and goes on in the range that a middle rank
    falls in, so that a task keeps RANGES counts of a group and never its values. Nulls don't count; a group of nulls alone is missing. Values
    are to differ by less than 2^63.
    """
    held = save(rows.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("long").alias("v")), "values")
    ends = held.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.array(F.floor((F.col("n") - 1) / 2).cast("long"), F.floor(F.col("n") / 2).cast("long"))
    # two targets a group: how many values of [lo, hi] are before the one sought
    sought = save(ends.select("g", "lo", "hi", F.posexplode(ranks).alias("which", "left")), "sought")
    while (sought.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0) > 0:
        wide = F.expr(f"(hi - lo) div {RANGES} + 1")
        found = held.withColumnRenamed("g", "of").join(sought, F.col("of").eqNullSafe(F.col("g"))).where("v between lo and hi")
        counts = found.select("g", "which", "left", "lo", "hi", wide.alias("wide"), F.expr(f"(v - lo) div ((hi - lo) div {RANGES} + 1)").alias("k")).groupBy("g", "which", "left", "lo", "hi", "wide", "k").agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("g", "which").orderBy("k"))  # RANGES rows at most
        at = counts.withColumn("upto", upto).where("upto > left and upto - c <= left")
        low = F.col("lo") + F.col("k") * F.col("wide")
        sought = save(at.select("g", low.alias("lo"), F.least("hi", low + F.col("wide") - 1).alias("hi"), "which", (F.col("left") - F.col("upto") + F.col("c")).alias("left")), "sought")
    return sought.groupBy("g").agg(F.min("lo").alias("lower"), F.max("lo").alias("upper")).withColumnRenamed("g", group)
