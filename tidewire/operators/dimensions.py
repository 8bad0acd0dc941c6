"""Dimensions in versions: when each is renewed, which version a moment sees, and what it says then. A stale version is used, never dropped for its age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.operators.ranking import dealt_in_order, running_max

#: Milliseconds up to which a version is fresh: the catalogue has a limit of its own, the others are due when their cadence is over.
MAX_AGE = {d: s * 1000 for d, s in C.REFRESH_SECONDS.items()} | {"kev": C.KEV_HOURS * 3_600_000}


def _by_dimension(of: str, table: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(of))


def refreshes(attempts: DataFrame, seconds: dict[str, int] | None = None) -> DataFrame:
    """(dimension, version_ms) of attempts (dimension, at_ms, ok): in each window of a dimension's cadence the first that succeeded makes a version.

    A failed one makes none, so the last good version stays and the next attempt of the window is a refresh too. Attempts of unknown
    outcome or dimension make none.
    """
    every = _by_dimension("dimension", seconds or C.REFRESH_SECONDS) * 1000
    good = attempts.where(F.coalesce("ok", F.lit(False))).withColumn("window", F.floor(F.col("at_ms") / every))
    return good.where("window is not null").groupBy("dimension", "window").agg(F.min("at_ms").alias("version_ms")).select("dimension", "version_ms")


def as_of(clocks: DataFrame, versions: DataFrame, max_age: dict[str, int] | None = None) -> DataFrame:
    """(dimension, clock_ms, version_ms, age_ms, state) of each of `clocks` (dimension, clock_ms): the newest version (dimension, version_ms) not after it.

    state is ok up to the dimension's greatest age, stale beyond it and unavailable (version and age null) before the first version. Versions
    and clocks are merged in one order, dealt by range, so that a dimension of any number of either is spread over tasks. Repeated clocks
    each have a row.
    """
    none = F.lit(None).cast("long")
    marks = versions.select("dimension", F.col("version_ms").alias("at"), F.col("version_ms").alias("v"), none.alias("clock_ms"))
    marks = marks.unionByName(clocks.select("dimension", F.col("clock_ms").alias("at"), none.alias("v"), "clock_ms"))
    order = [F.col("at"), F.col("v").asc_nulls_last()]  # a version of the same moment is not after it
    dealt, part = dealt_in_order(marks, ["dimension"], order)
    rows = running_max(dealt, part, ["dimension"], order, "v", "version_ms").where("clock_ms is not null")
    age = F.col("clock_ms") - F.col("version_ms")
    state = F.when(F.col("version_ms").isNull(), "unavailable").when(age <= _by_dimension("dimension", max_age or MAX_AGE), "ok").otherwise("stale")
    return rows.select("dimension", "clock_ms", "version_ms", age.alias("age_ms"), state.alias("state"))


def seen_at(clocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (dimension, version_ms, ...) of a dimension as each clock of `as_of` sees them, with the clock."""
    return clocks.where("version_ms is not null").select("dimension", "version_ms", "clock_ms").join(rows, ["dimension", "version_ms"])


def states_at(ids: DataFrame, clocks: DataFrame, rows: DataFrame) -> DataFrame:
    """(clock_ms, cve, kev_state, epss_state, score, ssvc_state) of ids (cve) at the clocks of `as_of`, by the versions that they see.

    `rows` are those of all versions (dimension, version_ms, cve, score, exploitation). Without a version a state is unavailable; a listed
    id isn't looked up for an assessment, whatever version of it there is.
    """
    have = clocks.groupBy("clock_ms").pivot("dimension", ["kev", "epss", "ssvc"]).agg(F.max("version_ms"))
    moments = have.agg(F.collect_list(F.struct(*have.columns)).alias("moments"))  # one row: the clocks are few
    asked = ids.select("cve").join(F.broadcast(moments)).select("cve", F.inline("moments"))
    said = seen_at(F.broadcast(clocks), rows)  # not the rows: written ones may look small enough by their compressed files
    for d, value in (("kev", F.lit(True)), ("epss", F.col("score")), ("ssvc", F.col("exploitation"))):
        asked = asked.join(said.where(F.col("dimension") == d).select("clock_ms", "cve", value.alias(f"{d}_said")), ["clock_ms", "cve"], "left")
    state = lambda d, yes, no: F.when(F.col(d).isNull(), "unavailable").when(F.col(f"{d}_said").isNotNull(), yes).otherwise(no)
    kev = state("kev", "listed", "not-listed")
    return asked.select("clock_ms", "cve", kev.alias("kev_state"), state("epss", "scored", "no-row").alias("epss_state"), F.col("epss_said").alias("score"), F.when(kev == "listed", "skipped").otherwise(state("ssvc", "assessed", "not-assessed")).alias("ssvc_state"))
