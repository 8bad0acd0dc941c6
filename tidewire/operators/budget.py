"""Analytics of operational logs: row deduplication, interval coverage, metering and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import scalars as S
from tidewire.operators.ranking import dealt_in_order, medians, running_max
from tidewire.plans import keyed as K
from tidewire.plans.store import save


def take_new(rows: DataFrame, seen: DataFrame | None = None, order: str = "pos") -> DataFrame:
    """The first row of each `key` that isn't in `seen` (key); rows without a key all stay."""
    keyed = rows.where("key is not null")
    first = keyed.groupBy("key").agg(F.min(order).alias("_first"))
    if seen is not None:
        first = first.join(seen.select("key").distinct(), "key", "left_anti")
    kept = keyed.join(first, "key").where(F.col(order) == F.col("_first")).drop("_first")
    return kept.select(*rows.columns).unionByName(rows.where("key is null"))


def take_new_kept(rows: DataFrame, history: str, number: int, order: str = "pos", buckets: int = K.BUCKETS) -> DataFrame:
    """`take_new` as batch `number` of a capture whose keys of all batches are kept in the table at `history`, which then has this one's too.

    Of the history only the buckets are read that may hold a key of the rows. A batch that comes again gives the same rows.
    """
    rows = save(rows, "rows")
    seen = K.held(rows.where("key is not null").select("key").distinct(), history, number, "key string", "key", buckets)
    new = save(take_new(rows, seen, order), "new")
    K.append(new.where("key is not null").select("key").distinct(), history, number, "key", buckets)
    return new


def _successful(polls: DataFrame) -> DataFrame:
    """Polls that succeeded; an unknown outcome is none. Polls without a column `ok` are taken for successful."""
    return polls.where(F.coalesce("ok", F.lit(False))) if "ok" in polls.columns else polls


def _windows(polls: DataFrame) -> DataFrame:
    return _successful(polls).where("from_ms is not null and to_ms is not null and to_ms >= from_ms")


def islands(polls: DataFrame, period: tuple[int, int] | None = None) -> DataFrame:
    """(start, stop) of the maximal stretches that windows (from_ms, to_ms) of successful polls cover, clipped to the period; touching windows join.

    Windows are dealt by range of their start. A part takes over from those before how far they reach, and then the start of the
    stretch that is open at its end; so no task sees more than its part, however many windows a stretch has.
    """
    rows = _windows(polls).select(F.col("from_ms").alias("s"), F.col("to_ms").alias("e"))
    if period is not None:
        rows = rows.select(F.greatest("s", F.lit(period[0])).alias("s"), F.least("e", F.lit(period[1])).alias("e"))
    order = [F.col("s"), F.col("e")]
    dealt, part = dealt_in_order(rows.where("e > s"), [], order)
    marked = running_max(dealt, part, [], order, "e", "reach")
    marked = save(marked.withColumn("start", F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach")), F.col("s"))).drop("reach"), "marked")
    begun = running_max(marked, part, [], order, "start", "open").select(F.coalesce("start", "open").alias("start"), "e")
    return begun.groupBy("start").agg(F.max("e").alias("stop"))


def coverage(polls: DataFrame, period: tuple[int, int] | None = None) -> DataFrame:
    """One row: covered_min and period_min."""
    span = _windows(polls).agg(F.coalesce(F.min("from_ms"), F.lit(0)).alias("a"), F.coalesce(F.max("to_ms"), F.lit(0)).alias("b"))
    total = islands(polls, period).agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias("c"))
    long = (F.lit(period[1] - period[0]) if period else F.col("b") - F.col("a")) / 60000.0
    return span.join(total.hint("broadcast")).select((F.col("c") / 60000.0).alias("covered_min"), long.alias("period_min"))  # one row each


def default_period(polls: DataFrame) -> DataFrame:
    """One row (from_ms, to_ms): from the first successful window's start on, a day at least."""
    span = _windows(polls).agg(F.min("from_ms").alias("a"), F.max("to_ms").alias("b"))
    return span.select(F.col("a").alias("from_ms"), F.greatest("b", F.col("a") + C.DAY_MIN * 60000).alias("to_ms"))


def median_bytes(rows: DataFrame) -> DataFrame:
    """(p, median_bytes) of the successful rows of each producer: of two middle values their mean rounded up."""
    both = medians(rows.where("ok = 1"), "p", "bytes")
    return both.select("p", F.expr("lower + (upper - lower + 1) div 2").alias("median_bytes"))


def producer_stats(rows: DataFrame) -> DataFrame:
    """(pos, p, lines, ok, fail, rcw, units, median_bytes, cpu_ms) of each producer, those without rows too."""
    spark = rows.sparkSession
    own = rows.groupBy("p").agg(
        F.count("*").alias("lines"), F.count_if(F.col("ok") == 1).alias("ok"), F.count_if(F.col("ok") == 0).alias("fail"), F.sum("rcW").alias("rcw"), F.sum(S.write_units("rcW", "bytes")).alias("units"),
        F.sum("cpuMs").alias("cpu_ms"),
    )
    every = spark.createDataFrame(list(enumerate(C.PRODUCERS)), "pos int, p string")
    return every.join(own, "p", "left").join(median_bytes(rows), "p", "left").select("pos", "p", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("lines", "ok", "fail", "rcw", "units", "median_bytes", "cpu_ms")))


def meter_status(total: Column, covered_min: Column, allot: Column) -> Column:
    """Exact: over the allotment of 30 days, over 60 % of it, or neither, as projected from the covered minutes."""
    whole = lambda c: F.floor(c + 0.5).cast("decimal(38,0)")
    used = (whole(total) * F.lit(C.DAY_MIN * 30 * 60000).cast("decimal(15,0)")).cast("decimal(38,0)")
    have = (whole(covered_min * 60000) * whole(allot).cast("decimal(15,0)")).cast("decimal(38,0)")
    return F.when(used > have, "OVER-100").when(used * F.lit(100).cast("decimal(3,0)") > have * F.lit(60).cast("decimal(2,0)"), "OVER-60").otherwise("OK")


def read_units(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """One row (units, known): modelled reads. Each render reads edition, catalogue and its look-ups; a stale or missed feed request an edition."""
    size = lambda p: F.coalesce(F.max(F.when(F.col("p") == p, F.col("median_bytes"))), F.lit(0)).alias("ed" if p == "edition" else "kv")
    unit = lambda c: F.ceil(F.col(c) / C.UNIT_BYTES)
    sizes = median_bytes(rows.where("p in ('edition', 'kev')")).agg(size("edition"), size("kev"))
    renders = rows.agg(F.count_if(F.col("p") == "render").alias("renders"), F.coalesce(F.sum(F.when(F.col("p") == "render", F.greatest(F.lit(0), F.col("rcR") - 2))), F.lit(0)).alias("more"))
    misses = requests.agg(F.count_if(F.col("path").rlike(r"^/feed(\.xml|\.json|/)") & F.col("cache").rlike(r"^(?i:stale|miss)\z")).alias("misses"))
    total = F.col("renders") * (unit("ed") + unit("kv")) + F.col("more") + F.col("misses") * unit("ed")
    return sizes.join(renders.hint("broadcast")).join(misses.hint("broadcast")).select(F.when(F.col("ed") == 0, 0).otherwise(total).cast("long").alias("units"), (F.col("ed") != 0).alias("known"))  # one row each


def report(rows: DataFrame, requests: DataFrame, polls: DataFrame, allot: dict[str, float], least: float = 0.9, period: tuple[int, int] | None = None) -> list[str]:
    """Lines of the report, from a few aggregates; too little coverage is said instead."""
    if period is None:
        first = default_period(polls).first()
        period = (first["from_ms"], first["to_ms"]) if first["from_ms"] is not None else (0, 0)
    cov = coverage(polls, period).first()
    covered, whole = cov["covered_min"], cov["period_min"]
    if covered <= 0 or covered / whole < least:
        return ["INSUFFICIENT_COVERAGE"]
    day = lambda x: x * C.DAY_MIN / covered
    stats = producer_stats(rows).orderBy("pos").collect()
    out = [f"coverage: {round(covered)}/{round(whole)} min ({covered / whole * 100:.1f}%)", "", "| producer | lines/day | ok/fail | write ops/day | write units/day | median bytes | cpu s/day |", "| --- | ---: | ---: | ---: | ---: | ---: | ---: |"]
    for s in stats:
        note = " (overlapping, not summed)" if s["p"] == "ssvc" else ""
        out.append(f"| {s['p']} | {day(s['lines']):.1f} | {s['ok']}/{s['fail']} | {day(s['rcw']):.1f} | {day(s['units']):.1f} | {s['median_bytes']} | {day(s['cpu_ms']) / 1000:.1f}{note} |")
    reads = read_units(rows, requests).first()
    cpu = next(s["cpu_ms"] for s in stats if s["p"] == "edition")
    writes = sum(s["units"] for s in stats)
    meters = [("writes", writes, allot["writes"]), ("reads", reads["units"] if reads["known"] else None, allot["reads"]), ("compose cpu ms", cpu, allot["cpu_s"] * 1000)]
    out += ["", "| meter | measured per day | projected 30-day month | allotment | % of allotment | status |", "| --- | ---: | ---: | ---: | ---: | --- |"]
    for name, total, most in meters:
        if total is None:
            out.append(f"| {name} | n/a | n/a | {round(most):,} | n/a | UNKNOWN |")
            continue
        used, have = round(total) * C.DAY_MIN * 30 * 60000, round(covered * 60000) * round(most)
        status = "OVER-100" if used > have else "OVER-60" if used * 100 > have * 60 else "OK"
        out.append(f"| {name} | {day(total):.1f} | {round(day(total) * 30):,} | {round(most):,} | {day(total) * 30 / most * 100:.1f}% | {status} |")
    out += ["", "write split by producer (units):", *(f"- {s['p']}: {s['units'] / writes * 100 if writes else 0:.1f}%" for s in stats if s["p"] != "render")]
    return out


def render_reads(ssvc: Column, epss: Column) -> Column:
    """Reads of one render: edition and catalogue, look-ups and batches within their caps."""
    return F.lit(2) + F.least(ssvc, F.lit(C.SSVC_LOOKUPS)) + F.ceil(F.least(epss, F.lit(C.EPSS_IDS)) / C.EPSS_BATCH)


def valid_capture(window_min: Column, interval_min: Column) -> Column:
    """Whether a capture's window (minutes) suits its interval."""
    return (window_min >= 1) & (interval_min >= 1) & (window_min <= 50) & (window_min >= interval_min + 5)


def missed_polls(polls: DataFrame, allowed_ms: int) -> DataFrame:
    """(stream, gap_from, gap_to) of the gaps between consecutive successful polls that are longer than allowed."""
    order = [F.col("from_ms"), F.col("to_ms")]
    dealt, part = dealt_in_order(_successful(polls).select("stream", "from_ms", "to_ms"), ["stream"], order)
    rows = running_max(dealt, part, ["stream"], order, "to_ms", "before")
    return rows.where(F.col("from_ms") - F.col("before") > allowed_ms).select("stream", F.col("before").alias("gap_from"), F.col("from_ms").alias("gap_to"))


def gap_rows(polls: DataFrame, window_ms: int, interval_ms: int) -> DataFrame:
    """(stream, gap_from, gap_to, reason) of what a capture couldn't read: failed or truncated polls, excluded stretches, missed polls.

    `polls` has stream, from_ms, to_ms, ok, failure (cli-exit, timeout or null), truncated and excluded (array of start and end in ms,
    null ends standing for the poll's own).
    """
    failed = polls.where(~F.col("ok")).select("stream", F.col("from_ms").alias("gap_from"), F.col("to_ms").alias("gap_to"), F.coalesce("failure", F.lit("cli-exit")).alias("reason"))
    cut = polls.where("truncated").select("stream", F.col("from_ms").alias("gap_from"), F.col("to_ms").alias("gap_to"), F.lit("truncated").alias("reason"))
    out = polls.select("stream", "from_ms", "to_ms", F.explode("excluded").alias("x")).select("stream", F.coalesce("x.start", "from_ms").alias("gap_from"), F.coalesce("x.end", "to_ms").alias("gap_to"), F.lit("excluded").alias("reason"))
    order = [F.col("to_ms"), F.col("from_ms")]
    dealt, part = dealt_in_order(polls.select("stream", "from_ms", "to_ms", F.when(F.col("ok"), F.col("to_ms")).alias("read_to")), ["stream"], order)
    missed = running_max(dealt, part, ["stream"], order, "read_to", "before").where(F.col("to_ms") - F.col("before") > window_ms - interval_ms).select("stream", F.col("before").alias("gap_from"), F.col("to_ms").alias("gap_to"), F.lit("missed-poll").alias("reason"))
    return failed.unionByName(cut).unionByName(out).unionByName(missed).distinct()
