"""Streams that keep state by key and act on time: polls that don't come, and marks that expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire import config as C


def overdue_polls(polls: DataFrame, allowed_ms: int, delay: str = "0 seconds") -> DataFrame:
    """(stream, gap_from, gap_to, reason) of a stream of polls (stream, to_ms, ok), as time goes by.

    Event time is a poll's end, and a poll is judged once the watermark (`delay` behind the latest end) has passed it, in the order of ends: one
    that comes more than `allowed_ms` after the last successful end before it is `missed-poll`, as in a report over all polls. Meanwhile, when
    the watermark has gone that far and no poll has come, a timer says `overdue` once, with the watermark as gap_to. Polls without a stream
    or an end are left out, and so are those whose end the watermark had passed; one of unknown outcome is a failure. State of a stream: its last successful end and the polls not judged yet,
    which are those of one batch and of the delay.
    """

    def act(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, told, ends, oks = state.get if state.exists else (None, False, [], [])
        ends, oks = list(ends), list(oks)
        if not state.hasTimedOut:
            for rows in chunks:
                ends += rows["to_ms"].tolist()
                oks += rows["ok"].tolist()
        now, out = state.getCurrentWatermarkMs(), []
        due = sorted((e, o) for e, o in zip(ends, oks, strict=True) if e <= now)
        for end, ok in due:
            if last is not None and end - last > allowed_ms:
                out.append((last, end, "missed-poll"))
            if ok:
                last, told = end if last is None else max(last, end), False
        rest = [(e, o) for e, o in zip(ends, oks, strict=True) if e > now]
        if last is not None and not told and now - last > allowed_ms:
            out.append((last, now, "overdue"))
            told = True
        state.update((last, told, [e for e, _ in rest], [o for _, o in rest]))
        wait = [e for e, _ in rest] + ([last + allowed_ms + 1] if last is not None and not told else [])
        if wait:
            state.setTimeoutTimestamp(max(min(wait), now + 1))
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["stream", "gap_from", "gap_to", "reason"])

    rows = polls.where("stream is not null and to_ms is not null").select("stream", "to_ms", F.coalesce("ok", F.lit(False)).alias("ok"), F.timestamp_millis("to_ms").alias("at"))
    keyed = rows.withWatermark("at", delay).groupBy("stream")
    return keyed.applyInPandasWithState(act, "stream string, gap_from long, gap_to long, reason string", "last long, told boolean, ends array<long>, oks array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)


def live_marks(actions: DataFrame, delay: str = "0 seconds", keep_ms: int = C.MARK_MS) -> DataFrame:
    """(user_id, article_id, kind, at_ms, moment_ms) of each change of a mark by a stream of actions (user_id, article_id, kind, action, at_ms).

    `toggle` sets a mark that isn't there and removes one that is; `add` sets one that isn't there and leaves one that is. at_ms is null where a mark
    goes; the latest moment_ms of a key tells what holds. A mark lives `keep_ms`: it goes with the timer of its end, so
    that state grows with the marks that live and not with all that ever were, and an action after the end finds none. Actions of one key are taken by
    their time within a batch, an `add` after a `toggle` of the same moment, and batches in the order in which they come. Rows with a null in any
    column or another action do nothing, nor do those that the watermark had passed. State is by reader: one call takes all that a batch has of a reader,
    and holds the marks of the last `keep_ms`.
    """

    def act(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        marks = {(a, k): at for a, k, at in zip(*state.get, strict=True)} if state.exists else {}
        now, out, seen = state.getCurrentWatermarkMs(), [], set()
        if not state.hasTimedOut:
            rows = [r for c in chunks for r in zip(*(c[x].tolist() for x in ("article_id", "kind", "action", "at_ms")), strict=True)]
            rows.sort(key=lambda r: (r[3], r[2] == "add"))
            for article, kind, action, moment in rows:
                mark = (article, kind)
                at = marks.pop(mark, None)
                if at is not None and moment - at >= keep_ms:
                    at = None
                was, at = at, None if at is not None and action == "toggle" else moment if at is None else at
                if at != was or mark not in seen:
                    out.append((*mark, at, moment))
                seen.add(mark)
                if at is not None:
                    marks[mark] = at
        for mark, at in [x for x in marks.items() if x[0] not in seen and x[1] + keep_ms <= now]:
            del marks[mark]
            out.append((*mark, None, at + keep_ms))
        if marks:
            state.update(([a for a, _ in marks], [k for _, k in marks], list(marks.values())))
            state.setTimeoutTimestamp(max(min(marks.values()) + keep_ms, now + 1))
        elif state.exists:
            state.remove()
        if out:
            articles, kinds, ats, moments = zip(*out, strict=True)
            yield pd.DataFrame({"user_id": key[0], "article_id": articles, "kind": kinds, "at_ms": pd.array(ats, "Int64"), "moment_ms": moments})

    columns = ["user_id", "article_id", "kind", "action", "at_ms"]
    good = actions.where(" and ".join(f"{c} is not null" for c in columns)).where(F.col("action").isin("toggle", "add"))
    rows = good.select(*columns, F.timestamp_millis("at_ms").alias("at")).withWatermark("at", delay).groupBy("user_id")
    return rows.applyInPandasWithState(act, "user_id long, article_id long, kind string, at_ms long, moment_ms long", "articles array<long>, kinds array<string>, ats array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def latest_marks(changes: DataFrame) -> DataFrame:
    """(user_id, article_id, kind, at_ms) of the marks that hold after all changes."""
    last = changes.groupBy("user_id", "article_id", "kind").agg(F.max_by("at_ms", F.struct("moment_ms", F.col("at_ms").isNotNull())).alias("at_ms"))
    return last.where("at_ms is not null")
