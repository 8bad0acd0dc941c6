"""Marks of a reader are kept together."""

from tidewire import config as C
from tidewire.plans.store import new_path
from tidewire.streaming import timers as T

KIND = "user_id long, article_id long, kind string, action string, at_ms long"


def test_state_has_a_row_for_each_reader(spark):
    source, out, check = (new_path(spark, n) for n in ("in", "out", "check"))

    def take(rows):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(source)
        stream = T.live_marks(spark.readStream.schema(KIND).parquet(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        changes = spark.read.schema(stream.schema).parquet(out)
        return query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"], sorted(tuple(r) for r in T.latest_marks(changes).collect())

    held, marks = take([(u, a, "read", "add", 1000 + a) for u in (1, 2) for a in range(30)])
    assert held == 2 and len(marks) == 60
    # time goes on with reader 1: marks of both end, each at its own time, and a toggle removes one that lives
    held, marks = take([(1, 29, "read", "toggle", C.MARK_MS + 1010), (1, 99, "flag", "add", C.MARK_MS + 1020)])
    assert held == 2 and marks == [(1, a, "read", 1000 + a) for a in range(21, 29)] + [(1, 99, "flag", C.MARK_MS + 1020)] + [(2, a, "read", 1000 + a) for a in range(21, 30)]
