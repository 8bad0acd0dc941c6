"""What versions of dimensions say at moments: rows of the versions aren't broadcast, however well their files compress."""

import re

from pyspark.sql import functions as F

from tidewire.operators import dimensions as D
from tidewire.plans.store import save


def test_rows_of_versions_are_not_broadcast(spark):
    each = F.concat(F.lit("CVE-2024-"), F.col("id").cast("string"))
    rows = save(spark.range(50_000).select(F.explode(F.array(*map(F.lit, ("kev", "epss", "ssvc")))).alias("dimension"), F.lit(1000).cast("long").alias("version_ms"), each.alias("cve"), F.lit(0.5).alias("score"), F.lit("poc").alias("exploitation")), "versions")
    at = D.as_of(spark.createDataFrame([(d, 2000) for d in ("kev", "epss", "ssvc")], "dimension string, clock_ms long"), rows.select("dimension", "version_ms").distinct())
    out = D.states_at(spark.createDataFrame([("CVE-2024-7",), ("CVE-2024-x",)], "cve string"), at, rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastExchange.*\n(?:.*(?:Filter|Project).*\n)*.*FileScan parquet \[[^]]*\bcve#", plan)
    assert sorted(tuple(r) for r in out.collect()) == [(2000, "CVE-2024-7", "listed", "scored", 0.5, "skipped"), (2000, "CVE-2024-x", "not-listed", "no-row", None, "not-assessed")]
