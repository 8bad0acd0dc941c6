"""Sets of feeds published as one commit: readers see all bodies of a version or all of the one before."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans.store import _place, exists, remove

#: Sets that are kept, the present one included, so that a reader who has found one can read it to its end.
KEPT = 8


def _commits(spark: SparkSession, path: str) -> list[int]:
    where, files = _place(spark, f"{path}/commits")
    files.mkdirs(where)
    return sorted(int(n) for n in (f.getPath().getName() for f in files.listStatus(where)) if n.isdigit())


def _version(spark: SparkSession, path: str, number: int) -> str:
    return json.loads(spark.read.text(f"{path}/commits/{number:012d}", wholetext=True).first()["value"])["version"]


def publish(bodies: DataFrame, path: str, kept: int = KEPT) -> None:
    """Publish bodies (name, body) as the present set, and let all but the last `kept` go; a failure leaves the one before.

    Tasks write a text file for each body under a version's folder; the commit, a small file, is what makes it the present one. One
    publisher at a time.
    """
    spark, path, version = bodies.sparkSession, path.rstrip("/"), uuid.uuid4().hex
    try:
        bodies.select("name", F.coalesce("body", F.lit("")).alias("value")).write.partitionBy("name").option("maxRecordsPerFile", 1).text(f"{path}/versions/{version}")
    except Exception:
        remove(spark, f"{path}/versions/{version}")
        raise
    found = _commits(spark, path)
    draft, files = _place(spark, f"{path}/commits/.{version}")
    out = files.create(draft)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    number = found[-1] + 1 if found else 0
    if not files.rename(draft, _place(spark, f"{path}/commits/{number:012d}")[0]):
        raise RuntimeError(f"set {number} of {path} was not committed")
    for old in found[: max(0, len(found) + 1 - kept)]:
        remove(spark, f"{path}/commits/{old:012d}")
    held = {_version(spark, path, n) for n in _commits(spark, path)}
    for f in files.listStatus(_place(spark, f"{path}/versions")[0]):
        if f.getPath().getName() not in held:  # of an old set, or of one whose publisher failed
            files.delete(f.getPath(), True)


def published(spark: SparkSession, path: str) -> DataFrame:
    """(name, body) of the present set; no rows before the first one."""
    if not exists(spark, f"{path}/commits") or not (found := _commits(spark, path)):
        return spark.createDataFrame([], "name string, body string")
    rows = spark.read.schema("value string, name string").text(f"{path}/versions/{_version(spark, path, found[-1])}", wholetext=True)
    return rows.select("name", F.left("value", F.length("value") - 1).alias("body"))  # a text file ends with a line feed of its own
