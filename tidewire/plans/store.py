"""Written intermediate tables: lineage is cut by Parquet files in the shared folder of the session."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an exchange that one task takes at most, about, and tasks at most.
PART_BYTES, MOST_PARTS = 64 << 20, 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (`spark.checkpoint.dir`); where it is unset, a temporary one in local mode, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again; survives the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


#: Folders that `save` wrote and nothing discarded, in order.
_WRITTEN: list[str] = []


def _place(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _place(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    where, files = _place(spark, path)
    files.delete(where, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def discard(saved: DataFrame) -> None:
    """Delete what `save` wrote, where nothing that is still to be computed reads it."""
    remove(saved.sparkSession, saved._written_to)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all that `save` wrote within it: results are to be written or collected before."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in [x for x in _WRITTEN if x not in before]:
            remove(spark, path)


def tasks(spark: SparkSession, size: float = 0) -> int:
    """Tasks of an exchange whose groups meet in memory: those of the session, and more if `size` bytes would be over PART_BYTES each."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(MOST_PARTS, math.ceil(size / PART_BYTES)))


def plan_bytes(df: DataFrame) -> int:
    """Bytes of all that `df` is made of, by the statistics of its sources (compressed ones of files); those that have none count 0."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of `df` has, whatever their case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out
