"""Connected components over edges that may be of any number and degree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.plans.store import discard, save

#: Links that one task settles by itself, at most; more of them take rounds over all tasks, with the same result.
ONE_TASK = 8192


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): the least of each u and its neighbours v, pre-aggregated in each task."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether every u has one neighbour v, and no v is a u: then each v is the root of its component."""
    one = F.lit(1).alias("leaf")
    ends = edges.select(F.col("u").alias("x"), F.col("v").alias("m"), one).unionByName(edges.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("m"), F.lit(0).alias("leaf")))
    seen = ends.groupBy("x").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.min("leaf").alias("lo"), F.max("leaf").alias("hi"))
    return seen.where("hi = 1 and (lo = 0 or a <> b)").isEmpty()


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, root) of few links (u, v), which one task settles."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for rb in batches:
        for u, v in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in list(root)], pa.int64())], names=["v", "root"])


def components(edges: DataFrame, rounds: int = 60, one_task: int | None = None) -> DataFrame:
    """(v, root) of every vertex that has an edge in `edges` (a, b: long); root is the least vertex of its component.

    Alternates large and small stars. Each half-step is a pre-aggregated minimum and a join that adaptive
    execution can split, so a hub of any degree meets no single task. Each round is written to the shared folder, and then the one before is deleted;
    there is none once all links are stars. Few links, `one_task` or ONE_TASK at most, are settled by one task.
    Null ends and self links are ignored.
    """
    e = save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a <> b").distinct(), "links")
    if e.count() <= (ONE_TASK if one_task is None else one_task):
        return e.coalesce(1).mapInArrow(_settled, "v long, root long")
    for _ in range(rounds):
        if _stars(e):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m = _least(large)
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        done, e = e, save(small, "links")
        discard(done)  # no later round reads it
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select(F.col("v"), F.col("v").alias("root"))).distinct()
