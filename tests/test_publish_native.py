"""Bodies are published without passing through Python."""

from tidewire.plans.store import new_path, save
from tidewire.sources import publish as P


def test_bodies_come_back_as_they_are_and_no_task_runs_python(spark, monkeypatch):
    rows = [("a b/c.xml", "x\n\n"), ("d.json", ""), ("e.json", None), ("f.xml", "\r\nno line feed at the end"), ("f.xml", "of the same name")]
    path, bodies = new_path(spark, "feeds"), save(spark.createDataFrame(rows, "name string, body string").coalesce(1), "bodies")
    monkeypatch.setenv("PYSPARK_PYTHON", "/nowhere/python")  # what a Python data source would start
    monkeypatch.setattr(spark.sparkContext, "pythonExec", "/nowhere/python")
    P.publish(bodies, path)
    monkeypatch.undo()
    assert sorted(tuple(r) for r in P.published(spark, path).collect()) == sorted((n, b or "") for n, b in rows)
