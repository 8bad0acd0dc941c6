"""The miner of URL rules against SQL, on labels that tell something."""

import os

import duckdb
import pytest

from tidewire.llm import urls as U

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_planted_rules_are_mined(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = duck.execute(f"SELECT page_id, rule, verdict, mined_rule FROM ({U.PLANTED_SQL})").fetchall()
    got = [tuple(r) for r in U.planted_url_rules(spark, SF).select("page_id", "rule", "verdict", "mined_rule").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len({r[3] for r in got if r[3]}) >= 3 and any(r[1] is None and r[2] == "block" for r in got)
