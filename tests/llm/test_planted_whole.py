"""The planted rules are mined on all tokens of a page."""

import os

import duckdb
import pytest

from tidewire.llm import urls as U

SF = "/root/testdata/sf0.01"
CUT = f" WHERE i <= {U.TOKENS})"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_planted_rules_of_all_tokens(spark):
    """Held against the statement without the cut to a page's rarest tokens; six pages of sf0.01 have more."""
    assert U.PLANTED_SQL.count(CUT) <= 1
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = duck.execute(f"SELECT page_id, rule, verdict, mined_rule FROM ({U.PLANTED_SQL.replace(CUT, ')')})").fetchall()
    got = [tuple(r) for r in U.planted_url_rules(spark, SF).select("page_id", "rule", "verdict", "mined_rule").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
