"""Mined rules are looked up by one token each."""

from tidewire.llm import urls as U


def test_a_rule_has_one_row_with_its_rarest_token(spark):
    rows = [(["a", "b", "c"], True)] * 4 + [(["a", "b"], False), (["b", "c"], False), (["a", "c"], False), (["b", "x"], False)]
    mined = U.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.2, 0.9, 1).select("rule", "token", "items").collect()
    assert [(r["rule"], r["items"]) for r in mined] == [("a b c", ["a", "b", "c"])] and mined[0]["token"] == "a"  # a and c come in six rows, b in seven
