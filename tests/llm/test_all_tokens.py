"""All tokens of a page are mined, however many it has."""

import itertools
import random

import pytest

from tidewire.llm import urls as U


def brute(rows, need, confidence):
    """Rules by all combinations of all tokens; one with a part, one token less, that is as confident is pruned."""
    sets = {}
    for tokens, bad in rows:
        for n in range(1, len(tokens) + 1):
            for x in itertools.combinations(sorted(tokens), n):
                f, h = sets.get(x, (0, 0))
                sets[x] = (f + 1, h + bad)
    rules = {x: h / f for x, (f, h) in sets.items() if h >= need and h / f >= confidence}
    return {(" ".join(x), len(x), round(c, 9)) for x, c in rules.items() if not any(rules.get(x[:k] + x[k + 1 :], 0) >= c for k in range(len(x)))}


@pytest.mark.parametrize("longest", [1, 13])
def test_rules_of_pages_with_more_than_ten_tokens(spark, monkeypatch, longest):
    """Both ways find what all combinations give; the frequent tokens x and y say "bad" together only and are none of a page's ten rarest."""
    monkeypatch.setattr(U, "LONGEST", longest)
    r = random.Random(5)
    rows = []
    for k in range(60):
        own = r.sample("abcdefghijklm", 9) + (["a", "a2"] if k % 3 == 0 else [])
        own += [["x"], ["y"], ["x", "y"], ["x", "y"]][k % 4]
        rows.append((sorted(set(own)), k % 4 > 1 and k % 20 != 3))
    want = brute(rows, 6, 0.8)
    got = U.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.1, 0.8, 1).select("rule", "n", "confidence").collect()
    assert {(g["rule"], g["n"], round(g["confidence"], 9)) for g in got} == want
    assert len(got) == len(want) and any(set(w[0].split()) >= {"x", "y"} for w in want)


def test_the_most_frequent_of_many_tokens_make_a_rule(spark):
    """Pages of thirty tokens: a rule of the two most frequent ones."""
    rows = [([f"s{k % 3}{j:02d}" for j in range(28)] + ["x", "y"], True) for k in range(14)] + [([f"s{k % 3}{j:02d}" for j in range(28)] + [t], False) for k in range(14) for t in "xy"]
    got = {g["rule"]: g["confidence"] for g in U.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.2, 0.9, 8).select("rule", "confidence").collect()}
    assert got == {"x y": 1.0}
