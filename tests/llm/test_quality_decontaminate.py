import hashlib
import re
from collections import Counter

import pytest

from tidewire.llm import decontaminate as B
from tidewire.llm import quality as Q


def measures(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(g)
    rep = {p for i, x in enumerate(g) if n[x] > 1 for p in (i, i + 1, i + 2)}
    full = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(rep)


def test_measures(spark, make, hard, prose):
    rows = [*hard, (20, "a b c a b c a b\nx\nx\n y\nx"), (21, "# * $ % & | < > # [ ]"), (22, prose(3) + "\n" + prose(3)), (23, "l\nl\n\nl"), (24, "é|é é|é é|é é|é")]
    out = Q.judged(make(rows), report=True).collect()
    assert [tuple(r[c] for c in ("n_words", "n_word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in out] == [measures(r[1]) for r in rows]
    for r, row in zip(out, rows, strict=True):
        w, _, _, _, rep = measures(row[1])
        assert r["base_ok"] == (not (w < 50 or 100 * rep > 50 * w))


def test_order_does_not_change_the_verdict(spark, make, prose, hard):
    import random

    import numpy as np
    import pyarrow as pa

    from tidewire.llm import _text as X

    texts = [t for _, t in hard] + [prose(k) for k in range(30)] + [prose(31).upper(), "#### " * 80, prose(32).replace(" ", " | ")]
    _, _, buf, off = next(X.pieces(pa.record_batch({"t": pa.array(texts, pa.string())}), "t", 1 << 30))
    want = None
    for seed in range(5):
        rules = Q.rules()
        random.Random(seed).shuffle(rules)
        ok = Q.cascade(Q.Batch(buf, off), rules) < 0
        want = ok if want is None else want
        assert np.array_equal(ok, want)
    assert want[len(hard) : len(hard) + 30].all() and not want[-3:].any()


def test_estimates_come_best_first():
    e = Q.estimate(["x " * 100, "good words " * 3, None, ""], Q.rules())
    assert [x.worth for x in e] == sorted((x.worth for x in e), reverse=True)


def test_the_order_depends_on_the_rows_alone(spark, make, prose, hard):
    rows = [*hard, *((100 + k, prose(k)) for k in range(40)), *((200 + k, prose(k, 20)) for k in range(20)), *((300, prose(1)) for _ in range(50))]
    orders = {tuple(r.name for r in Q.plan(make(rows[::step]).repartition(n), Q.rules(), sample_rows=30)) for n, step in ((1, 1), (5, 1), (3, -1))}
    assert len(orders) == 1
    assert Q.judged(make(rows)).where("failed_rule is not null").collect() == Q.judged(make(rows)).where("failed_rule is not null").collect()


def test_kept_rows_keep_their_columns(spark, prose):
    docs = spark.createDataFrame([(1, prose(1), "mine"), (2, "too short", "x"), (3, None, "y")], "doc_id long, text string, failed_rule string")
    assert [tuple(r) for r in Q.kept(docs).collect()] == [(1, prose(1), "mine")]
    assert Q.kept(docs.limit(0)).count() == 0 and Q.judged(docs, report=True).count() == 3


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=10):
    out = []
    for d in docs:
        w, hit, who = words(d[1]), set(), set()
        for item, text in items:
            b = words(text)
            n = min(k, len(b))
            win = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n and item is not None else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in win:
                    hit |= set(range(i, i + n))
                    who.add(str(item))
        out.append((len(w), len(hit), sorted(who)))
    return out


ITEMS = [(2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (10, "Rare-Word"), (3, "ÉTÉ 2024"), (4, ""), (5, None), (6, "!!! ..."), (None, "null id"), (7, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]


def cases(prose, hard):
    run = "alpha, BETA gamma-delta epsilon zeta eta theta iota kappa"
    return [*hard, (30, f"{prose(1)} {run} lambda. {prose(2)}"), (31, run.replace("kappa", "kappas")), (32, "rare word, RARE word; rareword"), (33, f"{run} {run}"), (34, "été 2024 ÉTÉ 2024")]


def test_scan_is_brute_force(spark, make, prose, hard):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = cases(prose, hard)
    for block in (B.BLOCK_BYTES, 20):
        got = B.scan(make(rows), items, block_bytes=block).select("doc_id", "text", "n_words", "spans", "items").collect()
        want = brute(rows, ITEMS)
        key = lambda x: str(x)
        have = sorted(((r["doc_id"], r["n_words"], sum(s["w1"] - s["w0"] for s in r["spans"]), sorted(r["items"])) for r in got), key=key)
        full = sorted(((r[0], *w) for r, w in zip(rows, want, strict=True)), key=key)
        assert have == full


def test_windows_are_bounded():
    """A window takes 20 bytes and the texts are held once."""
    texts = [" ".join(f"w{i}x{k}" for k in range(200)) for i in range(500)]
    (got,) = B.windows(texts, [str(i) for i in range(500)]).values()
    assert len(got.keys) == 500 * 191 and got.nbytes <= 20 * len(got.keys) + sum(map(len, texts)) + 500
    at = 12_345
    said = got.said[got.first[at] : got.end[at]].tobytes().decode()
    assert said in texts[got.item[at]] and len(said.split()) == 10


def test_a_block_that_is_too_large_is_an_error(spark, make, prose, monkeypatch):
    monkeypatch.setattr(B, "BROADCAST_BYTES", 100)
    with pytest.raises(ValueError):
        B.scan(make([(1, "a")]), spark.createDataFrame([(1, prose(1))], "item_id long, text string"))


def test_blocks_keep_every_row(spark, make, prose, hard):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = cases(prose, hard)
    rows += [rows[-5]] * 3 + [(40, rows[-5][1])]  # a hit row repeated, and a copy of its text
    for block in (B.BLOCK_BYTES, 20):
        got = B.scan(make(rows), items, block_bytes=block).collect()
        have = sorted(str((r["doc_id"], r["n_words"], sum(s["w1"] - s["w0"] for s in r["spans"]), r["items"])) for r in got)
        assert have == sorted(str((r[0], *w)) for r, w in zip(rows, brute(rows, ITEMS), strict=True))
        assert B.cleaned(make(rows), items, drop_share=1.0, block_bytes=block).count() == len(rows)


def test_cleaned(spark, prose):
    docs = spark.createDataFrame([(1, f"Before it. alpha beta gamma delta epsilon zeta eta theta iota kappa! {prose(1)}", 1, "s"), (2, "rare word", 2, None), (3, prose(2), 3, None), (4, None, 4, None), (5, "", 5, None)], "doc_id long, text string, n_words int, spans string")
    out = {r["doc_id"]: r for r in B.cleaned(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert sorted(out) == [1, 3, 4, 5] and out[1]["n_words"] == 1 and out[1]["spans"] == "s"
    assert out[1]["text"].split() == f"Before it. ! {prose(1)}".split() and out[3]["text"] == prose(2) and out[4]["text"] is None


def test_empty(spark, make, prose):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["items"] for r in B.scan(make([(1, prose(1))]), none).collect()] == [[]]
    assert B.scan(make([]), none).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
