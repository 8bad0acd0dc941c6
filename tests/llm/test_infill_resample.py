import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import infill as I
from tidewire.llm import resample as R

# ---- fill-in-middle ----


def cut(key, text):
    """(n, form, prefix, middle, suffix) by the rule, on a Python string."""
    t = text or ""
    n = len(t)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    return n, form, t[:a], t[a:b], t[b:]


def expected(key, text):
    n, form, p, m, s = cut(key, text)
    out = {"plain": p + m + s, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    return key, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), out


def infilled(df):
    rows = I.transformed(df).withColumn("back", I.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == (r["text"] or "") for r in rows)
    return sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in rows), key=repr)


def test_infill_of_hard_texts(spark, make, hard):
    rows = hard + [(100, "a\r\nb c\x00"), (101, "<P> inside"), (102, "x<M>"), (103, "<<<P"), (104, "😀é" * 500), (105, "<" * 300), (106, ">S>M><" * 70)]
    assert infilled(make(rows)) == sorted((expected(*r) for r in rows), key=repr)


def test_infill_of_all_forms_and_lengths(spark, make):
    rows = [(k, "".join(chr(0x61 + (k * j) % 0x3000) for j in range(k % 200))) for k in range(600)]
    got = infilled(make(rows))
    assert got == sorted((expected(*r) for r in rows), key=repr)
    forms = Counter(r[2] for r in got)
    assert 30 < forms["plain"] < 100 and 70 < forms["spm"] < 140


def test_offsets_of_stretches(monkeypatch):
    monkeypatch.setattr(I, "STRETCH", 2 * I.RUN)
    text = "語a\n😀" * 333
    o = I.Offsets(text)
    assert o.n == len(text) and [o.at(k) for k in range(0, len(text) + 1, 7)] == list(range(0, len(text) + 1, 7))
    assert I.Offsets("").n == 0


def test_infill_of_no_rows_and_clashing_columns(spark, make):
    assert I.transformed(make([])).count() == 0
    clash = make([(1, "abc")]).withColumn("form", F.lit(7)).withColumn("key_text", F.lit("k"))
    r = I.transformed(clash).first()
    assert r["key_text"] == "k" and r["form"] == cut(1, "abc")[1]
    with pytest.raises(ValueError):
        I.transformed(make([]).withColumnRenamed("text", "output"), text="output")


def test_infill_by_other_parameters(spark, make):
    rows = [(k, "some words of text") for k in range(200)]
    assert {r["form"] for r in I.transformed(make(rows), rate=0).collect()} == {"plain"}
    assert {r["form"] for r in I.transformed(make(rows), rate=100, suffix_first=100).collect()} == {"spm"}


# ---- importance resampling ----


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode()


def features(text, orders):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return len(w), [zlib.crc32(b" ".join(w[i : i + g])) % 10_000 for g in range(1, orders + 1) for i in range(len(w) - g + 1)]


def brute(rows, target, orders, share=10, least=20):
    made = [features(t, orders) for _, t in rows]
    s, t = Counter(x for _, f in made for x in f), Counter(x for text in target for x in features(text, orders)[1])
    sn, tn = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sn + 10_000) / ((s[b] + 1) * (tn + 10_000))))
    out = []
    for (key, _), (words, f) in zip(rows, made, strict=True):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    place = {id(r): k + 1 for k, r in enumerate(may[: share * len(may) // 100])}
    return sorted(([r[0], *r[2:], place.get(id(r))] for r in out), key=repr)


def ranked(spark, make, rows, target, orders, **more):
    docs, goal = make(rows), make(list(enumerate(target)))
    out = R.ranked(R.scored(docs, R.gains(docs, goal, orders=orders), orders=orders, keep_text=False), **more)
    return sorted(([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in out.collect()), key=repr)


@pytest.mark.parametrize("orders", [1, 2, 4])
def test_resampling_against_brute_force(spark, make, hard, prose, orders):
    rows = hard + [(200 + k, prose(k % 30, 15 + k % 40) + " Shared Words") for k in range(150)] + [(500, "shared-words " * 40)] * 2
    target = [prose(k, 60) for k in range(4)] + [None, "shared words"]
    assert ranked(spark, make, rows, target, orders) == brute(rows, target, orders)


def test_composed_crcs():
    text = "Ab ccc dddd-é 語語 " + "w" * 100 + " " + " ".join("xyz"[: 1 + k % 3] * (1 + k % 70) for k in range(80))
    buf = np.frombuffer(text.encode(), np.uint8)
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    n, made = R.feature_crcs(buf, np.array([0, len(buf)]), 5)
    assert n.tolist() == [len(words)]
    for g, (crc, _) in enumerate(made, 1):
        assert crc.tolist() == [zlib.crc32(b" ".join(words[i : i + g])) for i in range(len(words) - g + 1)]


def test_shift_is_that_of_zero_bytes():
    sizes = np.array([0, 1, 2, 3, 7, 8, 100, 4097, 1 << 20])
    at = zlib.crc32(b"left")
    for n, got in zip(sizes.tolist(), R.shifted(np.full(len(sizes), at, np.uint32), sizes).tolist(), strict=True):
        assert got ^ zlib.crc32(b"\x05" * n) == zlib.crc32(b"left" + b"\x05" * n)


def test_ties_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(k % 50, 30, 7) for k in range(100)] + [(None, 30, 7), (3, 5, 99)], "doc_id long, n_words long, score long")
    out = R.ranked(rows, share=20).where("rank is not null").orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"]) for r in out] == [(k // 2, k + 1) for k in range(20)]


def test_drawn_rows_are_whole(spark, make, prose):
    rows = [(k, prose(k, 30)) for k in range(95)] + [(7, prose(7, 30))] * 5
    docs, goal = make(rows), make([(0, prose(3, 30))])
    out = R.resampled(docs, goal, orders=2, share=30).collect()
    want = [r for r in brute(rows, [prose(3, 30)], 2, share=30) if r[4] is not None]
    assert sorted([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in out) == sorted(want)
    assert all(r["text"] == prose(r["doc_id"], 30) for r in out) and len(out) == 30


def test_resampling_of_no_rows(spark, make):
    assert ranked(spark, make, [], ["a b"], 1) == []
    assert R.resampled(make([(1, "too few")]), make([])).count() == 0
    with pytest.raises(ValueError):
        R.scored(make([]).withColumnRenamed("doc_id", "score"), np.zeros(5, np.int64), key="score")
