import gzip
import hashlib
import io
import json
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest

from tidewire.llm import _text as X
from tidewire.llm import langid as G
from tidewire.llm import warc as W
from tidewire.plans.store import new_path


def tongue(letters, seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


TONGUES = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "éèàuoiae", "dd": "漢字語文章言"}


def docs(n=40):
    return [(k * 1000 + i, tongue(s, k * 1000 + i), lang) for k, (lang, s) in enumerate(TONGUES.items()) for i in range(n // 4)]


def test_predictions_of_held_out_rows(spark):
    rows = docs(160)
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in G.predicted(table.select("doc_id", "text", G.held_out("doc_id").alias("h")), G.fit(table)).collect()}
    held = [(i, lang) for i, _, lang in rows if out[i]["h"]]
    assert all(out[i]["h"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert len(held) > 20 and sum(out[i]["lang_pred"] == lang for i, lang in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_the_fit_takes_a_repeated_row_once(spark, monkeypatch):
    """Copies neither reach the driver nor crowd out other documents."""
    rows = [r for r in docs(120) if zlib.crc32(str(r[0]).encode()) % 5]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(spark.range(4000).selectExpr("id % 10 * 1000 + 1 as doc_id", f"'{rows[1][1]}' as text", "'aa' as lang"))
    kind, sizes = type(many), []
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (out := real(self), sizes.append(len(out)))[0])
    a, b = G.fit(many, docs_each=20), G.fit(many.distinct(), docs_each=20)
    assert sizes == [80, 80]
    assert all((x == y).all() for x, y in ((a.roots, b.roots), (a.only, b.only), (a.link, b.link), (a.ways, b.ways)))


@pytest.mark.parametrize("seed", range(5))
def test_phrases_are_greedy_longest_matches(seed):
    r = random.Random(seed)
    known = {"x": np.array([r.randrange(4) for _ in range(300)], np.uint8), "y": np.array([r.randrange(3) for _ in range(50)], np.uint8)}
    model = G.Model(known)
    texts = [np.array([r.randrange(6) for _ in range(r.choice([0, 1, 5, 200, 511, 512, 513, 1300, 5000]))], np.uint8) for _ in range(12)]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.phrases(np.concatenate(texts), off)

    def brute(t, have):
        n, i, t = 0, 0, bytes(t)
        while i < len(t):
            j = i + 1
            while j < len(t) and t[i : j + 1] in have:
                j += 1
            n, i = n + 1, j
        return n

    for row, t in zip(got, texts, strict=True):
        assert row.tolist() == [brute(t, bytes(known[k])) for k in model.langs]


def test_a_parse_that_never_forgets(monkeypatch):
    """A text of one long match: every lane has to be read again from the one before, one after the other."""
    monkeypatch.setattr(G, "LANE", 16)
    r = random.Random(1)
    known = np.array([r.randrange(3) for _ in range(2000)], np.uint8)
    model = G.Model({"x": known})
    assert model.phrases(known, np.array([0, 2000])).tolist() == [[1]]
    assert model.phrases(np.concatenate([known[5:900], known]), np.array([0, 895, 2895])).tolist() == [[1], [1]]


def test_every_language_has_a_model_and_all_share_the_symbols(spark, monkeypatch):
    monkeypatch.setattr(G, "MODEL_SYMBOLS", 3000)
    r = random.Random(4)
    rows = [(i, tongue(r.sample("abcdefghijklmnopqrstuvwxyz", 9), i), f"l{i % 300:03}") for i in range(600)]
    model = G.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~G.held_out("doc_id")))
    assert len(model.langs) > 270 and model.bits.max() <= math.log2(3000 // len(model.langs)) + 1e-9


def test_langid_hard(spark, make, hard):
    table = spark.createDataFrame(docs(), "doc_id long, text string, lang string")
    model = G.fit(table)
    out = G.predicted(make(hard), model).collect()
    assert len(out) == len(hard)
    for r in out:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert G.predicted(make([]), model).count() == 0
    assert G.fit(table.unionByName(spark.createDataFrame([(40_000 + i, "x", None) for i in range(3)], table.schema))).langs == model.langs
    none = G.fit(table.where("lang is null"))
    assert {r["lang_pred"] for r in G.predicted(make(hard), none).collect()} == {"und"}
    assert G.predicted(spark.createDataFrame([(1, "abc", "z")], "doc_id long, text string, lang_pred string"), model).first()["lang_pred"] == "aa"


def test_symbols_join_runs():
    buf = np.frombuffer("Ab,  c".encode() + b"  d", np.uint8)
    s, at = G.symbols(buf, np.array([0, 6, 9]))
    assert s.tolist() == [1, 2, 0, 3, 0, 4] and at.tolist() == [0, 4, 6]


# ---- WARC ----

BIG = "<p>é" + "x" * 1200
PAGES = [(1, "http://a/1", BIG), (2, "http://a/2\r\nX: y", BIG), (3, None, "small"), (4, "http://a/4", "small"), (5, "u", None), (6, "u", ""), (7, "u", BIG), (7, "u", BIG), (8, "u", "WARC/1.1\r\n\r\n\r\n" + "y" * 2000), (None, "u", BIG), (9, "u", "z" * 300_000)]


def want(rows):
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in raw:
        top = max((j for j, c in raw if c == b and j is not None), default=None)
        again = len(b) >= 1000 and top is not None and (i is None or i < top)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    raw, whole = new_path(spark, "raw"), new_path(spark, "whole")
    W.write(table, raw, per_file=3)
    archives = W.normalise(spark, raw, whole)
    got = W.read(archives).drop("url").collect()
    assert sorted((tuple(r) for r in got), key=str) == want(PAGES)
    folder = Path(whole.removeprefix("file://"))
    for index in folder.glob("*.idx"):
        packed = index.with_suffix(".warc.gz").read_bytes()
        entries = [json.loads(x) for x in index.read_text().splitlines()]
        parts = [gzip.decompress(packed[e["offset"] : e["offset"] + e["length"]]) for e in entries]  # each record alone
        assert b"".join(parts) == gzip.decompress(packed)
        (mono,) = Path(raw.removeprefix("file://")).glob(index.stem[:-17] + "*.gz")
        assert b"".join(parts) == gzip.decompress(mono.read_bytes())
    assert not list(folder.glob("_*")) and sum(r["n_records"] for r in archives.collect()) == len(PAGES)


def test_archives_of_one_name_are_all_kept(spark, tmp_path):
    """Names that share their first part, and one name in two folders."""
    names = ["crawl.2024.warc.gz", "crawl.2025.warc.gz", "a/crawl.gz", "b/crawl.gz", "a/crawl.warc.gz"]
    for k, name in enumerate(names):
        one = W.records(spark.createDataFrame([(k, "u", f"page {k}")], "page_id long, url string, html string")).first()["value"]
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(gzip.compress((one + W.END).encode()))
    archives = W.normalise(spark, str(tmp_path), new_path(spark, "whole"))
    assert archives.select("archive").distinct().count() == len(names)
    assert sorted(r["page_id"] for r in W.read(archives).collect()) == list(range(len(names)))


def test_inflate_members_and_broken_files():
    data = [b"one" * 1000, b"", b"two"]
    many = b"".join(gzip.compress(x) for x in data)
    chunks = lambda b, n: iter([b[i : i + n] for i in range(0, len(b), n)])
    for n in (1, 7, 1 << 20):
        assert b"".join(W.inflated(chunks(many, n))) == b"".join(data)
    assert b"".join(W.inflated(iter([]))) == b""
    with pytest.raises(ValueError):
        list(W.inflated(chunks(many[:-6], 100)))
    with pytest.raises(ValueError):
        list(W.split(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"])))
    with pytest.raises(ValueError):
        list(W.split(iter([b"HTTP/1.1\r\n\r\n"])))
    assert io.BytesIO(many).read(2) == b"\x1f\x8b"


def test_warc_of_nothing_and_more_columns(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    raw, whole = new_path(spark, "raw"), new_path(spark, "whole")
    W.write(none, raw)
    assert W.read(W.normalise(spark, raw, whole)).count() == 0
    more = spark.createDataFrame([(1, "u", "h", 3, "s")], "page_id long, url string, html string, k int, sha string")
    W.write(more, raw2 := new_path(spark, "raw"))
    assert W.read(W.normalise(spark, raw2, new_path(spark, "whole"))).count() == 1


def test_words_and_hashes():
    buf = "Ab  c\tÉd".encode() + b"ef"
    off = np.array([0, 9, len(buf)])
    s, e, at = X.words(np.frombuffer(buf, np.uint8), off, X.SPACED)
    assert [buf[a:b] for a, b in zip(s, e, strict=True)] == [b"Ab", b"c", "Éd".encode(), b"ef"] and at.tolist() == [0, 3, 4]
    h = X.spans_hash(np.frombuffer(b"abcabc", np.uint8), np.array([0, 3, 1]), np.array([3, 6, 3]))
    assert h[0] == h[1] != h[2]
