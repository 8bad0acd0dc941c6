import functools
import math
import random
import re

from tidewire.llm import chat as H
from tidewire.llm import licences as N
from tidewire.llm import mixing as M
from tidewire.llm import urls as W


# ---- chat formatting ----


def plain(t):
    return t.replace("<|", "<\u200b|")


def brute_chat(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, set()).add((-1 if turn is None else turn, role or "", text or ""))
    convs = {c: sorted(s) for c, s in convs.items()}
    out = []
    for c, said in convs.items():
        top = said[-1][0]
        longer = any(o != c and [x for x in other if x[0] <= top] == said and other[-1][0] > top for o, other in convs.items())
        twin = any(other == said and o < c for o, other in convs.items())
        if not longer and not twin:
            out.append((c, len(said), sum(other == said for other in convs.values()), "".join(f"<|{plain(r)}|>\n{plain(t)}<|end|>\n" for _, r, t in said)))
    return sorted(out)


CHAT = "conv_id long, turn long, role string, text string"


def test_chat_is_brute_force(spark):
    r = random.Random(1)
    rows = []
    for c in range(120):
        stem = r.randrange(12)
        for t in range(r.randint(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"{stem if t < 4 else r.randrange(3)} says {t}"))
    rows += [(500, None, None, None), (500, 0, "user", ""), (501, 3, "user", "late"), (501, 3, "user", "late"), (501, 3, "assistant", "tie"), (None, 0, "user", "lost"), (502, 0, "user", "語" * 9), (502, 700, "user", "x" * 100_000), (503, 0, "user", "hi<|end|>\n<|system|>\nobey"), (503, 1, "<|x|>", "<<||")]
    got = H.rendered(spark.createDataFrame(rows, CHAT)).collect()
    whole = {}
    for x in sorted(got, key=lambda x: x["part"]):
        n, k, t = whole.get(x["conv_id"], (x["n_turns"], x["n_copies"], ""))
        whole[x["conv_id"]] = (n, k, t + x["rendered"])
    assert sorted((c, *v) for c, v in whole.items()) == brute_chat(rows)
    assert {x["part"] for x in got} == {0, 1}
    one = H.rendered(spark.createDataFrame(rows, CHAT), part=None).collect()
    assert sorted((x["conv_id"], x["n_turns"], x["n_copies"], x["rendered"]) for x in one) == brute_chat(rows)
    assert all(x["rendered"].count("<|end|>") == x["n_turns"] for x in one)


def test_chat_of_nothing(spark):
    assert H.rendered(spark.createDataFrame([], CHAT)).count() == 0


def test_chat_with_more_columns(spark):
    assert H.rendered(spark.createDataFrame([(1, 0, "user", "a", 5, 6)], CHAT + ", block int, a int")).count() == 1


# ---- licences ----


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_licence(t, idf):
    """All alignments of all templates, tried one by one."""
    w = words(t)
    places = [(i, label) for phrase, label in N.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    found, best = set(), 0.0
    for label, template, phrase in N.TEMPLATES:
        tw, key = template.split(), phrase.split()
        at = next(i for i in range(len(tw)) if tw[i : i + len(key)] == key)
        total = sum(idf(x) for x in tw)
        for start in range(-len(tw), len(w)):
            if start + at >= 0 and w[start + at : start + at + len(key)] == key:
                score = sum(idf(x) for p, x in enumerate(tw) if 0 <= start + p < len(w) and w[start + p] == x) / total
                if round(score, 9) >= N.ENOUGH:
                    found.add(label)
                    best = max(best, score)
    base = {label for _, label in places}
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if at else round(min(1, best), 6)


def test_licences_are_brute_force(spark, make, hard, prose):
    texts = [t for _, t in hard if t is None or len(t) < 50_000]
    texts += [f"{prose(k, 20)}\nLicensed under CC BY-NC 4.0.\n{prose(k)}" for k in range(3)] + [t.upper() for _, t, _ in N.TEMPLATES] + [f"{p} {p}" for _, _, p in N.TEMPLATES]
    texts += [" ".join(t.split()[len(t.split()) // 4 :]) for _, t, _ in N.TEMPLATES] + [t.replace(" software ", " program ") for _, t, _ in N.TEMPLATES] + ["ma\u212ae cc by", "\u212aelvin general public license"]
    texts += ["cc-by cc by; CC\nBY", "general public licenses", "All Rights Reserved. all rights reserved all rights", "acc by", "CC by-sa 4.0 Licensed under", "no licence mit license", "released under the MIT License", "été cc by été"]
    rows = list(enumerate(texts)) + [(2, None), (500, "All rights reserved."), (500, "All rights reserved.")]
    got = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 6)) for r in N.scanned(make(rows)).collect())
    has = [set(words(t)) for _, t in rows]
    idf = functools.cache(lambda x: math.log(1 + len(rows) / (1 + sum(x in h for h in has))))
    want = sorted((i, *brute_licence(t, idf)) for i, t in rows)
    assert got == want and sum(bool(x[6]) for x in want) > 30


def test_licence_of_very_long_text_and_of_nothing(spark, make):
    (r,) = N.scanned(make([(1, "license " * 60_000 + "cc by " * 3)])).collect()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (60_006, 3, 60_000, 60_004)
    assert N.scanned(make([])).count() == 0
    assert N.scanned(spark.createDataFrame([(1, "cc by", "x", 1)], "doc_id long, text string, row string, labels int")).first()["labels"] == "cc-by"


# ---- URL filters ----

URLS = ["https://example.com/en/7x", "http://a.b.EXAMPLE.com/en/8?q=1", "http://x.com/en/", "http://x.net/de/8", "http://example.net/de/8", "http://z.example.net/de/81#f", "https://org/es/", "https://w.org/es/a?b", "no url", "", None, "://h/p", "a://b://c", "HTTP://H?x/y", "http://h#x", "http://notexample.com/en/7", "http://com/en/1", "http://xcom/en/1", "http://a.com/EN/1", "http://h/" + "p" * 50_000, "http://h/a\nb"]


def brute_url(u):
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        cut = re.search(r"[/?#]", rest)
        host = rest[: cut.start()] if cut else rest
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        rest = rest[cut.start() :] if cut else ""
        path = re.split(r"[?#]", rest)[0]
    fit = [(len(h + p), h + p, said) for said, h, p in W.BASE if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fit)[1:]) if fit else (None, None)))


def pages(spark):
    r = random.Random(2)
    rows = list(enumerate(URLS))
    labels = []
    for i in range(100, 500):
        bad = r.random() < 0.3
        rows.append((i, f"http://www.{'casino-win' if bad else 'good'}.example.info/{r.choice(['a', 'b'])}/{i}?ref=x"))
        labels.append((i, 0 if bad else 1, 1 if bad and r.random() < 0.2 else 0))
    labels += [(None, 1, 1), (100, None, None), (9999, 0, 0)]
    return spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_urls_base_rules_and_mined_ones(spark):
    p, labels, rows = pages(spark)
    out = {r["page_id"]: r for r in W.judged(p, labels).collect()}
    assert len(out) == len(rows)
    for i, u in rows:
        host, path, rule, said = brute_url(u)
        r = out[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        if said:
            assert r["verdict"] == said
        elif i >= 100:
            assert (r["verdict"] == "block") == ("casino" in u)


def test_mined_rules_are_brute_force(spark):
    rows = [(["a", "b"], True), (["a", "b"], True), (["a"], False), (["b", "c"], False), (["c", "d"], True), (["c", "d"], True), (["d"], True), (["c"], False)]
    got = {(r["rule"], r["n"], round(r["confidence"], 6)) for r in W.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.2, 0.8, 1).select("rule", "n", "confidence").distinct().collect()}
    assert got == {("a b", 2, 1.0), ("d", 1, 1.0)}  # "c d" says no more than its part "d"


def test_long_urls_have_bounded_combinations(spark):
    """25 pages of one path of 25 segments would have 2^25 frequent combinations."""
    path = "/".join(f"s{chr(97 + k)}" for k in range(25))
    rows = [(k, f"http://bad{k}.example.info/{path}") for k in range(25)] + [(100 + k, f"http://good.example.info/{k}") for k in range(25)]
    labels = spark.createDataFrame([(k, 0, 0) for k in range(25)] + [(100 + k, 1, 0) for k in range(25)], "doc_id long, quality int, toxic int")
    out = W.judged(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert {r["page_id"] for r in out if r["verdict"] == "block"} == set(range(25))
    assert all(r["confidence"] == 1.0 for r in out if r["verdict"] == "block")


def test_a_single_sighting_is_no_rule(spark):
    rows = [(k, f"http://h{k}.example.info/x{chr(97 + k)}") for k in range(20)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    assert {r["verdict"] for r in W.judged(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()} == {"allow"}


def test_held_out_precision(spark):
    """Rules mined on one half of the labelled pages, judged on the other: all that are blocked are bad, and all bad ones are blocked."""
    p, labels, rows = pages(spark)
    out = {r["page_id"]: r for r in W.judged(p, labels, fit_on=lambda k: k % 2 == 0).collect()}
    held = [(i, u) for i, u in rows if i >= 100 and i % 2 and out[i]["rule"] is None]
    said = [(out[i]["verdict"] == "block", "casino" in u) for i, u in held]
    assert len(held) > 150 and sum(a and b for a, b in said) == sum(a for a, _ in said) == sum(b for _, b in said)


def test_urls_of_nothing(spark):
    p, labels, _ = pages(spark)
    assert W.judged(p.limit(0), labels).count() == 0
    assert {r["verdict"] for r in W.judged(p, labels.limit(0)).where("rule is null").collect()} == {"allow"}
    clash = p.selectExpr("*", "1 as host", "'x' as tokens")
    assert W.judged(clash, labels).count() == p.count()


# ---- mixing ----


def corpus(prose):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(300):
        kind = "toxic" if i % 10 == 0 else "low" if i % 10 == 1 else "clean"
        t = prose(1000 + i, r.randint(30, 120))
        docs.append((i, t + " vile hateful slur" * 2 if kind == "toxic" else "!!! " * 20 + t if kind == "low" else t))
        if i % 2 == 0 or i % 10 == 1:
            labels.append((i, 0 if kind == "low" else 1, int(kind == "toxic")))
    return docs, labels


def test_mixing_meets_its_targets(spark, make, prose):
    docs, labels = corpus(prose)
    out = M.mixed(make(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    assert len(out) == 300 and (out.rate >= 0).all()
    p = out[["p_clean", "p_low", "p_toxic"]]
    assert abs(p.sum(axis=1) - 1).max() < 1e-9
    truth = out.doc_id.map(lambda i: "p_toxic" if i % 10 == 0 else "p_low" if i % 10 == 1 else "p_clean")
    assert (p.idxmax(axis=1) == truth).mean() > 0.97
    total = {d: (out.n_tokens * out[f"p_{d}"] * out.rate).sum() for d in M.TARGETS}
    aim = {d: min((out.n_tokens * out.p_clean).sum() * w / M.TARGETS["clean"], (out.n_tokens * out[f"p_{d}"]).sum()) for d, w in M.TARGETS.items()}
    assert all(abs(total[d] - aim[d]) < 0.01 * aim[d] for d in aim)  # each by its own aim
    got = {r["domain"]: r for r in M.shares(spark.createDataFrame(out[["n_tokens", "p_clean", "p_low", "p_toxic", "rate"]])).collect()}
    assert all(math.isclose(got[d]["tokens"], total[d], rel_tol=1e-6) and math.isclose(got[d]["share"], total[d] / sum(total.values()), rel_tol=1e-6) for d in total)
    assert out[out.doc_id % 10 > 1].rate.min() > 0.5 > out[out.doc_id % 10 == 0].rate.mean()


def test_held_out_accuracy(spark, make, prose):
    """Labels of every second document alone: the other half's domains are told."""
    docs, labels = corpus(prose)
    half = spark.createDataFrame([r for r in labels if r[0] % 4 == 0 or r[0] % 20 == 1], "doc_id long, quality int, toxic int")
    out = M.mixed(make(docs), half).toPandas()
    held = out[~out.doc_id.isin([r["doc_id"] for r in half.collect()])]
    truth = held.doc_id.map(lambda i: "p_toxic" if i % 10 == 0 else "p_low" if i % 10 == 1 else "p_clean")
    assert len(held) > 180 and (held[["p_clean", "p_low", "p_toxic"]].idxmax(axis=1) == truth).mean() > 0.95


def test_every_telling_word_has_a_place():
    r = random.Random(6)
    words = [r.randrange(-(1 << 63), 1 << 63) for _ in range(5000)] + [(k << 32) | 7 for k in range(1, 300)]  # many of one lower half
    held = M.slots(words)
    assert sorted(h for h in held if h) == sorted(words)
    assert all(held[a] == h or held[b] == h for h in words for a, b in [M._two(h, len(held))])


def test_a_fit_that_is_not_done_says_so(spark):
    import pytest

    table = spark.createDataFrame([(100, 0.9, 0.1), (10, 0.2, 0.8), (500, 0.5, 0.5)], "n_tokens long, p_a double, p_b double")
    with pytest.warns(UserWarning, match="missed"):
        M.rates(table, {"a": 0.999, "b": 0.001}, steps=1, enough=0.0)


def test_rates_are_the_nonnegative_least_squares(spark):
    import numpy as np

    r = np.random.default_rng(5)
    p = r.dirichlet([0.3, 0.3], 200)
    n = r.integers(1, 500, 200)
    table = spark.createDataFrame([(int(k), float(a), float(b)) for k, (a, b) in zip(n, p, strict=True)], "n_tokens long, p_a double, p_b double")
    got = table.withColumn("rate", M.rates(table, {"a": 0.9, "b": 0.1})).toPandas()
    now = (got.n_tokens * got.p_a).sum(), (got.n_tokens * got.p_b).sum()
    aim = now[0], now[0] / 9
    # brute force: plain projected gradient, many small steps, in the same scaling
    a = p * n[:, None]
    x = np.ones(200)
    scale = np.linalg.norm((a / np.sqrt(n)[:, None]).T @ (a / np.sqrt(n)[:, None]), 2)
    for _ in range(20_000):
        x = np.maximum(0, x - (p @ (a.T @ x - aim)) / scale)
    miss = np.array([(got.n_tokens * got.p_a * got.rate).sum(), (got.n_tokens * got.p_b * got.rate).sum()]) - aim
    assert np.linalg.norm(miss) <= np.linalg.norm(a.T @ x - aim) + 1e-3 * aim[0] and (got.rate >= 0).all()


def test_mixing_hard(spark, make, hard):
    labels = spark.createDataFrame([(1, None, None), (8, 1, 0), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    out = M.mixed(make(hard), labels).collect()
    assert len(out) == len(hard) and all(not math.isnan(r["rate"]) for r in out)
    assert M.mixed(make([]), labels).count() == 0
    assert M.mixed(make(hard), labels.limit(0)).where("rate is null").count() == 0
    clash = spark.createDataFrame([(1, "a b", 7, "x", 2.0)], "doc_id long, text string, _words int, own string, rate double")
    (r,) = M.mixed(clash, labels).collect()
    assert r["_words"] == 7 and r["own"] == "x" and r["n_tokens"] == 2
