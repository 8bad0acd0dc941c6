import random
import re
from collections import Counter

import corpus_pipeline as P
import pyarrow as pa
import pyarrow.parquet as pq

from tidewire.llm import mixing

LICENCE = "passage " + " ".join(f"shared{k}" for k in range(60))


def test_stages_take_effect(spark, prose, hard, tmp_path):
    probe = " ".join(f"probe{k}" for k in range(14))
    rows = [(i, prose(5000 + i, 120)) for i in range(40)]
    rows += [(100 + i, prose(5000 + i, 120)) for i in range(5)]  # copies
    rows += [(200, prose(6200, 60) + " " + LICENCE + " " + prose(201, 60)), (201, prose(202, 60) + " " + LICENCE + " " + prose(203, 60))]
    rows += [(300, f"{prose(6300)} {probe} {prose(6301)}"), (301, prose(6302).upper())]
    rows += [(1000 + k, t) for k, (_, t) in enumerate(hard)]
    table = pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "lang": ["en"] * len(rows), "source": [None] * len(rows), "n_chars": [len(t or "") for _, t in rows]}, schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]))
    pq.write_table(table, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1, 2], pa.int64()), "text": [probe, None]}), tmp_path / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(40), pa.int64()), "quality": pa.array([1] * 40, pa.int32()), "toxic": pa.array([0] * 40, pa.int32())}), tmp_path / "labels.parquet")
    out = {r["doc_id"]: r for r in P.run(spark, str(tmp_path)).collect()}
    assert set(range(40)) <= set(out) and not {100, 101, 102, 103, 104, 301} & set(out)
    assert all(out[i]["text"] == prose(5000 + i, 120) for i in range(40))
    assert "shared30" not in out[200]["text"] and "shared30" not in out[201]["text"]
    assert not re.search(r"probe\d", out[300]["text"]) and out[300]["text"].startswith(prose(6300))
    assert all(r["rate"] > 0 for r in out.values()) and out[1]["n_tokens"] == 120


def base_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_quality(t):
    """The production rules, said plainly."""
    ws = base_words(t)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    many = Counter(grams)
    repeated = len({p for i, g in enumerate(grams) if many[g] > 1 for p in (i, i + 1, i + 2)})
    lines = [x for x in (t or "").split("\n") if base_words(x)]
    chars = sum(map(len, ws))
    alpha = sum(c.isascii() and c.isalpha() or ord(c) >= 0xC0 for c in t or "")
    return (
        len(ws) >= 50 and 2 * repeated <= len(ws) and 10 * sum(c in "#*$%&|<>" for c in t) <= len(ws) and 2 * sum("A" <= c <= "Z" for c in t) <= alpha
        and 2 * alpha >= chars and 2 * (len(lines) - len(set(lines))) <= max(1, len(lines)) and 2 * len(ws) <= chars <= 15 * len(ws)
    )


def brute_near(rows):
    """Of each group by links of 0.75 on five-word shingles the row of the least id."""
    sets = []
    for r in rows:
        w = r["text"].encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                a_, b_ = sorted((find(i), find(j)), key=lambda k: rows[k]["doc_id"])
                root[b_] = a_
    return [r for i, r in enumerate(rows) if find(i) == i]


def brute_suffix(rows):
    """Texts without the bytes of 200-byte strings that start twice."""
    raw = [r["text"].encode() for r in rows]
    seen = Counter(b[p : p + 200] for b in raw for p in range(len(b) - 199))
    out = []
    for r, b in zip(rows, raw, strict=True):
        keep = [True] * len(b)
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                keep[p : p + 200] = [False] * 200
        rest = bytes(x for x, k in zip(b, keep, strict=True) if k).decode("utf-8", "ignore")
        if all(keep) or rest.strip():
            out.append({**r, "text": rest})
    return out


def brute_leaks(rows, items):
    """Texts without hit words' spans, and without those that are hit in over half of their words."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    windows = set()
    for t in items:
        w = word.findall(low(t))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    out = []
    for r in rows:
        found = list(word.finditer(low(r["text"])))
        w, hit = [m[0] for m in found], [False] * len(found)
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
        if 2 * sum(hit) > len(w):
            continue
        text, at = [], 0
        for i, m in enumerate(found):
            if hit[i] and not (i and hit[i - 1]):
                text.append(r["text"][at : m.start()])
            if hit[i]:
                at = m.end()
        out.append({**r, "text": " ".join([*text, r["text"][at:]])})
    return out


def test_stages_are_brute_force(spark, prose, tmp_path):
    """Every stage on what the one before it kept; the last one's membership follows from its rates."""
    r = random.Random(11)
    probe = " ".join(f"probe{k}" for k in range(30))
    share = " ".join(f"part{k}of" for k in range(45))
    rows = []
    for i in range(130):
        t = prose(8000 + i % 100, r.randint(40, 130))
        if i % 9 == 0:
            t = " ".join(w if r.random() > 0.02 else f"x{i}" for w in prose(8000 + i // 9, 100).split())
        if i % 13 == 0:
            t = t[:200] + " " + share + " " + t[200:]
        if i % 17 == 0:
            t += " " + " ".join(probe.split()[i % 5 : i % 5 + 14]).title() + ", " + prose(9000 + i, 20)
        if i % 19 == 0:
            t = t.upper() if i % 2 else "| " * 30 + t
        rows.append({"doc_id": i, "text": t})
    items = [probe, "Short, item!", ""]
    labels = spark.createDataFrame([(i, int(i % 19 != 0), 0) for i in range(0, 130, 2)], "doc_id long, quality int, toxic int")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(x["doc_id"], x["text"], "en", "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    same = lambda have, want: [(x["doc_id"], x["text"]) for x in sorted(have, key=lambda x: x["doc_id"])] == [(x["doc_id"], x["text"]) for x in sorted(want, key=lambda x: x["doc_id"])]
    steps = [lambda x: [y for y in x if brute_quality(y["text"])], brute_near, brute_suffix, lambda x: brute_leaks(x, items)]
    sizes = [len(rows)]
    for (name, stage), step in zip(P.STAGES, steps, strict=False):
        out = stage(spark, docs, str(tmp_path)).collect()
        rows = step(rows)
        assert same([x.asDict() for x in out], rows), name
        sizes.append(len(rows))
        docs = spark.createDataFrame(out, docs.schema)
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] >= sizes[4] > 50
    name, stage = P.STAGES[-1]
    rated = mixing.mixed(docs, labels).collect()
    assert sorted(x["doc_id"] for x in stage(spark, docs, str(tmp_path)).collect()) == sorted(x["doc_id"] for x in rated if x["rate"] > 0)


def test_repeated_rows_stay_once(spark, prose, tmp_path):
    rows = [(i, prose(7000 + i, 120)) for i in range(40)]
    rows += [(500, prose(7500, 120))] * 3 + [(None, prose(7600, 120))] * 2 + [(None, prose(7601, 120)), (None, prose(7601, 120).upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = sorted(r["text"].lower() for r in P.run(spark, str(tmp_path)).collect())
    assert out == sorted({t.lower() for _, t in rows})


def test_empty_documents(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_their_columns(spark, prose):
    docs = spark.createDataFrame([(1, prose(1), "en", "s", 1, "x"), (2, prose(1), "en", "s", 1, "y")], "doc_id long, text string, lang string, source string, n_chars long, th string")
    for _, stage in P.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "th"]
    assert [r["doc_id"] for r in docs.collect()] == [1]
