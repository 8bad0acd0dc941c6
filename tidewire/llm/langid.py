"""Language identification by cross-parsing: a text is cut into the longest phrases that a language's labelled text has.

A suffix automaton of labelled text of each language accepts exactly its substrings. Read from the root, it gives
the longest match from each phrase's start on; where it has no way on, a phrase ends. The language that needs the fewest
phrases, normalised by the bits of a place in its text, wins.

A parse is sequential, but forgets where it started after a few phrases. So a text is read in lanes, all in step, each as if a phrase began with it;
then every lane is read again from the state in which the lane before really ends, until its states are those already found, and
so on until no lane's entry changes. What comes out is the parse of the whole text, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import _text as X

#: Labelled documents of a language that are looked at, at most, and symbols of them that its automaton is built on, at most.
FIT_DOCS, FIT_SYMBOLS = 80, 40_000
#: Symbols of all automata together, at most: with more than 50 languages each gets its share of them.
MODEL_SYMBOLS = 2_000_000
#: Bytes that a model may take when it is broadcast; one that takes more is an error.
MODEL_BYTES = 512 << 20
#: Symbols of a lane, which all are read in step; languages that are read at once, and symbols times languages.
LANE, GROUP, AT_ONCE = 512, 8, 16 << 20

#: Symbols: 0 what isn't a letter, 1 to 26 letters, 27 and up bytes of non-ASCII characters.
SYMBOLS = 27 + 128
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[65:91] = _SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(27, SYMBOLS)


def symbols(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the texts, runs of non-letters as one, and their offsets."""
    s = _SYMBOL[buf]
    keep = s != 0
    if len(s):
        keep[1:] |= s[:-1] != 0
        starts = off[:-1][(off[:-1] < len(s)) & (np.diff(off) > 0)]
        keep[starts] = True
    total = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return s[keep], total[off]


def automaton(text: np.ndarray) -> list[dict[int, int]]:
    """The suffix automaton of a symbol sequence: transitions of each state, the root first."""
    go: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in text.tolist():
        cur = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p != -1:
            q = go[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return go


class Model:
    """Automata of all languages as arrays. Most states have one way on: `only` is its symbol, and `link` where it leads.

    States of more ways have -1 there, and `link` is their row of `ways`, which has a column for each symbol; those of none have -2.
    """

    def __init__(self, samples: dict[str, np.ndarray]):
        self.langs = sorted(samples)
        seen = np.unique(np.concatenate([np.zeros(1, np.uint8), *samples.values()]))
        self.width = len(seen) + 1
        self.column = np.full(SYMBOLS, self.width - 1, np.int16)  # the last column: a symbol that no language has
        self.column[seen] = np.arange(len(seen))
        roots, only, link, ways, base, rows = [], [], [], [], 0, 0
        for lang in self.langs:
            go = automaton(samples[lang])
            size = np.array([len(g) for g in go])
            one, many = np.flatnonzero(size == 1), np.flatnonzero(size > 1)
            only.append(np.where(size > 1, -1, -2).astype(np.int16))
            link.append(np.zeros(len(go), np.int32))
            if len(one):
                only[-1][one] = self.column[[next(iter(go[q])) for q in one]]
                link[-1][one] = [next(iter(go[q].values())) + base for q in one]
            link[-1][many] = rows + np.arange(len(many))
            table = np.zeros((len(many), self.width), np.int32)
            for k, q in enumerate(many.tolist()):
                table[k, self.column[list(go[q])]] = np.fromiter(go[q].values(), np.int64, len(go[q])) + base
            ways.append(table)
            roots.append(base)
            base += len(go)
            rows += len(table)
        self.roots = np.array(roots, np.int32)
        self.only, self.link = (np.concatenate(x) if x else np.zeros(1, np.int32) for x in (only, link))
        self.ways = np.concatenate([*ways, np.zeros((1, self.width), np.int32)]).ravel()
        self.bits = np.array([math.log2(max(2, len(samples[lang]))) for lang in self.langs])

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.only, self.link, self.ways))

    def _on(self, state: np.ndarray, col: np.ndarray) -> np.ndarray:
        """The states after a symbol; 0: no way on."""
        only, link = self.only.take(state), self.link.take(state)
        now = np.where(only == col, link, np.int32(0))
        many = np.flatnonzero(only == -1)
        now[many] = self.ways.take(link.take(many).astype(np.int64) * self.width + col.take(many))
        return now

    def _step(self, state: np.ndarray, root: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after a symbol, and whether a phrase begins at it: no way on, or a symbol before that the language doesn't have."""
        now = self._on(state, col)
        stop = np.flatnonzero(now == 0)
        begins = state == root
        if len(stop):
            begins[stop] = True
            first = self._on(root.take(stop), col.take(stop))
            now[stop] = np.where(first == 0, root.take(stop), first)
        return now, begins

    def phrases(self, sym: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) by each language (columns)."""
        n = len(off) - 1
        out = np.zeros((n, len(self.langs)), np.int64)
        lanes = -(-np.diff(off) // LANE)
        count = int(lanes.sum())
        if not count:
            return out
        text = np.repeat(np.arange(n), lanes)
        nth = np.arange(count) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = off[:-1][text] + nth * LANE
        length = np.minimum(LANE, off[1:][text] - start)
        order = np.argsort(-length, kind="stable")  # the longest first, so that the lanes still read are always the first ones
        place = np.empty(count, np.int64)
        place[order] = np.arange(count)
        before = np.full(count, -1)
        before[place[nth > 0]] = place[np.flatnonzero(nth > 0) - 1]
        long = int(length.max())
        cols = np.zeros((long, count), np.int16)
        inner = np.arange(len(sym)) - np.repeat(start, length)
        cols.ravel()[inner * count + np.repeat(place, length)] = self.column[sym]
        length, text = length[order], text[order]
        active = np.searchsorted(-length, -np.arange(1, long + 1), "right")
        later = np.flatnonzero(before >= 0)
        step = max(1, min(GROUP, AT_ONCE // len(sym)))  # a very long text is a piece of its own: fewer languages at once
        for g in range(0, len(self.roots), step):
            roots = self.roots[g : g + step]
            k = len(roots)
            states, begins = np.zeros((long, count, k), np.int32), np.zeros((long, count, k), bool)
            entry = np.tile(roots, (count, 1))
            state, root = entry.ravel(), np.tile(roots, count)
            for j in range(long):
                m = int(active[j])
                state, fresh = self._step(state[: m * k], root[: m * k], np.repeat(cols[j, :m], k))
                states[j, :m], begins[j, :m] = state.reshape(m, k), fresh.reshape(m, k)
            lane, lang = np.repeat(later, k), np.tile(np.arange(k), len(later))
            follows = np.full(count, -1)
            follows[before[later]] = later
            while len(lane):
                real = states[LANE - 1, before[lane], lang]
                new = real != entry[lane, lang]
                lane, lang, state = lane[new], lang[new], real[new]
                entry[lane, lang] = state
                li, la = lane, lang
                for j in range(long):
                    live = length[li] > j
                    li, la, state = li[live], la[live], state[live]
                    if not len(li):
                        break
                    state, fresh = self._step(state, roots[la], cols[j, li])
                    differs = states[j, li, la] != state  # from an equal state on nothing changes
                    states[j, li, la], begins[j, li, la] = state, fresh
                    li, la, state = li[differs], la[differs], state[differs]
                lane = follows[lane]  # only the lanes after those that were read again can have another entry
                lang, lane = lang[lane >= 0], lane[lane >= 0]
            each = begins.sum(axis=0)
            for i in range(k):
                out[:, g + i] = np.bincount(text, each[:, i], n)
        return out


def held_out(key: str) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_each: int = FIT_DOCS, symbols_each: int = FIT_SYMBOLS) -> Model:
    """Automata of labelled text that isn't held out: of each language the documents of the least hashes, until their symbols suffice.

    Every language of a labelled row has one. Bounds: `docs_each` documents and `symbols_each` symbols of a language, of the first
    `symbols_each` characters of each, and MODEL_SYMBOLS of all. A document is a distinct id and text, so repeated rows count once.
    """
    t = F.col(text)
    rows = docs.where(F.col(lang).isNotNull() & t.isNotNull() & ~held_out(key)).select(F.col(key).alias("k"), F.col(lang).alias("g"), F.xxhash64(key, t).alias("row"), F.xxhash64(F.lit("second"), t, key).alias("rowb"))
    rows = rows.distinct()
    symbols_each = max(1, min(symbols_each, MODEL_SYMBOLS // max(1, rows.select("g").distinct().count())))
    # the least hashes of each part of a language first, so that a language of any number of rows meets one task with a few rows only
    chosen = rows.withColumn("h", F.xxhash64("k")).withColumn("salt", F.pmod("row", F.lit(64)))
    for by in (["g", "salt"], ["g"]):
        chosen = chosen.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "k", "row", "rowb"))).where(F.col("r") <= docs_each)
    chosen = chosen.select("g", "row", "rowb", "r")
    named = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("g"), F.xxhash64(key, t).alias("row"), F.xxhash64(F.lit("second"), t, key).alias("rowb"), F.substring(t, 1, symbols_each).alias("t"))
    got = named.join(F.broadcast(chosen), ["g", "row", "rowb"]).groupBy("g", "r").agg(F.first("t").alias("t")).collect()  # docs_each rows a language at most
    samples: dict[str, np.ndarray] = {}
    for r in sorted(got, key=lambda r: (r["g"], r["r"], r["t"])):
        raw = np.frombuffer(f" {r['t']} ".encode(), np.uint8)
        more = symbols(raw, np.array([0, len(raw)]))[0]
        have = samples.get(r["g"], np.zeros(0, np.uint8))
        if len(have) < symbols_each:
            samples[r["g"]] = np.concatenate([have, more])[:symbols_each]
    return Model(samples)


def _letters(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((_SYMBOL[buf] > 0) & (buf < 128), out=total[1:])
    out = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)).tolist():
        out[i] = any(c.isalpha() for c in buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "ignore"))
    return out


def predicted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of `docs` with lang_pred and score: how much fewer phrases the winner needs than the next, 0 to 1.

    Null texts and texts without a letter are `und` with score 0, and so are all without a model. A tie goes to the first by
    name. With one language only, its score is 1. Columns named like an added one are replaced.
    """
    if model.nbytes > MODEL_BYTES:
        raise ValueError(f"the model takes {model.nbytes} bytes: fit it on fewer symbols")
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.drop("lang_pred", "score")
    names = [*own.columns, "lang_pred", "score"]
    schema = T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for rb in batches:
            for i, j, buf, off in X.pieces(rb, text, 2 << 20):
                said, score = ["und"] * (j - i), np.zeros(j - i)
                if m.langs:
                    sym, at = symbols(buf, off)
                    cost = m.phrases(sym, at) * m.bits[None, :].astype(float)
                    best = cost.argmin(axis=1)
                    low = cost[np.arange(len(best)), best]
                    cost[np.arange(len(best)), best] = np.inf
                    some = _letters(buf, off)
                    score = np.where(some, 1 - low / cost.min(axis=1), 0.0)
                    said = [m.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*rb.slice(i, j - i).columns, pa.array(said, pa.string()), pa.array(score)], names=names)

    return own.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    return predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
