"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a bounded sample; rules then run in the order of rejections
per cost, each for the texts that all rules before it let pass. Where those are most of a batch, a measure is taken of the batch as a whole,
which costs less than to copy the bytes of most. The verdict doesn't depend on the order, and the order only on the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm import _text as X
from tidewire.plans.store import fresh

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Texts of the sample on which costs and selectivities are estimated, about, and bytes of a text in it, at most.
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 1 << 16
#: Passes over the bytes of a batch that each measure takes by itself; one that isn't listed counts as one.
PASSES = {"words": 6, "hashes": 10, "lines": 14, "n_repeat_words": 8, "n_word_chars": 3, "n_symbols": 2, "n_alpha": 2, "n_upper": 2, "n_words": 0, "n_lines": 0}


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


class Batch:
    """Texts as one byte array; features are computed once, when a rule first asks for them."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n = buf, off, len(off) - 1
        self._have: dict[str, object] = {}

    def get(self, name: str):
        if name not in self._have:
            self._have[name] = getattr(self, "_" + name)()
        return self._have[name]

    @property
    def asked(self) -> list[str]:
        return list(self._have)

    def take(self, rows: np.ndarray) -> Batch:
        """The given rows; what is known of them stays known."""
        size = np.diff(self.off)[rows]
        off = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.off[:-1][rows] - off[:-1], size) + np.arange(off[-1])
        out = Batch(self.buf[at], off)
        out._have = {k: v[rows] for k, v in self._have.items() if isinstance(v, np.ndarray) and len(v) == self.n and k.startswith("n_")}
        return out

    def _words(self):
        return X.words(self.buf, self.off, X.SPACED)

    def _hashes(self):
        starts, ends, _ = self.get("words")
        return X.spans_hash(self.buf, starts, ends)

    def _n_words(self):
        return np.diff(self.get("words")[2])

    def _n_word_chars(self):
        b = self.buf
        return _per_text(X.SPACED[b] & ((b & 0xC0) != 0x80), self.off)

    def _n_symbols(self):
        return _per_text(SYMBOL[self.buf], self.off)

    def _n_alpha(self):
        return _per_text(_ALPHA[self.buf], self.off)

    def _n_upper(self):
        return _per_text(_UPPER[self.buf], self.off)

    def _lines(self):
        """Hash, text and whether it has a word, of each line in order."""
        b, off = self.buf, self.off
        cut = np.flatnonzero(b == 10)
        owner = np.searchsorted(off, cut, "right") - 1
        starts = np.sort(np.concatenate([off[:-1], cut + 1]), kind="stable")
        text = np.concatenate([np.arange(self.n), owner])[np.argsort(np.concatenate([off[:-1], cut + 1]), kind="stable")]
        # a line break at a text's end leaves an empty line that starts where the next text does
        order = np.lexsort((starts, text))
        starts, text = starts[order], text[order]
        last = np.concatenate([text[1:] != text[:-1], [True]]) if len(text) else np.zeros(0, bool)
        ends = np.where(last, off[1:][text], np.concatenate([starts[1:] - 1, [0]]) if len(text) else 0)
        seen = np.zeros(len(b) + 1, np.int64)
        np.cumsum(X.SPACED[b], out=seen[1:])
        return X.spans_hash(b, starts, ends), text, seen[ends] > seen[starts]

    def _n_lines(self):
        _, text, full = self.get("lines")
        return np.bincount(text[full], minlength=self.n)

    def _n_dup_lines(self):
        h, text, full = self.get("lines")
        h, text = h[full], text[full]
        order = np.lexsort((h, text))
        again = np.zeros(len(h), bool)
        again[1:] = (h[order][1:] == h[order][:-1]) & (text[order][1:] == text[order][:-1])
        return np.bincount(text[order][again], minlength=self.n)

    def _n_repeat_words(self):
        at = self.get("words")[2]
        g = X.grams(self.get("hashes"), 3)
        out = np.zeros(self.n, np.int64)
        for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            if b - a < 4:
                continue
            w = g[a : b - 2]
            order = np.argsort(w, kind="stable")
            s = w[order]
            eq = s[1:] == s[:-1]
            if not eq.any():
                continue
            hit = np.zeros(len(w), bool)
            hit[order[1:][eq]] = True
            hit[order[:-1][eq]] = True
            cover = np.zeros(b - a, bool)
            for j in range(3):
                cover[j : j + len(w)] |= hit
            out[i] = cover.sum()
        return out


@dataclass(frozen=True)
class Rule:
    """`passes` gives a boolean for each text of a batch."""

    name: str
    passes: Callable[[Batch], np.ndarray]


def rules(min_words: int = 50, repeat: float = 0.5, symbols: float = 0.1, upper: float = 0.5, alpha: float = 0.5, dup_lines: float = 0.5, word_chars: tuple[float, float] = (2.0, 15.0)) -> list[Rule]:
    """The production rules. The first two are the base: too short, or mostly words of repeated 3-word windows."""
    return [
        Rule("min_words", lambda b: b.get("n_words") >= min_words),
        Rule("repeats", lambda b: b.get("n_repeat_words") <= repeat * b.get("n_words")),
        Rule("symbols", lambda b: b.get("n_symbols") <= symbols * b.get("n_words")),
        Rule("upper", lambda b: b.get("n_upper") <= upper * b.get("n_alpha")),
        Rule("alpha", lambda b: b.get("n_alpha") >= alpha * b.get("n_word_chars")),
        Rule("dup_lines", lambda b: b.get("n_dup_lines") <= dup_lines * np.maximum(1, b.get("n_lines"))),
        Rule("word_chars", lambda b: (b.get("n_word_chars") >= word_chars[0] * b.get("n_words")) & (b.get("n_word_chars") <= word_chars[1] * b.get("n_words"))),
    ]


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.cost, 1e-9)


def estimate(texts: list[str | None], using: list[Rule]) -> list[Estimate]:
    """Cost (bytes passed over for a text) and selectivity (share rejected) of each rule by itself on the sample, best first.

    Costs are counted, not timed: the passes of the measures that a rule asks for, times the bytes. So equal samples give equal orders.
    """
    column = pa.record_batch({"text": pa.array(texts, pa.string())})
    found = []
    for rule in using:
        spent, bad, n = 0, 0, 0
        for _, _, buf, off in X.pieces(column, "text", 1 << 18):
            batch = Batch(buf, off)
            bad, n = bad + int((~rule.passes(batch)).sum()), n + batch.n
            spent += len(buf) * sum(PASSES.get(m, 1) for m in batch.asked)
        found.append(Estimate(rule.name, spent / max(n, 1), bad / max(n, 1)))
    return sorted(found, key=lambda e: (-e.worth, e.cost, e.name))


def plan(docs: DataFrame, using: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order of rejections per cost on about `sample_rows` texts of the least hashes of all rows, none of them very long; copies count once."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    size = F.coalesce(F.octet_length(text), F.lit(0))
    some = docs.select(F.col(text).alias("t")).where((size <= SAMPLE_BYTES) & (F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(share * (1 << 30))))
    by = {r.name: r for r in using}
    return [by[e.name] for e in estimate(sorted((r["t"] for r in some.distinct().collect()), key=lambda t: t or ""), using)]


def cascade(batch: Batch, ordered: list[Rule]) -> np.ndarray:
    """For each text the index of the first rule of the order that rejects it, else -1; later rules don't see rejected texts."""
    out = np.full(batch.n, -1, np.int64)
    rows = np.arange(batch.n)
    for k, rule in enumerate(ordered):
        if not len(rows):
            break
        ok = rule.passes(batch)
        out[rows[~ok]] = k
        if not ok.all():
            rows, batch = rows[ok], batch.take(np.flatnonzero(ok)) if ok.mean() < 0.8 else _View(batch, np.flatnonzero(ok))
    return out


class _View(Batch):
    """Most rows of a batch, without copying the bytes: features come from the whole batch."""

    def __init__(self, whole: Batch, rows: np.ndarray):
        self.whole, self.rows = (whole.whole, whole.rows[rows]) if isinstance(whole, _View) else (whole, rows)
        self.n = len(rows)

    def get(self, name: str):
        return self.whole.get(name)[self.rows]

    def take(self, rows: np.ndarray) -> Batch:
        return self.whole.take(self.rows[rows])


def judged(docs: DataFrame, text: str = "text", using: list[Rule] | None = None, report: bool = False, sample_rows: int = SAMPLE_ROWS, name: str = "failed_rule") -> DataFrame:
    """Every row of `docs` with `failed_rule` (or another `name`; null: kept) after its own columns; with `report` the base measures too.

    With `report` the measures are computed for every text, so rules that need them cost nothing more.
    Null and empty texts have no words and fail `min_words`. Repeated rows are judged one by one. Columns of the
    input that are named like an added one are replaced. An empty table gives an empty table.
    """
    using = rules() if using is None else using
    ordered = plan(docs, using, text, sample_rows)
    added = [T.StructField(name, T.StringType())]
    measures = ["n_words", "n_word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if report else []
    added += [T.StructField(m, T.LongType()) for m in measures] + ([T.StructField("base_ok", T.BooleanType())] if report else [])
    own = docs.drop(*[f.name for f in added])
    schema = T.StructType(own.schema.fields + added)
    base = [r for r in using if r.name in ("min_words", "repeats")]
    names = [r.name for r in ordered]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i, j, buf, off in X.pieces(rb, text):
                batch = Batch(buf, off)
                extra = [pa.array(batch.get(m).astype(np.int64)) for m in measures]
                if report:
                    ok = np.ones(batch.n, bool)
                    for r in base:
                        ok &= r.passes(batch)
                    extra.append(pa.array(ok))
                why = cascade(batch, ordered)
                said = pa.array([names[k] if k >= 0 else None for k in why.tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*rb.slice(i, j - i).columns, said, *extra], names=schema.names)

    return own.mapInArrow(run, schema)


def kept(docs: DataFrame, text: str = "text", using: list[Rule] | None = None) -> DataFrame:
    """The rows of `docs` that no rule rejects, with their own columns."""
    (why,) = fresh(docs, "failed_rule")
    return judged(docs, text, using, name=why).where(F.col(why).isNull()).drop(why)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judged(docs, report=True).select(
        "doc_id", "n_words", F.col("n_word_chars").alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_ok")).alias("base_failed"), F.col("failed_rule").isNull().alias("kept"),
    )


_W = "[^\\x20\\x09-\\x0D]+"
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_W}') AS ws FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + 2) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS k FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_W}') GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(ln.n, 0) AS n_lines, coalesce(ln.n - ln.k, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  length(regexp_replace(t, '[^A-Za-z\x{{C0}}-\x{{10FFFF}}]+', '', 'g')) AS alpha, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS upper FROM w LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 10 * n_symbols <= n_words AND 2 * upper <= alpha AND 2 * alpha >= word_chars AND 2 * n_dup_lines <= greatest(1, n_lines) AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words AS kept
FROM f
"""
