"""Mixing to target weights with soft membership; DataFrame functions only.

A naive Bayes classifier, fitted on labelled rows by the presence of telling words, gives every document posteriors of its domains. Document rates
are then the nonnegative solution of least squares: the expected token totals of the domains are to be the targets.
Projected gradient descent starts at rate 1; each step is one distributed sum of a few numbers for each domain, and the rate of a document is a closed expression of its posteriors and the steps so far.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans.store import save

#: Domains by their labels, and the share of tokens that each is to have.
TARGETS = {"clean": 0.97, "low": 0.02, "toxic": 0.01}
#: Labelled documents on which the classifier is fitted, about; pseudo-documents of a domain; standard deviations that make a word telling.
FIT_ROWS, PSEUDO, SURE = 20_000, 2.0, 4.0
#: Documents that a telling word is in at least, and share of a domain's documents: one group of copies tells nothing. So there
#: are no more telling words than a document has distinct ones over COMMON, for each domain.
LEAST_DOCS, COMMON = 5, 0.01
#: Telling words of a model at most; more are an error (fit on fewer rows), for none is left out silently.
WORDS = 200_000
#: Log odds are kept as whole numbers of this part.
GRAIN = 100
#: A domain is drawn at most this often on average: an aim above that is lowered to it, for the tokens aren't there.
REPEATS = 1.0
#: Steps of projected gradient descent at most, and the relative miss of the targets at which it ends.
STEPS, ENOUGH = 25, 1e-6


def domain() -> Column:
    """The domain of a labelled row; null where the labels don't tell."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _hashes(tokens: Column) -> Column:
    """Hashes of the distinct words."""
    return F.array_distinct(F.transform(tokens, lambda w: F.xxhash64(w)))


@dataclass(frozen=True)
class Model:
    """Bernoulli model: log odds of a text without any telling word by domain; in `slots` the telling words' hashes, each at one of
    its two places (0: none), and at the same places the whole-number log odds that each word adds by domain."""

    base: list[float]
    slots: list[int]
    odds: list[list[int]]


def _two(h: int, size: int) -> tuple[int, int]:
    """The two places of a hash, from 0: by its lower and by its upper half."""
    return h % size, (h >> 32) % size


def slots(hashes: list[int]) -> list[int]:
    """Every hash at one of its two places, in a table that grows until all have one (cuckoo hashing); 0 is an empty place."""
    size = 256
    while size < 4 * len(hashes):
        size *= 2
    while True:
        table, homeless = [0] * size, 0
        for h in hashes:
            at = _two(h, size)[0]
            for _ in range(500):
                h, table[at] = table[at], h
                if not h:
                    break
                one, other = _two(h, size)
                at = other if at == one else one
            else:
                homeless += 1
                break
        if not homeless:
            return table
        size *= 2


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Model:
    """The model of labelled documents; a few numbers for each telling word, whatever the size of the input.

    Fitted on the labelled documents whose hash is below the quantile that leaves about `rows`. Contradictory labels of a
    document count each. Only telling words count, for thousands of slight ones would add up to certainty: those that in some
    domain come at least twice or at most half as often as its share of words lets expect, by SURE standard deviations.
    Without labelled rows every domain is as likely.
    """
    known = labels.select(F.col(key).alias("_id"), domain().alias("domain")).where(F.col("domain").isin(domains) & F.col("_id").isNotNull()).distinct()
    there = known.count()
    known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < math.ceil(1e6 * rows / max(there, rows)))
    seen = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")  # bounded by `rows`
    each = [F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)]
    words = seen.select("domain", F.explode(F.concat(F.array(F.lit(0).cast("long")), _hashes(_tokens(F.col("_text"))))).alias("h"))  # 0: the document itself
    counts = save(words.groupBy("h").agg(*each), "words")
    k = range(len(domains))
    total = counts.agg(*(F.coalesce(F.sum(F.when(F.col("h") == 0, F.col(f"n{i}"))), F.lit(0)) for i in k), *(F.coalesce(F.sum(F.when(F.col("h") != 0, F.col(f"n{i}"))), F.lit(0)) for i in k)).first()
    docs_of, words_of = [float(x) for x in total[: len(domains)]], [float(x) for x in total[len(domains) :]]
    share = [w / max(sum(words_of), 1.0) for w in words_of]
    every = sum((F.col(f"n{i}") for i in k[1:]), F.col("n0")).cast("double")
    sure = [F.abs(F.col(f"n{i}") - every * share[i]) / F.sqrt(every * share[i] + 1) for i in k]
    far = [(F.col(f"n{i}") >= every * 2 * share[i]) | (F.col(f"n{i}") <= every * share[i] / 2) for i in k]
    wide = [every >= max(float(LEAST_DOCS), COMMON * docs_of[i]) for i in k]
    tells = [F.when(far[i] & wide[i], sure[i]).otherwise(0.0) if share[i] else F.lit(0.0) for i in k]
    best = F.greatest(*tells) if len(domains) > 1 else tells[0]
    chosen = counts.where("h <> 0").withColumns({"z": best, **{f"t{i}": tells[i] >= SURE for i in k}}).where(F.col("z") >= SURE).orderBy("h").limit(WORDS + 1).collect()
    if len(chosen) > WORDS:
        raise ValueError(f"over {WORDS} telling words: fit on fewer rows")
    base = [math.log((n + 1) / (sum(docs_of) + len(domains))) for n in docs_of]
    held = slots([r["h"] for r in chosen])
    place = {h: i for i, h in enumerate(held) if h}
    odds = [[0] * len(held) for _ in k]
    for r in chosen:
        at = place[r["h"]]
        n = [r[f"n{i}"] for i in k]
        rest = [i for i in k if not r[f"t{i}"]]
        for i in k:
            like = [i] if r[f"t{i}"] else rest  # domains of which the word tells nothing count as one
            p = (sum(n[j] for j in like) + PSEUDO * sum(n) / sum(docs_of)) / (sum(docs_of[j] for j in like) + PSEUDO)
            p = min(max(p, 1e-6), 1 - 1e-6)
            odds[i][at] = round(GRAIN * math.log(p / (1 - p)))
            base[i] += math.log(1 - p)
    top = max(base)
    return Model([x - top for x in base], held, odds)


def _constant(numbers: list[int], kind: str) -> Column:
    """An array that is folded to one constant."""
    return F.split(F.lit(" ".join(map(str, numbers))), " ").cast(f"array<{kind}>")


def _add(held: Column):
    return lambda acc, b: acc + F.element_at(held, b) / GRAIN


def posteriors(docs: DataFrame, model: Model, domains: list[str], text: str = "text") -> DataFrame:
    """`docs` with n_tokens and p_<domain> of each row; a text without telling words has the same as any such text."""
    held, size = _constant(model.slots, "bigint"), F.lit(len(model.slots))
    one = lambda h: (F.pmod(h, size) + 1).cast("int")
    two = lambda h: (F.pmod(F.shiftright(h, 32), size) + 1).cast("int")
    tell = F.filter(_hashes(F.col("_words")), lambda h: (F.element_at(held, one(h)) == h) | (F.element_at(held, two(h)) == h))
    at = F.transform(tell, lambda h: F.when(F.element_at(held, one(h)) == h, one(h)).otherwise(two(h)))
    out = docs.withColumn("_words", _tokens(F.col(text))).withColumn("n_tokens", F.size("_words").cast("long")).withColumn("_at", at)
    for d, base, odds in zip(domains, model.base, model.odds, strict=True):
        out = out.withColumn(f"_l_{d}", F.aggregate("_at", F.lit(base), _add(_constant(odds, "smallint"))))
    top = F.greatest(*(F.col(f"_l_{d}") for d in domains)) if len(domains) > 1 else F.col(f"_l_{domains[0]}")
    out = out.withColumn("_sum", sum((F.exp(F.col(f"_l_{d}") - top) for d in domains[1:]), F.exp(F.col(f"_l_{domains[0]}") - top)))
    out = out.withColumns({f"p_{d}": F.exp(F.col(f"_l_{d}") - top) / F.col("_sum") for d in domains})
    return out.drop("_words", "_at", "_sum", *(f"_l_{d}" for d in domains))


def _solve(m: list[list[float]], b: list[float]) -> list[float]:
    """m x = b for a small symmetric positive semidefinite m; a hint of ridge keeps an empty domain harmless."""
    n = len(b)
    ridge = 1e-9 * (sum(m[i][i] for i in range(n)) or 1.0)
    a = [[*m[i], b[i]] for i in range(n)]
    for i in range(n):
        a[i][i] += ridge
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        for r in range(n):
            if r != i:
                f = a[r][i] / a[i][i]
                a[r] = [x - f * y for x, y in zip(a[r], a[i], strict=True)]
    return [a[i][n] / a[i][i] for i in range(n)]


def rates(table: DataFrame, targets: dict[str, float], steps: int = STEPS, enough: float = ENOUGH) -> Column:
    """The rate of each row of `table` (n_tokens, p_<domain>) as an expression.

    The aim of a domain is its share of the total at which the domain with the largest share keeps its expected
    tokens, but no more than REPEATS times what it has. The objective is the squared miss of the aims; a step goes down
    its gradient in the metric of the Gram matrix of the rows that are free to move, and is projected on rates of 0 or more.
    Rates are scaled by token counts, so that they depend on what a document is and not on how long it is. Aims that soft
    members of other domains can't meet are met as nearly as nonnegative rates allow.
    """
    names = list(targets)
    n, p = F.col("n_tokens"), [F.coalesce(F.col(f"p_{d}"), F.lit(0.0)) for d in names]
    k = range(len(names))

    def sums(rate: Column):
        """Expected tokens of the domains, and the Gram matrix of the rows whose rate isn't held at 0."""
        own = [F.coalesce(F.sum(n * p[i] * rate), F.lit(0.0)) for i in k]
        free = [F.coalesce(F.sum(F.when(rate > 0, n * p[i] * p[j])), F.lit(0.0)) for i in k for j in k]
        got = list(table.agg(*own, *free).first())
        return got[: len(names)], [[got[len(names) * (1 + i) + j] for j in k] for i in k]

    rate: Column = F.lit(1.0)
    now, gram = sums(rate)
    lead = max(k, key=lambda i: targets[names[i]])
    aim = [min(now[lead] * targets[d] / targets[names[lead]], REPEATS * x) for d, x in zip(names, now, strict=True)]
    size, last = 1.0, None
    for _ in range(steps):
        miss = [x - y for x, y in zip(now, aim, strict=True)]
        if max(abs(x) for x in miss) <= enough * max(1.0, *aim) or (last is not None and size < 1e-6):
            break
        step = [size * x for x in _solve(gram, miss)]
        tried = F.greatest(F.lit(0.0), rate - sum((p[i] * step[i] for i in k[1:]), p[0] * step[0]))
        then, after = sums(tried)
        worth = sum((x - y) ** 2 for x, y in zip(then, aim, strict=True))
        if last is not None and worth >= last:
            size /= 2  # too far: a shorter step from the same place
            continue
        rate, now, gram, last, size = tried, then, after, worth, min(1.0, 2 * size)
    else:
        warnings.warn(f"the targets are missed by {[round(x - y, 3) for x, y in zip(now, aim, strict=True)]} tokens after {steps} steps", stacklevel=2)
    return rate


def shares(mix: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """(domain, target, tokens, share): what a mix (n_tokens, p_<domain>, rate) comes to, for a domain may have fewer tokens than its target asks for."""
    got = [F.coalesce(F.sum(F.col("n_tokens") * F.col(f"p_{d}") * F.col("rate")), F.lit(0.0)) for d in targets]
    total = mix.agg(F.array(*got).alias("t")).select("t", F.aggregate("t", F.lit(0.0), lambda a, x: a + x).alias("all"))
    names = F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(w).alias("target")) for d, w in targets.items()))
    return total.select("all", F.posexplode(F.arrays_zip(names.alias("d"), "t")).alias("k", "x")).select("x.d.domain", "x.d.target", F.col("x.t").alias("tokens"), F.when(F.col("all") > 0, F.col("x.t") / F.col("all")).alias("share"))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Rows of `docs` (its columns, or those of `carry`) with n_tokens, p_<domain> and rate: how often each is to be drawn.

    Null, empty and wordless texts have no tokens and the priors as posteriors. Repeated rows are rated one by one.
    Columns named like an added one are replaced. Without tokens in a domain its aim can't be met and the rest is fitted.
    """
    domains = list(targets)
    own = [c for c in (carry or docs.columns) if c not in ("n_tokens", "rate", *(f"p_{d}" for d in domains))]
    model = fit(docs, labels, domains, key, text)
    packed = docs.select(F.struct(*own).alias("own"), F.col(text).alias("text"))
    table = save(posteriors(packed, model, domains).drop("text"), "posteriors")
    return table.withColumn("rate", rates(table, targets)).select("own.*", "n_tokens", *(f"p_{d}" for d in domains), "rate")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=["doc_id"])
