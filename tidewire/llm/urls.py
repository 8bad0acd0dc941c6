"""URL filters: base rules by host and path, then association rules mined with FP-growth; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans.store import save

#: Verdict, host and path of the base rules.
BASE = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Least share and least number of the labelled pages that a combination comes in, least share of bad ones among them.
SUPPORT, LEAST, CONFIDENCE = 0.0005, 20, 0.6
#: Labelled pages that rules are mined on, about. Every page is judged by all its tokens, and every rule that is found counts.
FIT_ROWS = 50_000
#: Tokens of a page that the SQL mines, the rarest of those frequent enough. The queries mine all.
TOKENS = 10
#: Tokens of a page up to which FP-growth takes all combinations, 2^LONGEST of a page at most; with longer pages those that can be rules are found token by token.
LONGEST = 13
#: Rules up to which their index is broadcast (about 200 bytes each); a larger one is joined by shuffles.
BROADCAST_ROWS = 500_000

_BAD = "=bad"


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or no ://."""
    after = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or no ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def base_rule() -> tuple[Column, Column]:
    """Rule and verdict of the longest base rule that fits columns host and path; null where none does."""
    rule = verdict = None
    for said, h, p in sorted(BASE, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return rule, verdict


def tokens() -> Column:
    """Distinct tokens of a url: parts of the host with its suffixes, path segments (digits as one), names of query fields."""
    labels = F.split("host", "\\.")
    parts = F.transform(labels, lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("w:"), x))
    segments = F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(F.col("_url"), F.lit("")), "(?s)\\?([^#]*)", 1)
    fields = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split(x, "=")[0]))
    return F.array_distinct(F.concat(parts, words, segments, fields))


def frequent(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST) -> tuple[DataFrame, DataFrame, float]:
    """`labelled` (tokens, bad) as (row, tokens, bad) with the tokens that are frequent enough, those tokens with their numbers, and the support as a share."""
    pages = labelled.count()
    share = min(1.0, max(support, least / max(1, pages)))
    enough = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= share * pages)
    row = labelled.withColumn("row", F.monotonically_increasing_id())
    seen, enough = save(row, "labelled"), save(enough, "frequent")
    told = seen.select("row", F.explode("tokens").alias("token")).join(enough, "token").groupBy("row").agg(F.collect_list("token").alias("t"))
    tokens = F.coalesce("t", F.expr("cast(array() as array<string>)"))
    return save(seen.join(told, "row", "left").select("row", tokens.alias("tokens"), "bad"), "mined"), enough, share


def _grown(rows: DataFrame, share: float, confidence: float) -> DataFrame:
    """(items, freq, hits) of all combinations whose bad pages are frequent, by FP-growth."""
    rows = rows.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(_BAD))).otherwise(F.col("tokens")).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(rows).freqItemsets
    sets = save(sets.select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq")), "itemsets")
    bad = sets.where(F.array_contains("items", _BAD) & (F.size("items") > 1)).select(F.array_remove("items", _BAD).alias("items"), F.col("freq").alias("hits"))
    return bad.join(sets, "items").select("items", "freq", "hits")


def _stepped(rows: DataFrame, share: float) -> DataFrame:
    """(items, freq, hits) of all combinations whose bad pages are frequent and that no part of them makes needless, one token more at a time.

    A combination on the same pages as a part of it says what that part says, and one of a part whose pages are all bad says no more: neither can be
    a rule that stays, nor can any with more tokens. So only the others are extended, whatever the number of a page's tokens.
    """
    need = share * rows.count()
    single = rows.select("row", "bad", F.explode("tokens").alias("token"))
    at, found, parts = single.select("row", "bad", F.array("token").alias("items")), None, None
    while True:
        seen = at.groupBy("items").agg(F.count("*").alias("freq"), F.count_if("bad").alias("hits")).where(F.col("hits") >= need)
        if parts is not None:
            part = seen.select("items", "freq", F.explode("items").alias("one")).select("items", "freq", F.array_remove("items", F.col("one")).alias("part"))
            told = part.join(parts.select(F.col("items").alias("part"), F.col("freq").alias("f")), "part").where("f > freq").groupBy("items").agg(F.count("*").alias("told"))
            seen = seen.join(told, "items").where(F.col("told") == F.size("items")).drop("told")
        seen = save(seen, "itemsets")
        found = seen if found is None else found.unionByName(seen)
        parts = seen.where("hits < freq")
        if parts.isEmpty():
            return found
        open_ = save(at.join(parts.select("items"), "items"), "open")
        at = open_.join(single, ["row", "bad"]).where(F.col("token") > F.element_at("items", -1)).select("row", "bad", F.array_append("items", F.col("token")).alias("items"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """(rule, n, confidence, token, items) of combinations that say "bad", each with the rarest of its tokens, by which pages look it up.

    `labelled` has tokens and bad. A combination must come in the share `support` of its rows and in `least` of them; a rule is
    pruned if a part of it, one token less, is as confident. All tokens of a page count.
    """
    rows, single, share = frequent(labelled, support, least)
    longest = rows.agg(F.max(F.size("tokens"))).first()[0] or 0
    sets = _grown(rows, share, confidence) if longest <= LONGEST else _stepped(rows, share)
    rules = save(sets.select("items", "freq", (F.col("hits") / F.col("freq")).alias("confidence")).where(F.col("confidence") >= confidence), "rules")
    part = rules.select("items", F.explode("items").alias("one"), "confidence").select("items", "confidence", F.array_remove("items", F.col("one")).alias("rest"))
    implied = part.join(rules.select(F.col("items").alias("rest"), F.col("confidence").alias("c")), "rest").where("c >= confidence").select("items").distinct()
    best = rules.join(implied, "items", "left_anti")
    rarest = best.select("items", F.explode("items").alias("token")).join(single, "token").groupBy("items").agg(F.min(F.struct("n", "token")).alias("at"))
    return best.join(rarest, "items").select(F.array_join("items", " ").alias("rule"), F.size("items").alias("n"), "confidence", F.col("at.token").alias("token"), "items")


def fit_share(key: Column) -> Column:
    """A number from 0 up to 1 of a key, by its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


def judged(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", label_key: str = "doc_id", fit_on: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, host, path, rule, verdict, mined_rule, confidence) of each row of `pages`.

    The verdict is the base rule's, else block if a mined rule matches, else allow. A null url has no host, path or tokens
    and is allowed. Rules are mined on pages with a label (bad: toxic or of low quality), on those whose hash is below the quantile that
    leaves about FIT_ROWS; what is held out by `fit_on` is not looked at. Of a page all tokens are mined. Repeated rows each get their result.
    """
    bad = labels.where(F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("_k")).agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    rows = pages.select(F.col(key), F.col(url).alias("_url")).withColumns({"host": host(F.col("_url")), "path": path(F.col("_url"))})
    rows = rows.withColumn("tokens", F.when(F.col("host") != "", tokens()).otherwise(F.expr("cast(array() as array<string>)")))
    share = FIT_ROWS / max(labels.count(), FIT_ROWS)
    labelled = rows.select(F.col(key).alias("_k"), "tokens").join(bad, "_k").where(fit_share(F.col("_k")) < share)
    rules = (labelled if fit_on is None else labelled.where(fit_on(F.col("_k")))).select("tokens", "bad").transform(mine)
    rules = save(rules.orderBy("confidence", "rule").withColumn("place", F.monotonically_increasing_id()), "index")  # the greatest place is the best rule
    index, said = rules.select("token", "items", "place"), rules.select("place", F.struct("confidence", "rule").alias("m"))
    if rules.count() <= BROADCAST_ROWS:
        index, said = F.broadcast(index), F.broadcast(said)
    own = {"_row": F.xxhash64(F.col(key), F.col("_url")), "_rowb": F.xxhash64(F.lit("second"), F.col("_url"), F.col(key))}  # 128 bits know a row
    rows = rows.withColumns(own)
    # a rule meets the pages that have its rarest token; a whole number is pre-aggregated, so that one row of a page is shuffled
    looked = rows.select(*own, "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("items", "tokens")) == 0)
    matched = looked.groupBy(*own).agg(F.max("place").alias("place")).join(said, "place").drop("place")
    rule, verdict = base_rule()
    out = rows.drop("tokens", "_url").join(matched, list(own), "left")
    return out.select(key, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("m").isNotNull(), "block"), F.lit("allow")).alias("verdict"), F.col("m.rule").alias("mined_rule"), F.col("m.confidence").alias("confidence"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("page_id", "host", "path", "rule", "verdict")


_FITS = [(f"(t.host = '{h}' OR ends_with(t.host, '.{h}')) AND starts_with(t.path, '{p}')", h + p, said) for said, h, p in sorted(BASE, key=lambda r: -len(r[1] + r[2]))]
_RULE, _VERDICT = ("CASE " + " ".join(f"WHEN {x} THEN '{f[k]}'" for x, *f in _FITS) + " END" for k in (0, 1))


def _oracle() -> str:
    """The whole query in SQL; frequent combinations are counted by all subsets of the pages' tokens, not by a tree."""
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT page_id, host, path, CASE WHEN host = '' THEN [] ELSE list_distinct(list_concat(list_concat(list_transform(string_split(host, '.'), lambda x: 'h:' || x), list_transform(flatten(list_transform(string_split(host, '.'), lambda x: string_split(x, '-'))), lambda x: 'w:' || x)),
  list_concat(list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(x, '[0-9]+', '0', 'g')),
  list_transform(list_filter(string_split(regexp_extract(url, '(?s)\?([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'q:' || split_part(x, '=', 1))))) END AS tokens FROM h),
bad AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
l AS (SELECT row_number() OVER () AS r, tokens, bad FROM t JOIN bad ON bad.doc_id = t.page_id WHERE ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < {FIT_ROWS} / greatest((SELECT count(*) FROM labels), {FIT_ROWS})),
n AS (SELECT least(1.0, greatest({SUPPORT}, {LEAST} / greatest(1, count(*)))) * count(*) AS least_ FROM l),
e AS (SELECT token, count(*) AS n FROM (SELECT unnest(tokens) AS token FROM l) GROUP BY token HAVING count(*) >= (SELECT least_ FROM n)),
k AS (SELECT r, bad, token FROM (SELECT r, bad, token, row_number() OVER (PARTITION BY r ORDER BY n, token) AS i FROM (SELECT r, bad, unnest(tokens) AS token FROM l) JOIN e USING (token)) WHERE i <= {TOKENS}),
p AS (SELECT r, bad, list_sort(list(token)) AS ts FROM k GROUP BY r, bad),
s AS (SELECT bad, list_filter(ts, lambda x, i: (m >> (i - 1)) & 1 = 1) AS items FROM (SELECT bad, ts, unnest(range(1, 1 << len(ts))) AS m FROM p)),
f AS (SELECT items, count(*) AS freq, sum(bad) AS hits FROM s GROUP BY items),
rules AS (SELECT items, hits / freq AS c FROM f WHERE hits >= (SELECT least_ FROM n) AND hits / freq >= {CONFIDENCE}),
best AS (SELECT * FROM rules a WHERE NOT EXISTS (SELECT 1 FROM (SELECT items, c, unnest(range(1, len(items) + 1)) AS i FROM rules) x JOIN rules y ON y.items = list_filter(x.items, lambda z, j: j <> x.i) WHERE x.items = a.items AND y.c >= x.c))
SELECT t.page_id, t.host, t.path, {_RULE} AS rule, coalesce({_VERDICT}, CASE WHEN EXISTS (SELECT 1 FROM best WHERE list_has_all(t.tokens, best.items)) THEN 'block' ELSE 'allow' END) AS verdict FROM t
"""


ORACLE_SQL = _oracle()


#: Labels that tell something of URLs, for the pages themselves: one path is bad, one kind of host with another path is, and so are some query fields. Of every eleven pages one label is wrong.
_PLANTED = """SELECT page_id AS doc_id, 1 AS quality, CASE WHEN (url LIKE '%/fr/%' OR (url LIKE '%//blog.%' AND url LIKE '%/en/%') OR (url LIKE '%page=%' AND url LIKE '%//www.%')) <> (page_id % 11 = 5) THEN 1 ELSE 0 END AS toxic FROM {pages}"""


def planted_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter with labels that have something to mine: verdicts and the mined rule of every page, by rules mined on all its tokens. Its SQL still mines TOKENS of a page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judged(pages, spark.sql(_PLANTED, pages=pages)).select("page_id", "rule", "verdict", "mined_rule")


PLANTED_SQL = f"""{_oracle().strip().replace("WITH u AS", f"WITH labels AS ({_PLANTED.format(pages='pages')}), u AS", 1).split("SELECT t.page_id, t.host")[0]},
m AS (SELECT t.page_id, array_to_string(items, ' ') AS mined_rule, row_number() OVER (PARTITION BY t.page_id ORDER BY c DESC, array_to_string(items, ' ') DESC) AS i FROM t JOIN best ON list_has_all(t.tokens, best.items)),
v AS (SELECT t.page_id, {_RULE} AS rule, {_VERDICT} AS said FROM t)
SELECT v.page_id, rule, coalesce(said, CASE WHEN mined_rule IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, mined_rule FROM v LEFT JOIN m ON m.page_id = v.page_id AND i = 1
"""
