"""Enrichment of an edition's CVE ids with exploitation catalogues. Absence is a state of its own, never a null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import scalars as S

_CVE = r"^CVE-\d{4}-\d{4,7}\z"


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _type(v: Column | str, path: str) -> Column:
    """Type of a member: STRING, BIGINT, OBJECT<...>, ...; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column | str, path: str) -> Column:
    """A member that is text; null for anything else."""
    return F.when(_type(v, path) == "STRING", _get(v, path))


def kev_entries(catalogue: DataFrame, now_ms: int, by: list[str] | None = None) -> DataFrame:
    """(by, pos, cve, added, due, ransomware, valid) of each entry of catalogues (a row with text `body` for each, told apart by the columns `by`)."""
    by = by or []
    last = F.date_format(F.timestamp_millis(F.lit(now_ms + 86_400_000)), "yyyy-MM-dd")
    doc = catalogue.select(*by, F.try_parse_json("body").alias("doc"))
    each = doc.lateralJoin(_variant_explode(doc, "vulnerabilities"))
    out = each.select(*by, F.col("pos").cast("int"), _text("value", "$.cveID").alias("cve"), _text("value", "$.dateAdded").alias("added"), _text("value", "$.dueDate").alias("due"), F.coalesce(_text("value", "$.knownRansomwareCampaignUse") == "Known", F.lit(False)).alias("ransomware"))
    ok = S.is_cve("cve") & S.real_date("added") & (F.col("added") >= C.KEV_FIRST) & (F.col("added") <= last) & ((F.col("due") == "") | S.real_date("due"))
    return out.withColumn("valid", F.coalesce(ok, F.lit(False)))


def kev_declared(catalogue: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, shape, declares, declared): what each body says of its entries' number. `declares` is whether it has a count at all; one that is no
    number, null too, leaves `declared` null. shape is null, or why the body is none: not an object, or without a list of entries."""
    doc = catalogue.select(*(by or []), F.try_parse_json("body").alias("doc"))
    kind = F.coalesce(F.schema_of_variant("doc"), F.lit(""))
    has_list = F.coalesce(_type("doc", "$.vulnerabilities").startswith("ARRAY"), F.lit(False))
    count = _type("doc", "$.count")
    number = F.when(count.isin("BIGINT", "DOUBLE") | count.startswith("DECIMAL"), _get("doc", "$.count", "double"))
    shape = F.when(~kind.startswith("OBJECT"), "not an object").when(~has_list, "no entries")
    return doc.select(*(by or []), shape.alias("shape"), count.isNotNull().alias("declares"), number.alias("declared"))


def _variant_explode(doc: DataFrame, member: str) -> DataFrame:
    return doc.sparkSession.tvf.variant_explode(F.try_variant_get(F.col("doc").outer(), f"$.{member}", "variant"))


def kev_slim(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, cve, added, due, ransomware): of each id of a catalogue its first valid entry."""
    by = by or []
    return entries.where("valid").groupBy(*by, "cve").agg(F.min_by(F.struct("added", "due", "ransomware"), "pos").alias("e")).select(*by, "cve", "e.*")


def kev_gate(entries: DataFrame, declared: DataFrame | int | None = None, min_entries: int = C.KEV_MIN, max_slim: int = C.KEV_SLIM_BYTES, by: list[str] | None = None) -> DataFrame:
    """One row for each catalogue: n, valid, skipped, slim_bytes and why it is rejected (null: taken).

    `declared` is what `kev_declared` reads from the bodies, so that a catalogue without entries has its row too, or the number itself.
    A count that the body has but that isn't the number of its entries, null or text for instance, rejects it.
    """
    by = by or []
    sums = entries.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("skipped"))
    slim = kev_slim(entries, by).groupBy(*by).agg(F.count("*").alias("valid"), F.sum(F.octet_length(F.to_json(F.struct("added", "due", "ransomware"))) + F.octet_length("cve") + 4).alias("slim_bytes"))
    if not isinstance(declared, DataFrame):
        one = F.lit(declared).cast("double")
        declared = sums.select(*by, F.lit(None).cast("string").alias("shape"), one.isNotNull().alias("declares"), one.alias("declared"))
    out = declared
    for part in (sums, slim):
        out = out.join(part, by, "left") if by else out.join(part.hint("broadcast"))  # one row each
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "skipped", "valid")}).withColumn("slim_bytes", F.coalesce("slim_bytes", F.lit(0)) + 100)
    off = F.col("declares") & ~F.coalesce(F.col("declared") == F.col("n"), F.lit(False))
    why = F.coalesce("shape", F.when(off, "count").when(F.col("skipped") > F.col("n") * C.KEV_SKIPPED, "schema drift").when((F.col("valid") == 0) | (F.col("valid") < min_entries), "too few").when(F.col("slim_bytes") > max_slim, "too large"))
    return out.select(*by, "n", "skipped", "valid", "slim_bytes", why.alias("rejected"))


def epss_selected(ids: DataFrame, cap: int = C.EPSS_IDS, size: int = C.EPSS_BATCH) -> DataFrame:
    """(cve, pos, batch) of ids (cve, pos): the first `cap` by appearance, then in batches of sorted ids; batch is null beyond the cap."""
    kept = ids.where(F.col("pos") <= cap)
    batch = F.floor((F.row_number().over(Window.orderBy("cve")) - 1) / size).cast("long")  # `cap` rows
    return kept.withColumn("batch", batch).unionByName(ids.where(F.col("pos") > cap).withColumn("batch", F.lit(None).cast("long")))


def epss_states(selected: DataFrame, answers: DataFrame) -> DataFrame:
    """(cve, state, score, date) of selected ids by the answers (batch, body): scored, no-row or unavailable.

    An answer counts only if its status is OK, and its total is its number of rows and not over the batch's size. Of an id the
    first valid row counts; one with invalid rows only is unavailable.
    """
    doc = answers.select("batch", F.try_parse_json("body").alias("doc"))
    rows = doc.lateralJoin(_variant_explode(doc, "data")).select("batch", "pos", F.upper(_text("value", "$.cve")).alias("cve"), _get("value", "$.epss").alias("raw"), _type("value", "$.epss").alias("kind"), _text("value", "$.date").alias("date"))
    sizes = selected.where("batch is not null").groupBy("batch").agg(F.count("*").alias("asked"))
    count = rows.groupBy("batch").agg(F.count("*").alias("n"))
    is_array = F.coalesce(_type("doc", "$.data").startswith("ARRAY"), F.lit(False))
    good = doc.join(sizes, "batch").join(count, "batch", "left").where((_text("doc", "$.status") == "OK") & is_array & (_type("doc", "$.total") == "BIGINT") & (_get("doc", "$.total", "long") == F.coalesce("n", F.lit(0))) & (F.coalesce("n", F.lit(0)) <= F.col("asked"))).select("batch")
    number = F.when(F.col("raw").rlike(r"^\d+(\.\d+)?\z") & F.col("kind").isin("STRING", "BIGINT", "DOUBLE") | F.col("kind").startswith("DECIMAL"), F.col("raw").try_cast("double"))
    asked = selected.where("batch is not null").select("batch", "cve")
    valid = rows.withColumn("score", F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))).withColumn("valid", F.col("score").isNotNull() & F.coalesce(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.lit(False)))
    seen = valid.join(asked, ["batch", "cve"]).groupBy("batch", "cve").agg(F.min_by(F.when(F.col("valid"), F.struct("score", "date")), F.when(F.col("valid"), F.col("pos"))).alias("hit"), F.count("*").alias("k"))
    out = selected.join(good.withColumn("answered", F.lit(True)), "batch", "left").join(seen, ["batch", "cve"], "left")
    state = F.when(F.col("answered").isNull(), "unavailable").when(F.col("hit").isNotNull(), "scored").when(F.col("k").isNotNull(), "unavailable").otherwise("no-row")
    scored = state == "scored"
    return out.select("cve", state.alias("state"), F.when(scored, F.col("hit.score")).alias("score"), F.when(scored, F.col("hit.date")).alias("date"))


def kev_states(ids: DataFrame, slim: DataFrame, known: bool = True) -> DataFrame:
    """(cve, state, added, ransomware): listed, not-listed, or unavailable if no catalogue was read."""
    out = ids.select("cve").join(slim, "cve", "left")
    state = F.when(F.lit(not known), "unavailable").when(F.col("added").isNotNull(), "listed").otherwise("not-listed")
    return out.select("cve", state.alias("state"), *(F.when(state == "listed", F.col(c)).alias(c) for c in ("added", "ransomware")))


def chips(cards: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(edition_pos, cve, chip_rank, overflow) of each article's valid ids, the most pressing first; CHIPS are visible.

    `cards` has edition_pos and cves; `states` cve, kev_state, added, ssvc, epss_state, score. Order: listed in the catalogue, newest first;
    exploitation active, then proof of concept; scored, highest first; as extracted.
    """
    seen = cards.select("edition_pos", F.posexplode("cves").alias("p", "cve")).where(S.is_cve("cve"))
    if states is None:
        states = seen.select("cve", F.lit(None).cast("string").alias("kev_state"), F.lit(None).cast("string").alias("added"), F.lit(None).cast("string").alias("ssvc"), F.lit(None).cast("string").alias("epss_state"), F.lit(None).cast("double").alias("score")).distinct()
    rows = seen.join(states, "cve", "left")
    listed = F.coalesce(F.col("kev_state") == "listed", F.lit(False))
    tier = F.when(~listed & (F.col("ssvc") == "active"), 0).when(~listed & (F.col("ssvc") == "poc"), 1).otherwise(2)
    shown = F.when(F.col("epss_state") == "scored", F.col("score"))
    order = [F.when(listed, 0).otherwise(1), F.when(listed, F.col("added")).desc_nulls_last(), tier, shown.desc_nulls_last(), "p"]
    n = F.count("*").over(Window.partitionBy("edition_pos"))
    return rows.select("edition_pos", "cve", F.row_number().over(Window.partitionBy("edition_pos").orderBy(*order)).cast("long").alias("chip_rank"), F.greatest(F.lit(0), n - C.CHIPS).alias("overflow"), listed.alias("kev"), tier.alias("ssvc_tier"), shown.alias("score"), (shown >= C.EPSS_STRONG).alias("strong"))


def ssvc_selection(ids: DataFrame, kev: DataFrame, epss: DataFrame, cards: DataFrame, kev_known: bool = True, cap: int = C.SSVC_LOOKUPS) -> DataFrame:
    """(cve, choice, priority) of each id: skipped if listed, else lookup for the first `cap` (ids on visible chips, then by score), else overflow."""
    pre = ids.select("cve").join(kev.select("cve", F.col("state").alias("kev_state"), "added"), "cve", "left").join(epss.select("cve", F.col("state").alias("epss_state"), "score"), "cve", "left").withColumn("ssvc", F.lit(None).cast("string"))
    skipped = F.lit(kev_known) & (F.coalesce("kev_state", F.lit("")) == "listed")
    visible = chips(cards, pre).where(F.col("chip_rank") <= C.CHIPS).select("cve").distinct().withColumn("visible", F.lit(True))
    rest = pre.where(~skipped).join(visible, "cve", "left")
    shown = F.when(F.col("epss_state") == "scored", F.col("score"))
    order = Window.orderBy(F.coalesce("visible", F.lit(False)).desc(), shown.desc_nulls_last(), "cve")  # ids of one edition: few
    rest = rest.withColumn("priority", F.row_number().over(order).cast("long")).select("cve", F.when(F.col("priority") <= cap, "lookup").otherwise("overflow").alias("choice"), "priority")
    return pre.where(skipped).select("cve", F.lit("skipped").alias("choice"), F.lit(None).cast("long").alias("priority")).unionByName(rest)


def ssvc_parsed(records: DataFrame) -> DataFrame:
    """(cve, state, exploitation, automatable, impact) of looked-up records (cve, body): assessed, not-assessed or unavailable.

    A record without a container of the assessing organisation is not assessed; any other shape than one container, one
    assessment of major version 2 and its three options, once each with allowed words, is unavailable.
    """
    doc = records.select("cve", F.try_parse_json("body").alias("doc"))
    adp = _type("doc", "$.containers.adp")
    head = doc.select("cve", (_text("doc", "$.cveMetadata.cveId") == F.col("cve")).alias("own"), (F.coalesce(_type("doc", "$.containers"), F.lit("")).startswith("OBJECT")).alias("has"), adp.isNull().alias("none"), F.coalesce(adp, F.lit("")).startswith("ARRAY").alias("array"))
    tvf = doc.sparkSession.tvf
    box = doc.select("cve", "doc").lateralJoin(tvf.variant_explode(F.try_variant_get(F.col("doc").outer(), "$.containers.adp", "variant"))).where(_text("value", "$.providerMetadata.orgId") == C.ADP_ORG).select("cve", F.col("value").alias("box"))
    boxes = box.groupBy("cve").agg(F.count("*").alias("boxes"))
    metric = box.lateralJoin(tvf.variant_explode(F.try_variant_get(F.col("box").outer(), "$.metrics", "variant"))).where(_text("value", "$.other.type") == "ssvc").select("cve", F.try_variant_get("value", "$.other.content", "variant").alias("content"))
    metrics = metric.groupBy("cve").agg(F.count("*").alias("metrics"), F.bool_and(F.coalesce((_text("content", "$.id") == F.col("cve")) & _text("content", "$.version").rlike(r"^2\.\d+\.\d+\z"), F.lit(False))).alias("fits"))
    option = metric.lateralJoin(tvf.variant_explode(F.try_variant_get(F.col("content").outer(), "$.options", "variant"))).select("cve", F.col("value").alias("option"))
    pair = option.lateralJoin(tvf.variant_explode(F.col("option").outer())).select("cve", F.col("key").alias("k"), F.when(F.schema_of_variant("value") == "STRING", F.try_variant_get("value", "$", "string")).alias("v"))
    n_options = option.groupBy("cve").agg(F.count("*").alias("options"))
    said = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    pairs = pair.groupBy("cve").agg(F.count("*").alias("pairs"), F.count_distinct("k").alias("keys"), said("Exploitation").alias("exploitation"), said("Automatable").alias("automatable"), said("Technical Impact").alias("impact"))
    out = head.join(boxes, "cve", "left").join(metrics, "cve", "left").join(n_options, "cve", "left").join(pairs, "cve", "left")
    whole = (F.col("boxes") == 1) & (F.col("metrics") == 1) & F.col("fits") & (F.col("options") == 3) & (F.col("pairs") == 3) & (F.col("keys") == 3) & F.col("exploitation").isin("none", "poc", "active") & F.col("automatable").isin("yes", "no") & F.col("impact").isin("partial", "total")
    fine = F.coalesce(F.col("own") & F.col("has"), F.lit(False))
    state = F.when(~fine, "unavailable").when(F.col("none") | (F.col("array") & F.col("boxes").isNull()), "not-assessed").when(F.coalesce(whole, F.lit(False)), "assessed").otherwise("unavailable")
    return out.select("cve", state.alias("state"), *(F.when(state == "assessed", F.col(c)).alias(c) for c in ("exploitation", "automatable", "impact")))


def enriched(ids: DataFrame, kev: DataFrame, epss: DataFrame, selection: DataFrame, ssvc: DataFrame) -> DataFrame:
    """(cve, kev_state, added, epss_state, score, ssvc_state, ssvc) of each id; what wasn't answered is unavailable."""
    out = ids.select("cve").join(kev.select("cve", F.col("state").alias("kev_state"), "added"), "cve", "left").join(epss.select("cve", F.col("state").alias("epss_state"), "score"), "cve", "left")
    out = out.join(selection.select("cve", "choice"), "cve", "left").join(ssvc.select("cve", F.col("state").alias("s"), "exploitation"), "cve", "left")
    state = F.when(F.col("choice") == "skipped", "skipped").when(F.col("choice") == "lookup", F.coalesce("s", F.lit("unavailable"))).otherwise("unavailable")
    return out.select("cve", F.coalesce("kev_state", F.lit("unavailable")).alias("kev_state"), "added", F.coalesce("epss_state", F.lit("unavailable")).alias("epss_state"), "score", state.alias("ssvc_state"), F.when(state == "assessed", F.col("exploitation")).alias("ssvc"))


def kev_health(fetched_ms: int | None, now_ms: int) -> str:
    if fetched_ms is None:
        return "unavailable"
    return "ok" if max(0, now_ms - fetched_ms) <= C.KEV_HOURS * 3_600_000 else "stale"


def health(states: DataFrame, kev: str = "ok", fetched_ms: int | None = None) -> DataFrame:
    """One row: counts and status of the three catalogues, and the notice to readers (null: all well)."""

    def status(asked: Column, missing: Column) -> Column:
        return F.when((asked == 0) | (missing == 0), "ok").when(missing == asked, "unavailable").otherwise("partial")

    asked = F.col("ssvc_state") != "skipped"
    sums = states.agg(F.count("*").alias("epss_requested"), F.count_if(F.col("epss_state") == "unavailable").alias("epss_unavailable"), F.count_if(asked).alias("ssvc_requested"), F.count_if(asked & (F.col("ssvc_state") == "unavailable")).alias("ssvc_unavailable"))
    out = sums.select(F.lit(kev).alias("kev_status"), "*", status(F.col("epss_requested"), F.col("epss_unavailable")).alias("epss_status"), status(F.col("ssvc_requested"), F.col("ssvc_unavailable")).alias("ssvc_status"))
    day = F.date_format(F.timestamp_millis(F.lit(fetched_ms)), "yyyy-MM-dd") if fetched_ms is not None else F.lit(None).cast("string")
    parts = [F.when(F.col("kev_status") == "unavailable", "KEV data unavailable").when(F.col("kev_status") == "stale", F.coalesce(F.concat(F.lit("KEV data from "), day), F.lit("KEV data unavailable")))]
    for name in ("EPSS", "SSVC"):
        c = F.col(f"{name.lower()}_status")
        parts.append(F.when(c == "unavailable", f"{name} data unavailable").when(c == "partial", f"{name} partially unavailable"))
    return out.withColumn("notice", F.nullif(F.concat_ws(" · ", *parts), F.lit("")))


def epss_urls(selected: DataFrame, base: str) -> DataFrame:
    """(batch, url) of the requests for the batches of selected ids: sorted ids, so the same set has the same URLs."""
    ids = F.array_join(F.array_sort(F.collect_list("cve")), ",")  # one batch of ids
    return selected.where("batch is not null").groupBy("batch").agg(F.concat(F.lit(base + "?cve="), ids, F.lit("&limit=100")).alias("url"))


def record_url(cve: Column, base: str) -> Column:
    return F.concat(F.lit(base + "/"), cve)


def ssvc_answers(answers: DataFrame) -> DataFrame:
    """(cve, state, exploitation, automatable, impact) of look-ups (cve, status, body, late): what came after the deadline, and any status but
    200, is unavailable; but the 404 that says that there is no such record is not-assessed."""
    gone = (F.col("status") == 404) & F.coalesce(_text(F.try_parse_json("body"), "$.error") == "CVE_RECORD_DNE", F.lit(False))
    in_time = answers.where(~F.coalesce("late", F.lit(False)))
    parsed = ssvc_parsed(in_time.where("status = 200").select("cve", "body"))
    absent = in_time.where(gone).select("cve", F.lit("not-assessed").alias("state"), *(F.lit(None).cast("string").alias(c) for c in ("exploitation", "automatable", "impact")))
    found = parsed.unionByName(absent)
    return answers.select("cve").distinct().join(found, "cve", "left").withColumn("state", F.coalesce("state", F.lit("unavailable")))


def cacheable(state: Column, exploitation: Column, automatable: Column, impact: Column) -> Column:
    """Whether an answer may be kept: not-assessed, or assessed with all three words."""
    words = exploitation.isin("none", "poc", "active") & automatable.isin("yes", "no") & impact.isin("partial", "total")
    return F.coalesce((state == "not-assessed") | ((state == "assessed") & words), F.lit(False))
