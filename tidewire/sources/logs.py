"""Operational logs: records of the platform's tools and the capture's own rows, strictly read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import scalars as S

PREFIX = "budget "
_SAFE = (1 << 53) - 1


def _type(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _text(v: Column, path: str) -> Column:
    return F.when(_type(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _whole(v: Column, path: str) -> Column:
    n = F.when(_type(v, path) == "BIGINT", F.try_variant_get(v, path, "long"))
    return F.when((n >= 0) & (n <= _SAFE), n)


def format_line(p: Column, ok: Column, numbers: dict[str, Column], st: Column) -> Column:
    """One line of a producer's costs; keys in their fixed order, `st` only for ssvc."""
    body = F.concat(F.lit('{"p":"'), p, F.lit('","ok":'), F.when(ok == 1, "1").otherwise("0"), *(x for k in C.BUDGET_KEYS[2:] for x in (F.lit(f',"{k}":'), S.count_of(numbers[k]).cast("string"))))
    state = F.when(st.isin(*C.SSVC_STATES), st).otherwise("failed")
    return F.concat(F.lit(PREFIX), body, F.when(p == "ssvc", F.concat(F.lit(',"st":"'), state, F.lit('"}'))).otherwise("}"))


def parse_line(message: Column) -> Column:
    """The struct of a line that `format_line` writes; null for anything else, be it the order of its keys."""
    want = F.array(*(F.lit(k) for k in C.BUDGET_KEYS))

    def fields_of(v: Column) -> Column:
        return F.struct(_text(v, "$.p").alias("p"), *(_whole(v, f"$.{k}").alias(k) for k in C.BUDGET_KEYS[1:]), _text(v, "$.st").alias("st"))

    def whole(keys: Column, f: Column) -> Column:
        ssvc = f.p == "ssvc"
        shape = F.when(ssvc, (keys == F.array_append(want, F.lit("st"))) & f.st.isin(*C.SSVC_STATES)).otherwise(keys == want)
        fine = shape & f.p.isin(*C.PRODUCERS) & f.ok.isin(0, 1)
        for k in C.BUDGET_KEYS[2:]:
            fine = fine & f.getField(k).isNotNull()
        return F.when(F.coalesce(fine, F.lit(False)), F.struct(f.p.alias("p"), f.ok.cast("int").alias("ok"), *(f.getField(k).alias(k) for k in C.BUDGET_KEYS[2:]), F.when(ssvc, f.st).alias("st")))

    def parsed(text: Column) -> Column:
        body = F.when(text.startswith(PREFIX), F.substr(text, F.lit(len(PREFIX) + 1)))
        return S.let(body, lambda b: S.let(F.try_parse_json(b), lambda v: S.let(fields_of(v), lambda f: whole(F.json_object_keys(b), f))))

    def usual(text: Column) -> Column:
        """A line just as it is written: its values by position."""
        at = lambda k: lambda v: F.get(v, F.lit(k))
        return S.let(F.regexp_extract_all(text, F.lit(r'":"?([a-z0-9-]+)'), F.lit(1)), lambda v: F.struct(at(0)(v).alias("p"), at(1)(v).cast("int").alias("ok"), *(at(k)(v).cast("long").alias(n) for k, n in enumerate(C.BUDGET_KEYS) if k > 1), at(9)(v).alias("st")))

    number = "(?:0|[1-9][0-9]{0,14})"
    fields = ",".join(f'"{k}":{number}' for k in C.BUDGET_KEYS[2:])
    as_written = rf'^{PREFIX}\{{"p":"(?:(?:{"|".join(p for p in C.PRODUCERS if p != "ssvc")})","ok":[01],{fields}|ssvc","ok":[01],{fields},"st":"(?:{"|".join(C.SSVC_STATES)})")\}}\z'
    return S.let(F.rtrim(message, F.lit(C.SPACES)), lambda t: F.when(t.rlike(as_written), usual(t)).otherwise(parsed(t)))


def cut_query(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), "[?]")[0]


def runtime_rows(lines: DataFrame) -> DataFrame:
    """(ts, rid, path, dep, line) of the runtime records among text lines (`value`); only these fields leave a record."""
    v = F.try_parse_json("value")
    rows = lines.withColumn("v", v).where(_text(F.col("v"), "$.type") == "log")
    rows = rows.withColumn("line", parse_line(_text(F.col("v"), "$.data.message"))).withColumn("ts", _text(F.col("v"), "$.data.timestamp"))
    empty = lambda p: F.coalesce(_text(F.col("v"), p), F.lit(""))
    return rows.where("ts is not null and line is not null").select("ts", empty("$.data.requestId").alias("rid"), cut_query(_text(F.col("v"), "$.data.requestPath")).alias("path"), empty("$.data.deploymentId").alias("dep"), "line")


def request_rows(lines: DataFrame) -> DataFrame:
    """(ts, rid, path, route, status, cache, dep) of the request records among text lines."""
    rows = lines.withColumn("v", F.try_parse_json("value")).where(_text(F.col("v"), "$.type") == "request")
    rows = rows.withColumn("ts", _text(F.col("v"), "$.data.timestamp")).withColumn("status", F.when(_type(F.col("v"), "$.data.httpStatus") == "BIGINT", F.try_variant_get("v", "$.data.httpStatus", "int")))
    empty = lambda p: F.coalesce(_text(F.col("v"), p), F.lit(""))
    return rows.where("ts is not null and status is not null").select("ts", empty("$.data.requestId").alias("rid"), cut_query(_text(F.col("v"), "$.data.requestPath")).alias("path"), empty("$.data.route").alias("route"), "status", empty("$.data.cacheResult").alias("cache"), empty("$.data.deploymentId").alias("dep"))


def row_key(k: Column, ts: Column, rid: Column, payload: Column) -> Column:
    """The key by which a row is the same as one read before."""
    return F.sha1(F.concat_ws("|", k, ts, rid, payload))


def summary_rows(lines: DataFrame) -> DataFrame:
    """(has_more, next, excluded) of the summary records among text lines: paging, and excluded stretches (start, end) as text."""
    rows = lines.withColumn("v", F.try_parse_json("value")).where(_text(F.col("v"), "$.type") == "summary")
    more = F.when(_type(F.col("v"), "$.pagination.hasMore") == "BOOLEAN", F.try_variant_get("v", "$.pagination.hasMore", "boolean"))
    spans = F.try_variant_get("v", "$.excludedIntervals", "array<variant>")
    each = F.transform(F.coalesce(spans, F.array().cast("array<variant>")), lambda x: F.struct(_text(x, "$.start").alias("start"), _text(x, "$.end").alias("end")))
    return rows.select(F.coalesce(more, F.lit(False)).alias("has_more"), _text(F.col("v"), "$.pagination.next").alias("next"), each.alias("excluded"))


def _iso(c: Column) -> Column:
    return c.try_cast("timestamp").isNotNull()


def read_rows(lines: DataFrame) -> DataFrame:
    """(k, row, valid) of a capture file's lines (`value`): the kind of row, the line if it is exactly one of the four shapes; blank lines go."""
    v = F.col("v")
    text = lambda k: _text(v, f"$.{k}")
    number = lambda k: F.coalesce(_type(v, f"$.{k}").rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.lit(False))
    all_of = lambda *keys: F.array_size(F.array_compact(F.array(*(text(k) for k in keys)))) == len(keys)
    line = F.concat(F.lit(PREFIX), F.get_json_object("value", "$.line"))
    k = text("k")
    budget = all_of("ts", "rid", "path", "dep") & _iso(text("ts")) & parse_line(line).isNotNull()
    req = all_of("ts", "rid", "path", "route", "cache", "dep") & _iso(text("ts")) & number("status")
    poll = all_of("at", "from", "to", "cli") & _iso(text("at")) & _iso(text("from")) & _iso(text("to")) & (_type(v, "$.ok") == "BOOLEAN") & number("runtime") & number("requests")
    gap = all_of("from", "to", "reason") & _iso(text("from")) & _iso(text("to")) & text("reason").isin(*C.GAP_REASONS)
    rows = lines.where(F.btrim("value", F.lit(C.SPACES)) != "").withColumn("v", F.try_parse_json("value"))
    valid = F.when(k == "budget", budget).when(k == "req", req).when(k == "poll", poll).when(k == "gap", gap)
    return rows.select(k.alias("k"), F.col("value").alias("row"), F.coalesce(valid, F.lit(False)).alias("valid"))
