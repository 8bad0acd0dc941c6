"""Scalar functions as native column expressions. All take and give columns; none reads a clock."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import config as C

_WORD = "A-Za-z0-9_"
#: A boundary of ASCII words; Java's own looks at Unicode.
BOUNDARY = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trim(c: Column | str) -> Column:
    """Without whitespace (of any script) at both ends."""
    return F.btrim(col(c), F.lit(C.SPACES))


#: An entity of HTML, text without an ampersand, or an ampersand that begins no entity.
_PIECE = r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});|[^&]+|&"


def character(point: Column) -> Column:
    """The character of a code point (long), made of its UTF-8 bytes; null for what is none."""

    def bytes_of(mark: int, more: int) -> Column:
        code = F.lit(mark) + F.shiftright(point, 6 * more) * F.lit(1 << 8 * more)
        for k in range(more):
            code = code + F.shiftright(point, 6 * k).bitwiseAND(F.lit(0x3F)) * F.lit(1 << 8 * k)
        return code

    code = F.when(point < 0x80, point).when(point < 0x800, bytes_of(0xC080, 1)).when(point < 0x10000, bytes_of(0xE08080, 2)).otherwise(bytes_of(0xF0808080, 3))
    return F.when(point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF), F.unhex(F.hex(code)).cast("string"))


def decode_entities(c: Column | str) -> Column:
    """HTML entities in one pass; what comes out isn't looked at again, unknown ones stay."""
    names = F.create_map(*(F.lit(x) for pair in C.ENTITIES.items() for x in pair))

    def one(x: Column) -> Column:
        said = F.lower(x.substr(F.lit(2), F.length(x) - 2))
        point = lambda s: F.when(s.startswith("#x"), F.conv(F.substring(s, 3, 6), 16, 10)).otherwise(F.substring(s, 2, 7)).try_cast("long")
        known = let(said, lambda s: F.when(s.startswith("#"), let(point(s), character)).otherwise(F.try_element_at(names, s)))
        return F.when(x.startswith("&") & (F.length(x) > 1), F.coalesce(known, x)).otherwise(x)

    whole = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit(_PIECE), F.lit(0)), one), "")
    return let(col(c), lambda t: F.when(F.contains(t, F.lit("&")), whole(t)).otherwise(t))


def keyword(word: str) -> tuple[str, str, str]:
    """What a keyword's pattern has before, within and after it: whole words, an optional plural ending; `re:` marks a pattern. \\b is for the engine to fit."""
    if word.startswith("re:"):
        return r"\b", f"(?:{word[3:]})", r"\b"
    head = r"\b" if re.match(r"\w", word, re.A) else ""
    tail = r"(?:e?s)?\b" if re.search(r"\w$", word, re.A) else ""
    return head, re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", word), tail


def section_pattern(section: str) -> str:
    """A section's keywords; those of the same kind share their boundary, which is then looked at once for each place of a text."""
    kinds: dict[tuple[str, str], list[str]] = {}
    for head, body, tail in map(keyword, C.KEYWORDS[section]):
        kinds.setdefault((head, tail), []).append(body)
    return "(?i)" + "|".join(f"{head}(?:{'|'.join(bodies)}){tail}" for (head, tail), bodies in kinds.items())


def _alternatives(pattern: str) -> list[str]:
    """The alternatives of a pattern, outside of groups and classes."""
    out, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def java(pattern: str) -> str:
    """The pattern with boundaries of ASCII words, for texts in which it is looked for.

    Alternatives between two boundaries, which begin and end with a character of a word, share them: the one before is then that no such
    character stands before, the one after that none follows, and each is looked at once for a place.
    """
    flag = "(?i)" if pattern.startswith("(?i)") else ""
    whole, rest = [], []
    for x in _alternatives(pattern.removeprefix(flag)):
        if x.startswith(r"\b") and x.endswith(r"\b") and r"\b" not in x[2:-2]:
            whole.append(x[2:-2])
        elif x.startswith(r"\b") and r"\b" not in x[2:]:
            rest.append(f"(?<![{_WORD}])" + x[2:])
        else:
            rest.append(x.replace(r"\b", BOUNDARY))
    if whole:
        rest.insert(0, f"(?<![{_WORD}])(?:{'|'.join(whole)})(?![{_WORD}])")
    return flag + "|".join(rest)


def _first(c: Column, tried: list[tuple[str, str]]) -> Column:
    out = None
    for pattern, said in tried:
        hit = c.rlike(java(pattern))
        out = F.when(hit, said) if out is None else out.when(hit, said)
    return out


def classify(title: Column | str, summary: Column | str) -> Column:
    """The first section with a keyword in the title, else in the summary, else the rest."""
    tried = [(section_pattern(s), s) for s in C.KEYWORDS]
    return F.coalesce(_first(col(title), tried), _first(col(summary), tried), F.lit(C.REST))


def signals(text: Column | str) -> tuple[Column, Column]:
    """The critical and the high signal of a text; null where there is none."""
    return _first(col(text), C.CRITICAL), _first(col(text), C.HIGH)


def importance(critical: Column | str, high: Column | str, section: Column | str, cves: Column | str) -> tuple[Column, Column]:
    """(importance, reason) of an article by its signals; the reason of a normal one is null."""
    critical, high, n = col(critical), col(high), F.size(col(cves))
    breach = col(section) == "Breaches"
    level = F.when(critical.isNotNull(), "critical").when(high.isNotNull() | (n > 0) | breach, "high").otherwise("normal")
    counted = F.when(n == 1, "CVE assigned").when(n > 1, F.concat(n.cast("string"), F.lit(" CVEs"))).when(breach, "Breach")
    return level, F.coalesce(critical, high, counted)


def importance_rank(level: Column | str) -> Column:
    return F.when(col(level) == "critical", 2).when(col(level) == "high", 1).otherwise(0)


def cves(title: Column | str, summary: Column | str) -> Column:
    """Distinct upper-case CVE ids in the order in which they come."""
    found = F.regexp_extract_all(F.concat_ws(" ", col(title), col(summary)), F.lit(r"(?i)(CVE-\d{4}-\d{4,7})(?!\d)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.upper(x)))


def is_cve(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(r"^CVE-\d{4}-\d{4,7}\z"), F.lit(False))


def nvd_url(c: Column | str) -> Column:
    return F.when(is_cve(c), F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), col(c)))


def truncate_summary(c: Column | str) -> Column:
    """At most SUMMARY_CHARS code points: cut at the last whitespace if that isn't too early, closed with an ellipsis."""
    budget = C.SUMMARY_CHARS - 1

    def shorten(cut: Column) -> Column:
        head = F.regexp_extract(cut, f"(?s)^(.*)[{C.SPACE}][^{C.SPACE}]*$", 1)
        return let(head, lambda h: F.when(cut.rlike(f"[{C.SPACE}]") & (F.octet_length(F.encode(h, "UTF-16BE")) / 2 >= int(budget * 0.6)), h).otherwise(cut))

    closed = F.rtrim(F.rtrim(let(F.substring(col(c), 1, budget), shorten), F.lit(C.SPACES)), F.lit(",;:"))
    return F.when(F.length(col(c)) <= C.SUMMARY_CHARS, col(c)).otherwise(F.concat(closed, F.lit("…")))


def title_key(c: Column | str) -> Column:
    """Letters, marks and digits in lower case, with single spaces; for text that is stable under compatibility composition."""
    kept = F.regexp_replace(F.lower(col(c)), f"[^\\p{{L}}\\p{{M}}\\p{{N}}{C.SPACE}]", " ")
    return trim(F.regexp_replace(kept, f"[{C.SPACE}]+", " "))


def url_key(c: Column | str) -> Column:
    """Host, path and the query without tracking fields, sorted by name; for clean ASCII URLs. Others as they are, trimmed."""
    parts = r"^(?i:https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
    name = lambda x: F.lower(F.split(x, "=", 2)[0])

    def key(t: Column) -> Column:
        host = F.regexp_replace(F.lower(F.regexp_extract(t, parts, 1)), r":(?:80|443)$", "")
        path = F.regexp_replace(F.regexp_extract(t, parts, 2), "/+$", "")
        fields = F.filter(F.split(F.regexp_extract(t, parts, 3), "&"), lambda x: (x != "") & ~name(x).startswith("utm_") & ~name(x).isin(C.TRACKING))
        by = F.array_sort(F.transform(fields, lambda x, i: F.struct(F.split(x, "=", 2)[0].alias("n"), i.alias("i"), x.alias("f"))))
        query = F.array_join(F.transform(by, lambda x: F.when(F.contains(x.f, F.lit("=")), x.f).otherwise(F.concat(x.f, F.lit("=")))), "&")
        return F.when(t.rlike(parts), F.concat(host, let(path, lambda p: F.when(p == "", "/").otherwise(p)), let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))).otherwise(t)

    return let(trim(c), key)


def feed_date(c: Column | str) -> Column:
    """A timestamp from an RFC 822 or ISO 8601 date; zones by name; null for what can't be read or is longer than 64."""
    zones = F.create_map(*(F.lit(x) for z in {**C.ZONES, **C.US_ZONES}.items() for x in z))
    tried = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy"]

    def read(t: Column) -> Column:
        offset = F.try_element_at(zones, F.upper(F.regexp_extract(t, r"\s([A-Za-z]{1,5})$", 1)))
        named = let(offset, lambda o: F.when(o.isNotNull(), F.concat(F.regexp_replace(t, r"\s[A-Za-z]{1,5}$", " "), o)).otherwise(t))
        return let(F.regexp_replace(named, r"^[A-Za-z]{3,9},\s*", ""), lambda x: F.when((t != "") & (F.length(t) <= 64), F.coalesce(*(F.try_to_timestamp(x, F.lit(p)) for p in tried), x.try_cast("timestamp"))))

    return let(trim(c), read)


def published(iso: Column | str, pub: Column | str) -> Column:
    """The ISO date, else the feed's own date."""
    return F.coalesce(F.nullif(col(iso), F.lit("")).try_cast("timestamp"), feed_date(pub))


def article_id(url: Column | str) -> Column:
    """12 characters of the URL's hash in the URL-safe alphabet."""
    return F.substring(F.translate(F.base64(F.unhex(F.sha2(col(url), 256))), "+/", "-_"), 1, 12)


def iso(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def score(weight: Column | str, published_ms: Column | str, now_ms: int) -> Column:
    """Tier weight, halved every HALF_LIFE hours of age; the future is as now, an unknown date is 0."""
    age = F.when(col(published_ms).isNotNull(), F.greatest(F.lit(0), F.lit(now_ms) - col(published_ms)) / 3600000.0)
    return F.coalesce(col(weight) * F.pow(F.lit(0.5), age / C.HALF_LIFE), F.lit(0.0))


def relative_time(ms: Column | str, now_ms: int) -> Column:
    minutes = F.floor((F.lit(now_ms) - col(ms)) / 60000)
    return F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))


def utc_time(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(col(ts), "HH:mm 'UTC'"), F.lit("unknown time"))


def utc_date_time(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(col(ts), "yyyy-MM-dd HH:mm 'UTC'"), F.lit("unknown time"))


def utc_short(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(col(ts), "MMM d, HH:mm 'UTC'"), F.lit("unknown time"))


def rfc822(ts: Column | str) -> Column:
    return F.date_format(col(ts), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def escape_xml(c: Column | str) -> Column:
    """Text for XML 1.0: what it can't hold is dropped, its five special characters are written as entities."""
    out = F.regexp_replace(col(c), "[^\\t\\n\\r\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-")


def feed_path(slug_: Column | str, fmt: str) -> Column:
    return F.when(col(slug_) == "all", f"/feed.{fmt}").otherwise(F.concat(F.lit("/feed/"), col(slug_), F.lit(f".{fmt}")))


def real_date(c: Column | str) -> Column:
    """Whether text is a day of the calendar as yyyy-MM-dd."""
    return F.coalesce(col(c).rlike(r"^\d{4}-\d{2}-\d{2}\z") & (F.date_format(F.try_to_date(col(c), "yyyy-MM-dd"), "yyyy-MM-dd") == col(c)) & (col(c) >= "0100"), F.lit(False))


def count_of(c: Column | str) -> Column:
    """A whole number that isn't negative; anything else is 0."""
    v = col(c).cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")), F.floor(v + 0.5)).otherwise(0).cast("long")


def write_units(rcw: Column | str, size: Column | str) -> Column:
    """Units of writes: each write counts once per 8 KiB of its payload."""
    w = col(rcw)
    return F.when(w == 0, 0).otherwise(w * F.greatest(F.lit(1), F.ceil(col(size) / F.nullif(w, F.lit(0)) / C.UNIT_BYTES))).cast("long")


def grouped(c: Column | str) -> Column:
    return F.format_number(F.floor(col(c) + 0.5), 0)


def count_label(n: Column | str) -> Column:
    return F.concat(F.lit(", "), col(n).cast("string"), F.when(col(n) == 1, " article").otherwise(" articles"))


def status_message(selected: Column | str, shown: Column | str) -> Column:
    noun = F.when(col(shown) == 1, "section").otherwise("sections")
    of = F.when(col(selected) == 0, F.concat(F.lit("Showing all "), col(shown).cast("string"))).otherwise(F.concat(F.lit("Showing "), col(selected).cast("string"), F.lit(" of "), col(shown).cast("string")))
    return F.concat_ws(" ", of, noun)
