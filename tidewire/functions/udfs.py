"""The few functions that no built-in expresses, as Arrow-vectorised UDFs."""

from __future__ import annotations

import html
import re
import unicodedata
from decimal import ROUND_HALF_UP, Decimal
from urllib.parse import parse_qsl, quote_plus, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import config as C
from tidewire.functions import scalars as S
from tidewire.functions.scalars import decode_entities  # noqa: F401

def unescaped(text: str | None) -> str | None:
    return None if text is None else html.unescape(text)


def key_of_title(title: str | None) -> str | None:
    """Compatibility-composed, lower case, letters, marks and digits only, single spaces."""
    if title is None:
        return None
    low = unicodedata.normalize("NFKC", title).lower()
    return " ".join("".join(c if unicodedata.category(c)[0] in "LMN" or c in C.SPACES else " " for c in low).split())


def key_of_url(url: str | None) -> str | None:
    """Host, path and sorted query without tracking fields; what isn't a web URL is only trimmed."""
    if url is None:
        return None
    said = url.strip(C.SPACES)
    try:
        u = urlsplit(said)
        host = (u.hostname or "").encode("idna").decode() if not (u.hostname or "").isascii() else (u.hostname or "")
        port = u.port
    except ValueError:
        return said
    if u.scheme not in ("http", "https") or not host or " " in host:
        return said
    if port and port != {"http": 80, "https": 443}[u.scheme]:
        host += f":{port}"
    kept = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in C.TRACKING]
    query = "&".join(f"{quote_plus(k, safe='*-._')}={quote_plus(v, safe='*-._')}" for k, v in sorted(kept, key=lambda x: x[0]))
    steps: list[str] = []
    for part in u.path.split("/")[1:]:
        if part == "..":
            steps = steps[:-1]
        elif part != ".":
            steps.append(part)
    path = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), "/" + "/".join(steps)).rstrip("/") or "/"
    return host + path + (f"?{query}" if query else "")


def two_places(x: float | None) -> str | None:
    """Two decimals of the exact binary value, halves up."""
    return None if x is None or pd.isna(x) else str(Decimal(float(x)).quantize(Decimal("0.01"), ROUND_HALF_UP))


def _vector(f):
    return F.pandas_udf(lambda s: s.map(f, na_action=None).astype(object).where(s.notna(), None), "string")


def _only(rows: Column, value: Column, f, rest: Column) -> Column:
    """f of the rows that need it, in Python; the rest natively: only the others' values travel."""
    return F.when(rows, f(F.when(rows, value))).otherwise(rest)


def unescape(c: Column | str) -> Column:
    """All entities of HTML, of texts with an ampersand."""
    c = S.col(c)
    return _only(F.contains(c, F.lit("&")), c, _vector(unescaped), c)


def title_key(c: Column | str) -> Column:
    """`key_of_title`; ASCII titles are composed as they are, so that the native rule gives the same."""
    c = S.col(c)
    return _only(~c.rlike(r"^\p{ASCII}*$"), c, _vector(key_of_title), S.title_key(c))


#: A URL that the native rule reads as the full rules do: no port, no escapes, no dot segments, a host that ends in a name.
_FIELD = r"[A-Za-z0-9*._-]*(?:=[A-Za-z0-9*._-]*)?"
CLEAN_URL = rf"^https?://(?:[a-z0-9-]+\.)*[a-z][a-z0-9-]*(?:/(?!\.{{1,2}}(?:[/?#]|$))[A-Za-z0-9._~-]*)*(?:\?{_FIELD}(?:&{_FIELD})*)?(?:#[A-Za-z0-9._~=&/-]*)?$"


def url_key(c: Column | str) -> Column:
    """`key_of_url`; clean URLs natively."""
    c = S.col(c)
    return _only(~c.rlike(CLEAN_URL), c, _vector(key_of_url), S.url_key(c))


def fixed2(c):
    return _vector(two_places)(c)
