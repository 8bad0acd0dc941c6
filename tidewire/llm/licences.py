"""License scans with a positional rare-token index; DataFrame functions only.

The words of all templates are weighted by their inverse document frequency over the files, and the index holds of each template's
key phrase the rarest of them with their places. A file's words are looked up in it; a template of which the file has all rare
words is nominated, its postings are intersected by relative position, and what is left is verified: the key phrase word by word, and
the share of the template's weight that stands where it should. A file is one row from first to last, so nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Phrases of the base and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, template (a notice as it stands in files) and key phrase, in words of digits and lower-case letters.
TEMPLATES = [
    ("agpl-3.0", "this program is free software licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("artistic-2.0", "licensed under the artistic license 2 0", "artistic license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any person"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("wtfpl", "do what the fuck you want to public license", "do what the fuck you want to public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
    ("agpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general public license as published by the free software foundation"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", "copy of the software and accompanying documentation covered by this license"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "gnu lesser general public license as published by the free software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", "to deal in the software without restriction including without limitation the rights"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "a copy of the mpl was not distributed with this file"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", "including commercial applications and to alter it and redistribute it freely"),
]
#: Share of a template's weight that an alignment needs; rare words of each key phrase that are looked up.
ENOUGH, RARE = 0.6, 3

_SEP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The Kelvin sign, the one other character whose lower case is a letter of a-z.
_KELVIN = "K"


def _entries(templates: list[tuple[str, str, str]]) -> list[tuple[str, list[str], list[str], int]]:
    """Label, words, words of the key phrase and where it starts, of the base phrases first and then of the templates."""
    out = []
    for label, said, phrase in [(label, p, p) for p, label in BASE.items()] + templates:
        ws, key = said.split(), phrase.split()
        out.append((label, ws, key, next(i for i in range(len(ws)) if ws[i : i + len(key)] == key)))
    return out


def _words(text: Column) -> Column:
    """Words with A-Z in lower case; letters beyond a-z may change too, which no template has."""
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(_KELVIN), F.lit("ĸ"))), f"{_SEP}+", -1), "")


def _strings(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.expr("cast(array() as array<string>)")


def frequencies(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, text: str = "text") -> tuple[int, dict[str, int]]:
    """The number of files, and of those that have each word of the templates: as many numbers as the templates have words."""
    vocabulary = sorted({w for _, ws, _, _ in _entries(templates) for w in ws})
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(_words(F.col(text)), _strings(vocabulary)))).alias("w")).groupBy("w").count().collect()
    count = {r["w"]: r["count"] for r in found}
    return count.pop("", 0), count


@dataclass(frozen=True)
class Posting:
    """A template as it is looked up: its rare words, rarest first, with their places; its key phrase and words with their weights."""

    label: str
    base: bool
    rare: list[tuple[str, int]]
    key: list[str]
    key_at: int
    words: list[str]
    weights: list[float]


def index(n: int, df: dict[str, int], templates: list[tuple[str, str, str]] = TEMPLATES, rare: int = RARE) -> list[Posting]:
    """The postings of all templates, weighted by the frequencies of their words among n files."""
    idf = lambda w: math.log(1 + n / (1 + df.get(w, 0)))
    out = []
    for k, (label, ws, key, at) in enumerate(_entries(templates)):
        total = sum(idf(w) for w in ws) or 1.0
        rarest = sorted(set(key), key=lambda w: (-idf(w), w))[:rare]
        out.append(Posting(label, k < len(BASE), [(w, at + key.index(w)) for w in rarest], key, at, ws, [idf(w) / total for w in ws]))
    return out


def _stands(word: str, place: int) -> Callable[[Column], Column]:
    """Whether the word stands so many places after the one asked for."""
    return lambda i: F.get("_words", (i + place).cast("int")) == word


def _starts(p: Posting) -> Column:
    """Places in `_words` where the template would start: postings of its rare words, intersected, and the key phrase verified there."""
    (pivot, at), *others = p.rare
    found = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), _stands(pivot, 0))
    starts = F.transform(found, lambda i: i - at)
    for w, place in others:
        starts = F.filter(starts, _stands(w, place))
    return F.filter(starts, lambda s: F.when(s + p.key_at >= 0, F.slice("_words", s + p.key_at + 1, len(p.key)) == _strings(p.key)).otherwise(False))


def _share(p: Posting, starts: str) -> Column:
    """The best share of the template's weight that stands where it should, of the column `starts`."""
    held = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(x).alias("x")) for w, x in zip(p.words, p.weights, strict=True)))
    return F.array_max(F.transform(starts, lambda s: F.aggregate(F.transform(held, lambda h, j: F.when(F.get("_words", (s + j).cast("int")) == h.w, h.x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row.

    Null and empty texts have no words, labels or score (0). A base phrase alone scores 1, a template the share of its weight that
    stands where it should. Repeated rows each get their result, and count each in the frequencies. Other columns are not looked at.
    """
    postings = index(*frequencies(docs, templates, text), templates)
    rows = docs.select(F.col(key).alias("_key"), _words(F.col(text)).alias("_words"))
    every = sorted({w for p in postings for w, _ in p.rare})
    rows = rows.select("_key", F.size("_words").cast("long").alias("n_words"), "_words", F.array_intersect("_words", _strings(every)).alias("_rare"))
    rows = rows.withColumn("_words", F.when(F.size("_rare") > 0, F.col("_words")))  # the words of other files aren't needed any more
    none, base, more = F.expr("cast(array() as array<int>)"), [], []
    for k, p in enumerate(postings):
        named = F.size(F.array_except(_strings([w for w, _ in p.rare]), F.col("_rare"))) == 0
        rows = rows.withColumn(f"_s{k}", F.when(named, _starts(p)).otherwise(none))
        (base if p.base else more).append((k, p))
    score = [F.when(F.size(f"_s{k}") > 0, F.round(_share(p, f"_s{k}"), 9)) for k, p in more]
    rows = rows.withColumns({f"_x{k}": x for (k, _), x in zip(more, score, strict=True)})
    labels = F.array_compact(F.array(*(F.when(F.size(f"_s{k}") > 0, F.lit(p.label)) for k, p in base)))
    told = F.array_compact(F.array(*(F.when(F.col(f"_x{k}") >= ENOUGH, F.lit(p.label)) for k, p in more)))
    best = F.greatest(*(F.when(F.col(f"_x{k}") >= ENOUGH, F.col(f"_x{k}")) for k, _ in more)) if len(more) > 1 else F.when(F.col(f"_x{more[0][0]}") >= ENOUGH, F.col(f"_x{more[0][0]}"))
    rows = rows.select("_key", "n_words", F.concat(*(F.col(f"_s{k}") for k, _ in base)).alias("_at"), F.array_sort(F.array_distinct(labels)).alias("_base"), told.alias("_told"), best.alias("_best"))
    return rows.select(
        F.col("_key").alias(key), "n_words", F.size("_at").cast("long").alias("n_base"), F.array_min("_at").cast("long").alias("first_word"), F.array_max("_at").cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("_base", "_told")), ",").alias("labels"),
        F.when(F.size("_at") > 0, 1.0).otherwise(F.when(F.col("_best").isNotNull(), F.least(F.lit(1.0), F.col("_best"))).otherwise(0.0)).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _oracle() -> str:
    """Votes of all words of a text for all alignments; a base phrase by the words that follow one another."""
    entries = _entries(TEMPLATES)[len(BASE) :]
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    rows = ", ".join(f"('{w}', {t}, {p}, {int(at <= p < at + len(key))}, {len(key)}, '{label}')" for t, (label, ws, key, at) in enumerate(entries) for p, w in enumerate(ws))
    base_ = " UNION ALL ".join("SELECT doc_id, i, '" + label + "' AS label FROM pos WHERE " + " AND ".join(f"ws[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in BASE.items())
    return f"""
WITH d AS (SELECT doc_id, {words} AS ws FROM documents), pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
b AS ({base_}), bb AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS a, max(i) - 1 AS z, list_sort(list(DISTINCT label)) AS labels FROM b GROUP BY doc_id),
x0(w, t, p, m, n, label) AS (VALUES {rows}),
df AS (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(ws)) AS w FROM d) GROUP BY w),
x1 AS (SELECT x0.*, ln(1 + (SELECT count(*) FROM d) / (1.0 + coalesce(df, 0))) AS idf FROM x0 LEFT JOIN df USING (w)),
x AS (SELECT *, idf / sum(idf) OVER (PARTITION BY t) AS v FROM x1),
al AS (SELECT doc_id, t, any_value(label) AS label, sum(v) AS score FROM (SELECT DISTINCT doc_id, t, i - p AS s, p, v, m, n, label FROM pos JOIN x ON x.w = ws[i]) GROUP BY doc_id, t, s HAVING sum(m) = any_value(n) AND round(sum(v), 9) >= {ENOUGH}),
ll AS (SELECT doc_id, list(DISTINCT label) AS labels, max(score) AS score FROM al GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, a AS first_word, z AS last_word, coalesce(array_to_string(bb.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bb.labels, []), coalesce(ll.labels, [])))), ',') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 WHEN score IS NULL THEN 0 ELSE least(1.0, round(score, 9)) END AS DOUBLE) AS score
FROM d LEFT JOIN bb USING (doc_id) LEFT JOIN ll USING (doc_id)
"""


ORACLE_SQL = _oracle()
