"""Fill-in-middle: a text is cut at two ranked code points into prefix, middle and suffix, which are put in another order.

The tokenizers library's Split pre-tokenizer, with a regular expression whose matches stay isolated, gives the offsets of the matches; nothing
is trained. An array of one offset for every code point costs about a microsecond and 200 bytes each, so offsets come on two levels: runs
of RUN code points of the whole text, and single code points of the runs that a rank falls in. The arrays' lengths give n, and the offset of
a rank, looked up in its run, gives a slice's end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from tidewire.plans.store import fresh

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are transformed, and of 100 of those so many have the suffix first; what is hashed before an id.
RATE, SUFFIX_FIRST, SEED = 90, 20, "1"
#: Code points of a run, and of a stretch of a long text whose runs are listed at once.
RUN, STRETCH = 64, 1 << 18

_RUNS = pre_tokenizers.Split(Regex(rf"[\s\S]{{1,{RUN}}}"), behavior="isolated")
_POINTS = pre_tokenizers.Split(Regex(r"[\s\S]"), behavior="isolated")


class Offsets:
    """Offsets of the code points of a text, by rank."""

    def __init__(self, text: str):
        self.text = text
        self.runs: list[tuple[int, int]] = []
        for at in range(0, len(text), STRETCH):  # a stretch is whole runs
            self.runs += [(at + a, at + b) for _, (a, b) in _RUNS.pre_tokenize_str(text[at : at + STRETCH])]
        self.n = RUN * (len(self.runs) - 1) + len(self._points(-1)) if self.runs else 0

    def _points(self, run: int) -> list[int]:
        a, b = self.runs[run]
        return [a + x for _, (x, _) in _POINTS.pre_tokenize_str(self.text[a:b])]

    def at(self, rank: int) -> int:
        """Where the code point of a rank begins; the text's end for rank n."""
        return self.runs[-1][1] if rank == self.n else self._points(rank // RUN)[rank % RUN]


def transform(text: str | None, key: str, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of a text; its hashes depend on `seed` and `key` alone."""
    if not text:
        return 0, "plain", None, None, ""
    offsets = Offsets(text)
    n = offsets.n
    hexed = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k : 8 * k + 8], 16) for k in range(4))
    if h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (offsets.at(r) if n else 0 for r in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """Every row of `docs` with n, form (plain, psm, spm), prefix_chars, middle_chars and output, whole.

    A null or empty text is plain, its output the empty text; so is one that contains a sentinel, its output the text. Lengths are code
    points, null where plain. A null key counts as the empty text; equal rows have equal outputs. Columns of `docs` named like an added one
    are replaced, save the key and the text, which the output is made from and which stay.
    """
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    if clash := {key, text} & set(names):
        raise ValueError(f"rename {sorted(clash)}: the operator adds columns of these names")
    own = docs.drop(*names)
    (said,) = fresh(own, "key_text")
    schema = T.StructType([*own.schema.fields, *(T.StructField(c, T.StringType() if c in ("form", "output") else T.LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            keys, texts = rb.column(rb.num_columns - 1), rb.column(rb.schema.get_field_index(text))
            done, size, first = [], 0, 0
            for i in range(rb.num_rows):
                done.append(transform(texts[i].as_py(), keys[i].as_py(), rate, suffix_first, seed))
                size += len(done[-1][4])
                if size > 4 << 20 or i == rb.num_rows - 1:  # outputs of a batch are held a few MB at a time
                    added = [pa.array([d[k] for d in done], pa.string() if k in (1, 4) else pa.int64()) for k in range(5)]
                    yield pa.RecordBatch.from_arrays([*rb.slice(first, i + 1 - first).columns[:-1], *added], names=schema.names)
                    done, size, first = [], 0, i + 1

    return own.withColumn(said, F.coalesce(F.col(key).cast("string"), F.lit(""))).mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts stand between sentinels, none of which the text has."""
    after = lambda c, mark: F.substring_index(c, mark, -1)
    before = lambda c, mark: F.substring_index(c, mark, 1)
    middle = after(output, MIDDLE)
    head = before(output, MIDDLE)
    psm = F.concat(before(after(head, PREFIX), SUFFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, before(after(head, SUFFIX), PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sha = lambda c: F.sha2(c, 256)
    out = transformed(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}:' || doc_id) AS h FROM documents),
k AS (SELECT doc_id, t, n, list_transform([1, 9, 17, 25], lambda p: ('0x' || substr(h, p, 8))::BIGINT) AS h FROM d),
c AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h[3] % 100 >= {RATE} THEN 'plain' WHEN h[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""
