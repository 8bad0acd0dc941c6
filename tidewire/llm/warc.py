"""WARC archives: whole-file gzip streams are rewritten with a member for each record and a sidecar offset index.

Archives as crawlers and text writers leave them are often one gzip stream (monolithic): a record can't be read
without all before it. The normaliser inflates a file once, as a stream, writes each record as its own member, and
beside it an index of (offset, length) by which any record is read alone.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans.store import new_path, save

#: Bytes from which equal payloads are stored once; records of one archive at most; deflate level of members.
REVISIT_BYTES, RECORDS, LEVEL = 1000, 20_000, 6
#: Fixed values of the format.
VERSION, END = "WARC/1.1", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisits(pages: DataFrame, key: str = "page_id", body: str = "html") -> DataFrame:
    """(id, digest, refers_to) of the rows whose payload, of REVISIT_BYTES or more, comes with a larger id too."""
    big = pages.where(F.octet_length(body) >= REVISIT_BYTES).select(F.col(key).alias("id"), F.unhex(F.sha1(F.col(body))).alias("digest"))
    many = big.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return big.join(many, "digest").where("id < refers_to or (id is null and refers_to is not null)").select("id", "digest", "refers_to").distinct()


def records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """One WARC record of each row as text (column `value`): response, or revisit without a payload.

    A null payload is empty. Rows of one id and one payload are the same record and all of one type.
    """
    seen = save(revisits(pages, key, body), "revisits")
    rows = pages.select(F.col(key).alias("id"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "[\\r\\n]+", " ").alias("url"), F.coalesce(F.col(body), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    seen = seen.select(F.coalesce("id", F.lit(-(1 << 63))).alias("k"), F.lower(F.hex("digest")).alias("d"), "refers_to")
    rows = rows.withColumn("k", F.coalesce("id", F.lit(-(1 << 63))))
    rows = rows.join(seen, (rows["k"] == seen["k"]) & (rows["sha"] == seen["d"]), "left")
    again = F.col("refers_to").isNotNull()
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    lines = [
        F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")), F.lit("WARC-Date: 2026-01-01T00:00:00Z"), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha")),
        F.concat(F.lit("X-Payload-Length: "), F.octet_length("payload").cast("string")),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.when(again, "0").otherwise(F.octet_length("payload").cast("string"))),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), F.when(again, "").otherwise(F.col("payload"))).alias("value"))


def write(pages: DataFrame, path: str, per_file: int = RECORDS, **names) -> None:
    """Write archives of at most `per_file` records, each a single gzip stream, with Spark's own writer (any file system, safe against retries)."""
    records(pages, **names).write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", per_file).text(path)


def _open(uri: str):
    """File system and path of a URI as Spark writes it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or several, each byte inflated once."""
    z, fresh = zlib.decompressobj(31), True
    for chunk in chunks:
        while chunk:
            fresh = False
            if out := z.decompress(chunk, 1 << 20):
                yield out
            if z.eof:
                chunk, z, fresh = z.unused_data, zlib.decompressobj(31), True
            else:
                chunk = z.unconsumed_tail
    if not fresh:
        if out := z.flush():
            yield out
        if not z.eof:
            raise ValueError("the archive ends within a gzip member")


def split(stream: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, payload and whole bytes of each record; a record is held alone in memory."""
    buf = bytearray()
    more = iter(stream)

    def need(n: int) -> bool:
        while len(buf) < n:
            piece = next(more, None)
            if piece is None:
                return False
            buf.extend(piece)
        return True

    while need(1):
        at = buf.find(b"\r\n\r\n")
        while at < 0:
            have = len(buf)
            if not need(have + 1):
                raise ValueError("the archive ends within a record's header")
            at = buf.find(b"\r\n\r\n", max(0, have - 3))
        head = parse(bytes(buf[:at]))
        size = at + 4 + int(head["content-length"])
        if not need(size + 4):
            raise ValueError("the archive ends within a record")
        yield head, bytes(buf[at + 4 : size]), bytes(buf[: size + 4])
        del buf[: size + 4]


def parse(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _chunks(stream, size: int = 1 << 20) -> Iterator[bytes]:
    while piece := stream.read(size):
        yield piece


def archive_name(uri: Column) -> Column:
    """The name of the archive that a file becomes: that of the file, and a hash of its whole URI, for folders may hold files of one name."""
    stem = F.regexp_replace(F.regexp_extract(uri, "([^/]*)$", 1), "(\\.warc)?\\.gz$", "")
    return F.concat(stem, F.lit("-"), F.substring(F.sha1(uri), 1, 16))


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite each archive below `source` into `target`: (archive, index, n_records, n_bytes) of each, written once and kept.

    A file is a task: inflated as a stream, and written under a name of its own that is moved to the last one when it is
    whole, so a lost or repeated task leaves no half archive. Folders are read with all below them; the target's names are those of
    `archive_name`, and two files of one name are an error. The index beside it has a JSON line for each record.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(source).select("path")
    files = save(found.select("path", archive_name(F.col("path")).alias("name")), "files")
    n = files.count()
    if files.select("name").distinct().count() < n:
        raise ValueError("two archives would have one name")
    n = max(1, min(n, 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for uri, name in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                from_fs, path = _open(uri)
                to_fs, base = _open(target)
                to_fs.create_dir(base, recursive=True)
                archive, index, mine = f"{base}/{name}.warc.gz", f"{base}/{name}.idx", f"{base}/_{name}-{uuid.uuid4().hex}"
                at = count = 0
                with from_fs.open_input_stream(path, compression=None) as src, to_fs.open_output_stream(mine + ".gz", compression=None) as out, to_fs.open_output_stream(mine + ".idx", compression=None) as idx:
                    for head, _, whole in split(inflated(_chunks(src))):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(whole) + z.flush()
                        out.write(member)
                        idx.write((json.dumps({"id": head["warc-record-id"], "type": head["warc-type"], "offset": at, "length": len(member)}) + "\n").encode())
                        at += len(member)
                        count += 1
                to_fs.move(mine + ".gz", archive)
                to_fs.move(mine + ".idx", index)
                yield pa.RecordBatch.from_arrays([pa.array([f"{target}/{name}.warc.gz"]), pa.array([f"{target}/{name}.idx"]), pa.array([count]), pa.array([at])], names=["archive", "index", "n_records", "n_bytes"])

    return save(files.repartition(n).mapInArrow(run, "archive string, index string, n_records long, n_bytes long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of the records of normalised archives, each read by its offset.

    Digests of responses are computed from what is read and held against the header; revisits have those of their header.
    """
    n = max(1, min(archives.count(), 100_000))

    def number(urn: str | None) -> int | None:
        said = (urn or "").strip("<>").rpartition(":")[2]
        return int(said) if said else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for archive, index in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                where, path = _open(archive)
                out: list[tuple] = []
                with where.open_input_stream(_open(index)[1], compression=None) as f:
                    entries = [json.loads(x) for x in f.read().splitlines()]
                with where.open_input_file(path) as f:
                    for e in entries:
                        f.seek(e["offset"])
                        head, payload, _ = next(split(iter([zlib.decompress(f.read(e["length"]), 31)])))
                        digest, size = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                        if e["type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"{archive}: the payload at {e['offset']} isn't that of its header")
                        out.append((number(head["warc-record-id"]), size, digest, e["type"], number(head.get("warc-refers-to")), head["warc-target-uri"]))
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return archives.select("archive", "index").repartition(n).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    raw, whole = new_path(spark, "warc-raw"), new_path(spark, "warc")
    write(pages, raw)
    return read(normalise(spark, raw, whole)).drop("url")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to FROM p LEFT JOIN m USING (d)
"""
