"""WARC archives: writing pages as records, reading archives, and putting transactions together.

A page gives three records: a request, a response (or a revisit of an equal payload), and
metadata. Request and metadata name the response or revisit in WARC-Concurrent-To. The reader
cuts archives into records by their Content-Length; the assembly joins the records of a capture
through that header and gives one nested row per capture.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, new_path, table

#: Payloads below this many bytes are always written as responses.
REVISIT_FROM = 1000
#: Rows of one archive file; the reader takes a file at a time.
FILE_RECORDS = 1500
#: Tasks that the rows of a common payload are dealt to, at least.
SALTS = 16
CRLF = "\r\n"


def _beside(rows: DataFrame, key: Column, found: DataFrame, name: str, *tells: str) -> DataFrame:
    """rows with the columns of found, which has a row per name, where key equals it; nulls elsewhere.

    Rows are dealt by hash of the columns that tell them apart: those of one key over SALTS copies of
    its row in found, and those without a key, which meet nothing, over all tasks.
    """
    own = F.xxhash64(*tells)
    met = F.coalesce(F.concat(F.lit("="), key), F.concat(F.lit("-"), own.cast("string")))
    left = rows.withColumn("_to", met).withColumn("_salt", F.pmod(own, F.lit(SALTS)))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    right = found.withColumn("_to", F.concat(F.lit("="), F.col(name))).drop(name).withColumn("_salt", salts)
    return left.join(right, ["_to", "_salt"], "left").drop("_to", "_salt")


def with_verdicts(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = REVISIT_FROM) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest, and refers_to: of rows with equal
    payloads of at least `least` bytes, all but one of the largest key refer to that key.

    Equality is by SHA-256 and length. A null payload is empty. Rows with a null key are never
    referred to, and rows that repeat the largest key are all responses.
    """
    rows = pages.select(F.col(key), F.col("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("same", F.when(F.col("payload_bytes") >= least, F.sha2("payload", 256)))
    # counted before the shuffle; only payloads that repeat are joined back
    repeated = rows.where(F.col("same").isNotNull()).groupBy("same").agg(F.max(key).alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "latest")
    joined = _beside(rows, F.col("same"), repeated, "same", key, "url")
    revisit = F.col("latest").isNotNull() & ~F.col("latest").eqNullSafe(F.col(key))
    return joined.select(key, "url", "payload", "payload_bytes", F.sha1("payload").alias("payload_digest"), F.when(revisit, F.col("latest")).alias("refers_to"))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(kind: Column | str, ident: Column, uri: Column, body: Column, mime: str, *headers: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), ident), F.lit("WARC-Date: 2020-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), uri), F.lit(f"Content-Type: {mime}"), *headers, F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    # concat_ws leaves out headers that are null; the text writer ends each record with two line ends
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), body)


def records(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One string per record, from with_verdicts(). A null url becomes "urn:none"; line ends and
    blanks in an url are written as %0D, %0A and %20."""
    raw = F.coalesce(F.col("url"), F.lit("urn:none"))
    uri = F.replace(F.replace(F.replace(raw, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20"))
    place = F.col("_place")
    target = lambda k: F.concat(F.lit("page:"), F.coalesce(k.cast("string"), F.lit("null")))
    ident = _uuid(F.lit("response"), place)
    # the key goes with each record, so that a revisit names its response by it
    name = lambda k: F.concat(F.lit("WARC-X-Page: "), target(k))
    head = F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: ")
    http = F.concat(head, F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("refers_to").isNotNull()
    answer = _record(
        F.when(revisit, "revisit").otherwise("response"), ident, uri, F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))), "application/http; msgtype=response", name(F.col(key)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-X-Refers-To-Page: "), target(F.col("refers_to")))),
    )
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), ident)
    request = _record("request", _uuid(F.lit("request"), place), uri, F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1" + CRLF + CRLF)), "application/http; msgtype=request", concurrent)
    facts = F.concat(F.lit("payloadLength: "), F.col("payload_bytes").cast("string"), F.lit(CRLF))
    metadata = _record("metadata", _uuid(F.lit("metadata"), place), uri, facts, "application/warc-fields", concurrent)
    # the place tells rows apart that are equal; records of a row are made together, in one task
    return pages.withColumn("_place", F.monotonically_increasing_id()).select(F.explode(F.array(request, answer, metadata)).alias("value"))


def write(pages: DataFrame, path: str, key: str = "page_id") -> None:
    """Write archives under path, by Spark's text writer: WARC/1.1, each file one gzip member."""
    records(pages, key).write.option("lineSep", CRLF + CRLF).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


HEADER = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)\r?$", re.M)
RECORD = "type string, id string, uri string, concurrent_to string, page string, refers_to_page string, payload_digest string, payload_bytes long, payload_sha1 string, content binary"


def parse(data: bytes):
    """(headers by lower-case name, content) of each record. What isn't a record is an error."""
    at, size = 0, len(data)
    view = memoryview(data)
    while at < size:
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        headers = {k.decode().lower(): v.decode() for k, v in HEADER.findall(data[at : end + 2])}
        start = end + 4
        stop = start + int(headers["content-length"])
        if stop > size:
            raise ValueError(f"record at byte {at} is cut short")
        yield headers, bytes(view[start:stop])
        at = stop


def payload(headers: dict[str, str], content: bytes) -> tuple[int | None, str | None]:
    """Length and SHA-1 of a response's payload as it was read; nulls for other records. A payload that
    is not as long as its HTTP header says, or not of the record's digest, is an error."""
    if headers.get("warc-type") != "response":
        return None, None
    head, _, body = content.partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", head)
    digest = hashlib.sha1(body).hexdigest()
    if told and int(told[1]) != len(body):
        raise ValueError(f"payload of {headers.get('warc-record-id')} has {len(body)} bytes instead of {int(told[1])}")
    if headers.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
        raise ValueError(f"payload of {headers.get('warc-record-id')} is not of its digest")
    return len(body), digest


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives under path, gzipped or not: RECORD. Absent headers are null.
    payload_bytes and payload_sha1 are measured from the payload of a response; a payload that doesn't
    agree with its headers is an error. An archive without records gives no rows; equal records all stay."""
    names = [("type", "warc-type"), ("id", "warc-record-id"), ("uri", "warc-target-uri"), ("concurrent_to", "warc-concurrent-to"), ("page", "warc-x-page"), ("refers_to_page", "warc-x-refers-to-page"), ("payload_digest", "warc-payload-digest")]

    def run(stream):
        def batch(rows):
            columns = {c: pa.array([h.get(n) for h, _ in rows], pa.string()) for c, n in names}
            measured = [payload(h, b) for h, b in rows]
            columns |= {"payload_bytes": pa.array([n for n, _ in measured], pa.int64()), "payload_sha1": pa.array([d for _, d in measured], pa.string())}
            return pa.RecordBatch.from_pydict(columns | {"content": pa.array([b for _, b in rows], pa.binary())})

        for files in stream:
            for data in files.column(0):
                rows, held = [], 0
                raw = data.as_py()
                for row in parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    rows.append(row)
                    held += len(row[1])
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    bounded(spark)
    return files.mapInArrow(run, RECORD)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row per capture (a response or revisit): id, uri, page, and structs response,
    request and metadata. A capture without a request or metadata has a null there; records that
    name no capture are left out. Nulls in other headers stay null, and no records give no rows."""
    answers = rows.where(F.col("type").isin("response", "revisit"))
    payload = F.when(F.col("type") == "response", F.expr("substring(content, position(X'0D0A0D0A', content) + 4)"))
    answers = answers.select("id", "uri", "page", F.struct("type", "payload_digest", "payload_bytes", "payload_sha1", "refers_to_page", payload.alias("payload")).alias("response"))
    side = lambda kind: rows.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull()).select(F.col("concurrent_to").alias("id"), F.struct(F.col("id").alias("record_id"), F.col("content").cast("string").alias("content")).alias(kind))
    return answers.join(side("request"), "id", "left").join(side("metadata"), "id", "left")


def _page(column: str) -> Column:
    return F.when(F.col(column) != "page:null", F.substring(F.col(column), 6, 40).cast("long"))


def resolved(captures: DataFrame) -> DataFrame:
    """One row per capture of assemble(): page, payload_bytes, payload_digest, record_type, refers_to,
    where a response's length and digest are those of its payload as read. A revisit has those of
    the response that it refers to; if there is none, or its digest or recorded length is another, that is an error."""
    told = F.regexp_extract("metadata.content", r"payloadLength: (\d+)", 1).cast("long")
    rows = captures.select("page", told.alias("told"), "response.type", "response.payload_digest", "response.payload_bytes", "response.payload_sha1", "response.refers_to_page")
    bodies = rows.where("type = 'response'").select(F.col("page").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_sha1").alias("_sha1")).dropDuplicates(["_page"])
    joined = _beside(rows, F.when(F.col("type") == "revisit", F.col("refers_to_page")), bodies, "_page", "page")
    n, digest = F.coalesce("payload_bytes", "_bytes"), F.coalesce("payload_sha1", "_sha1")
    sound = (F.concat(F.lit("sha1:"), digest) == F.col("payload_digest")) & (F.col("told").isNull() | (F.col("told") == n))
    checked = F.when(F.coalesce(sound, F.lit(False)), digest).otherwise(F.raise_error(F.concat(F.lit("no sound payload of "), F.coalesce("page", F.lit("a capture")))))
    return joined.select(_page("page").alias("page"), n.alias("payload_bytes"), checked.alias("payload_digest"), F.col("type").alias("record_type"), _page("refers_to_page").alias("refers_to"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write(with_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    # archives are parsed once: payloads are measured as they are read, and what is left is small
    light = F.when(F.col("type").isin("request", "metadata"), F.col("content")).alias("content")
    records_read = read(spark, path)
    rows = table(records_read.select(*[c for c in records_read.columns if c != "content"], light), "records")
    return resolved(assemble(rows)).withColumnRenamed("page", "page_id")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT html, max(page_id) AS latest FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
SELECT page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN latest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN latest <> page_id THEN latest END AS refers_to
FROM p LEFT JOIN m USING (html)
"""
