"""Content-addressed WARC archive.

An archive is a folder with two Parquet tables:
- ``payloads`` (digest, payload): the bytes of each distinct payload once, addressed by SHA-256;
- ``headers`` (record_id, digest, record_type, header): the exact header block of every record.

A record is header, blank line, block and two line ends. The block of a response is its payload;
a revisit has none and names the response it refers to. ``reconstruct`` joins the tables by
digest, checks every payload against its address, and gives back the exact bytes of the records.
``export_files`` writes them as .warc files, ``read_files`` reads such files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, scratch

#: Records of a run carry one date, so that an archive of the same pages has the same bytes.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads of at least so many bytes are stored once for all records; smaller ones are all responses.
MIN_BYTES = 0
_CRLF = "\r\n"
_LAST = (1 << 63) - 1


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: forty bits, ten hexadecimal digits, make eight characters."""
    def chars(h: Column) -> Column:
        parts = []
        for c in range(4):
            forty = F.conv(F.substring(h, 10 * c + 1, 10), 16, 10).cast("long")
            parts += [F.substring(F.lit(BASE32), F.shiftright(forty, 35 - 5 * j).bitwiseAND(31).cast("int") + 1, F.lit(1)) for j in range(8)]
        return F.concat(*parts)
    return let(F.sha1(payload), chars)


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.coalesce(page_id.cast("string"), F.lit("")))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)], F.lit(">"))


def _header() -> Column:
    """The header block; values in it never hold a line end."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF))
    opt = lambda c: F.coalesce(c, F.lit(""))
    revisit = F.col("record_type") == "revisit"
    uri = F.regexp_replace(F.col("url"), r"[\r\n]", " ")
    return F.concat(
        F.lit("WARC/1.1" + _CRLF), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("page_id"))),
        opt(line("X-Page-ID", F.col("page_id").cast("string"))), opt(line("WARC-Target-URI", uri)), line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("first"))), line("X-Refers-To-Page-ID", F.col("first").cast("string")),
                                 line("X-Payload-Length", F.col("bytes").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write the archive of ``pages`` (page_id, url, html) to ``path``.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads the one with the
    smallest page_id is the response; repeated rows of it are responses too. A null page_id comes
    after all others and is never referred to. A null url has no target line; line ends in a url
    become spaces. No pages give two empty tables.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("order", F.coalesce("page_id", F.lit(_LAST)))
    # only digests of more than one record need a meeting; all others are the response of their payload
    shared = scratch(base.select("digest", "order").groupBy("digest").agg(F.min("order").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-shared")
    facts = base.select("page_id", "order", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    typed = facts.join(shared, "digest", "left").withColumn("record_type", F.when(
        (F.col("order") > F.col("first")) & (F.col("bytes") >= min_bytes), "revisit").otherwise("response"))
    typed.select(_record_id(F.col("page_id")).alias("record_id"), "digest", "record_type", _header().alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    single = base.join(shared, "digest", "left_anti").select("digest", "payload")
    owners = shared.select(F.col("first").alias("order"), "digest")
    once = base.select("order", "digest", "payload").join(owners, ["order", "digest"]).dropDuplicates(["order", "digest"]).select("digest", "payload")
    single.unionByName(once).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload) of an archive; a payload that does not match its address fails the job."""
    rows = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    sound = F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.hex("digest"))).cast("binary"))
    return rows.select("digest", sound.alias("payload"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, digest binary, record binary): the exact bytes of every record of the archive.

    Responses meet their payload by digest; a response without one fails the job.
    """
    headers = spark.read.schema("record_id string, digest binary, record_type string, header string").parquet(f"{path}/headers")
    end, blank = F.lit((_CRLF * 2).encode()), F.lit(_CRLF.encode())
    head = F.encode("header", "UTF-8")
    response = F.col("record_type") == "response"
    found = headers.where(response).join(read_payloads(spark, path), "digest", "left")
    block = F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload for "), "record_id")).cast("binary"))
    return found.select("record_id", "digest", F.concat(head, blank, block, end).alias("record")).unionByName(
        headers.where(~response).select("record_id", "digest", F.concat(head, blank, end).alias("record")))


def _field(head: Column, name: str) -> Column:
    got = F.regexp_extract(head, rf"(?m)^{re.escape(name)}: ([^\r\n]*)\r?$", 1)
    return F.when(got != "", got)


def parse_records(records: DataFrame) -> DataFrame:
    """Fields of records (record binary): page_id, url, record_type, digest line, refers_to, block, and what the payload's length was."""
    # the header holds no blank line, so it ends at the first one; what is behind it is never decoded
    stop = F.locate(_CRLF * 2, F.col("record").cast("string"))
    text = F.substring_index(F.col("record").cast("string"), _CRLF * 2, 1)
    size = F.octet_length(text)
    cut = records.select(F.when(stop > 0, text).alias("head"), "record", size.alias("size"))
    length = _field(F.col("head"), "Content-Length").cast("int")
    block = cut.select("head", F.substring(F.col("record"), F.col("size") + 5, length).alias("block"))
    return block.select(
        _field(F.col("head"), "X-Page-ID").cast("long").alias("page_id"), _field(F.col("head"), "WARC-Target-URI").alias("url"),
        _field(F.col("head"), "WARC-Type").alias("record_type"), _field(F.col("head"), "WARC-Payload-Digest").alias("digest_line"),
        _field(F.col("head"), "X-Refers-To-Page-ID").cast("long").alias("refers_to"), _field(F.col("head"), "X-Payload-Length").cast("long").alias("payload_length"), "block")


def page_records(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archive of ``pages`` to ``path``, read it back, and return one row per record.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to. Length and digest of a
    response are taken from the bytes read back, those of a revisit from its header.
    """
    write_archive(pages, path, min_bytes)
    back = parse_records(reconstruct(pages.sparkSession, path))
    response = F.col("record_type") == "response"
    return back.select(
        "page_id", F.when(response, F.octet_length("block").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("block"))).otherwise(F.substring_index("digest_line", ":", -1)).alias("payload_digest"), "record_type", "refers_to")


def export_files(spark: SparkSession, path: str, out: str, records_per_file: int = 1000) -> None:
    """The archive's records as .warc files: Spark's text writer puts the last line end of each."""
    rows = reconstruct(spark, path).select(F.expr("substring(record, 1, octet_length(record) - 2)").cast("string").alias("value"))
    rows.write.option("lineSep", _CRLF).option("maxRecordsPerFile", records_per_file).text(out)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(record binary) of every .warc file under ``path``; a file is read whole, so files are to be of bounded size."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at, out = content.as_buffer().to_pybytes(), 0, []
                while at < len(data):
                    stop = data.index(b"\r\n\r\n", at) + 4
                    n = int(re.search(rb"(?mi)^Content-Length: *(\d+)", data[at:stop])[1])
                    out.append(data[at:stop + n + 4])
                    at = stop + n + 4
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(split, "record binary")
