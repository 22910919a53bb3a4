"""Content-addressed web archive.

Payload bytes are stored once by a strong digest (SHA-256 and length), the exact record headers separately;
records come back by joining the two, and every payload read is checked against its digest.

Defined results: a null payload is an empty one; equal payloads of at least ``min_revisit_bytes`` share one
response, the one with the smallest id, and the others revisit it; repeated rows of one id give repeated records,
of which those with the response's id are all responses; a null id sorts after all others; a null URL gives an empty target URI;
an empty table gives empty archives. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LAST_ID, scratch_path, stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"


def base32_of_sha1(hex40: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hex: 5 hex digits are 20 bits are 4 letters."""
    letters = []
    for g in range(8):
        v = F.conv(F.substring(hex40, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


@dataclass(frozen=True)
class Archive:
    """Two Parquet tables: ``payloads`` (sha256, n_bytes, payload) and ``headers`` (page_id, sha256, n_bytes, has_payload, header)."""

    path: str

    def records(self, spark: SparkSession) -> DataFrame:
        """Columns page_id, header (exact bytes), payload_bytes, payload_sha1 (hex, of the payload read) and record (the bytes of the WARC record).

        A response meets its payload; a revisit, which holds none, meets only the payload's facts, so copies of one page are
        small rows wherever they gather.
        """
        headers = spark.read.parquet(f"{self.path}/headers")
        payloads = spark.read.parquet(f"{self.path}/payloads").withColumnsRenamed({"sha256": "p_sha256", "n_bytes": "p_bytes"})
        whole = F.when((F.sha2("payload", 256) == F.col("p_sha256")) & (F.length("payload") == F.col("p_bytes")), F.col("payload")).otherwise(
            F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("p_sha256")))
        )
        checked = payloads.select("p_sha256", "p_bytes", whole.alias("payload"))
        same = (F.col("sha256") == F.col("p_sha256")) & (F.col("n_bytes") == F.col("p_bytes"))
        end = F.lit((CRLF * 2).encode())
        facts = [F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_sha1")]
        full = headers.filter("has_payload").join(checked, same).select("page_id", "header", *facts, F.concat("header", "payload", end).alias("record"))
        # Stored, so that the adaptive planner may split the revisits of one payload between tasks.
        known = stored(checked.join(headers.filter("NOT has_payload").select("sha256", "n_bytes").distinct(), same, "left_semi").select("p_sha256", "p_bytes", *facts), "payload-facts")
        bare = headers.filter("NOT has_payload").join(known, same).select("page_id", "header", "payload_bytes", "payload_sha1", F.concat("header", end).alias("record"))
        return full.unionByName(bare)

    def write_files(self, spark: SparkSession, path: str) -> None:
        """Write the records as WARC files, by the executors; every record ends in two line ends, which the text writer puts there."""
        body = F.substring("record", F.lit(1), F.length("record") - 4)
        self.records(spark).select(body.cast("string").alias("value")).write.text(path, lineSep=CRLF * 2)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an uncompressed WARC file."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:head_end].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
        start, n = head_end + 4, int(fields["Content-Length"])
        yield fields, data[start : start + n]
        if data[start + n : start + n + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end as its length says")
        at = start + n + 4


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> Archive:
    """Write a record for each row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("sha256"), F.length("payload").cast("long").alias("n_bytes"))
    # One shuffle of one copy of each payload per map task: equal payloads meet in the partial aggregate.
    rows.groupBy("sha256", "n_bytes").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    order = F.coalesce("page_id", F.lit(LAST_ID))
    slim = rows.select("page_id", "url", "sha256", "n_bytes", base32_of_sha1(F.sha1("payload")).alias("sha1"), order.alias("ord"))
    first = slim.groupBy("sha256", "n_bytes").agg(F.min("ord").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    first = stored(first.select(F.col("sha256").alias("f_sha256"), F.col("n_bytes").alias("f_bytes"), "first_id"), "first-pages")  # stored: a hot payload's pages can be split
    met = slim.join(first, (F.col("sha256") == F.col("f_sha256")) & (F.col("n_bytes") == F.col("f_bytes")), "left")
    revisit = F.col("first_id").isNotNull() & (F.col("ord") != F.col("first_id")) & (F.col("n_bytes") >= min_revisit_bytes)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("url", "[\r\n]", ""), F.lit(""))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("first_id"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        F.lit(CRLF),
        http,
    )
    met.select("page_id", "sha256", "n_bytes", (~revisit).alias("has_payload"), header.cast("binary").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    return Archive(path)


def describe(archive: Archive, spark: SparkSession) -> DataFrame:
    """A row for each record read back from the archive, parsed from the record's bytes.

    A response's payload is cut out of its record; a revisit has none, and its digest is held against the payload that it refers to.
    """
    heads = F.substring_index(F.col("record").cast("string"), CRLF * 2, 2)  # the record's header, and that of the response in it
    r = archive.records(spark).withColumn("h", heads)
    of = lambda name: F.regexp_extract("h", rf"\r\n{name}: ([^\r\n]*)", 1)
    block = F.octet_length(F.substring_index("h", CRLF * 2, 1)) + 4
    ends = F.length("record") == block + of("Content-Length").cast("long") + 4
    response = of("WARC-Type") == "response"
    start = F.octet_length("h") + 4
    payload = F.substring("record", (start + 1).cast("int"), (F.length("record") - start - 4).cast("int"))
    sha1, size = F.when(response, F.sha1(payload)).otherwise(F.col("payload_sha1")), F.when(response, F.length(payload)).otherwise(F.col("payload_bytes"))
    told = F.substring(of("WARC-Payload-Digest"), 6, 32)
    whole = F.when(ends & (told == base32_of_sha1(sha1)), told).otherwise(F.raise_error(F.lit("a record does not match its length or digest")))
    return r.select(
        F.regexp_extract("h", r"\r\nWARC-Record-ID: <urn:page:(-?\d*)>", 1).try_cast("long").alias("page_id"),
        size.cast("long").alias("payload_bytes"),
        whole.alias("payload_digest"),
        of("WARC-Type").alias("record_type"),
        F.regexp_extract("h", r"\r\nWARC-Refers-To: <urn:page:(-?\d*)>", 1).try_cast("long").alias("refers_to"),
        F.length("record").cast("long").alias("record_bytes"),
    )


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the archive to the shared folder, read it back and describe its records."""
    spark = pages.sparkSession
    return describe(write_archive(pages, scratch_path(spark, "warc")), spark)
