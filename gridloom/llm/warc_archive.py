"""A content-addressed web archive: payloads once by digest, record headers apart, records by joins.

``write_archive`` makes two tables in a folder. ``payloads`` holds each distinct payload
once under its SHA-256; two payloads of one address with another length or SHA-1 end the
job. ``records`` holds one row per archived page: the exact bytes that stand before its
payload (the WARC header block and the HTTP head) and the payload's address. Of records
with equal payloads of at least ``revisit_bytes`` bytes, that with the largest id is the
response and the others are revisits that refer to it.

``read_archive`` joins the two again. Each record's bytes are its header, its payload
unless it is a revisit, and two line ends; its lengths and its digest are held against
what the header says, and a record whose payload is missing or differs ends the job.

Copies are collapsed within each input task before the shuffle, and of the records only
addresses and headers are sorted, so a payload that a third of all pages share is stored
and moved like any other; the joins may be split where an address is frequent.

Defined results: a null payload is empty; payloads under the limit are all responses; a
null id is below all others; of rows equal in id and payload one is the response; a null
URL gives no target line, and line ends or other control characters in a URL are written
as percent codes; an empty table gives an empty archive; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import free_shuffles, materialize, scratch_folder

REVISIT_BYTES = 1000
#: Fixed values of the record format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"


def urn(*parts: Column) -> Column:
    """A record's name, the same on every run over the same rows."""
    h = F.md5(F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def target(url: Column) -> Column:
    """A URL on one line; a code point below 0x21 or 0x7F becomes its percent code."""
    coded = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"[\x00-\x20\x7F]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
    return F.when(url.rlike(r"[\x00-\x20\x7F]"), F.array_join(coded, "")).otherwise(url)


def _store(rows: DataFrame, path: str) -> None:
    """Each distinct payload once; its plan, and with it the shuffle's files, can go when it is written."""
    seen = F.struct(F.octet_length("__payload").alias("n"), F.sha1("__payload").alias("d"))
    store = rows.withColumn("__seen", seen).groupBy("__address").agg(F.first("__payload").alias("payload"), F.min("__seen").alias("__low"), F.max("__seen").alias("__high"))
    whole = F.when(F.col("__low") == F.col("__high"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads of one SHA-256")).cast("binary"))
    store.select(F.col("__address").alias("address"), whole.alias("payload")).write.option("compression", "zstd").parquet(path)


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES) -> None:
    """Archives each row of ``df`` under ``path``, which driver and executors share."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = df.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"), payload.alias("__payload"))
    rows = rows.withColumn("__address", F.unhex(F.sha2("__payload", 256)))

    sha1, size = F.sha1("__payload"), F.octet_length("__payload")
    index = materialize(rows.select("__id", "__url", "__address", size.cast("long").alias("__n"), sha1.alias("__sha1"), F.monotonically_increasing_id().alias("__at")), "warc-index")
    last = F.max(F.struct(F.col("__id").alias("id"), F.col("__at").alias("at"))).alias("__last")
    _store(rows, f"{path}/payloads")
    shared = index.where(F.col("__n") >= revisit_bytes).groupBy("__address").agg(last, F.count("*").alias("__copies")).where("__copies > 1")
    records = index.join(shared, "__address", "left")
    again = F.col("__last").isNotNull() & (F.col("__last.at") != F.col("__at"))
    own, other = urn(F.col("__id"), F.col("__at"), F.col("__sha1")), urn(F.col("__last.id"), F.col("__last.at"), F.col("__sha1"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("__n").cast("string"), F.lit(END * 2))
    block = F.octet_length(http) + F.when(again, 0).otherwise(F.col("__n"))
    header = F.concat(
        F.lit(VERSION + END), line("WARC-Type", F.when(again, "revisit").otherwise("response")), line("WARC-Record-ID", own), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", target(F.col("__url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("__sha1"))), line("WARC-Profile", F.when(again, PROFILE)), line("WARC-Refers-To", F.when(again, other)), line("X-Source-ID", F.col("__id").cast("string")),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"), line("Content-Length", block.cast("string")), F.lit(END),
    )
    records.select(F.concat(header, http).cast("binary").alias("header"), F.col("__address").alias("address")).write.option("compression", "zstd").parquet(f"{path}/records")
    free_shuffles(df.sparkSession)


def field(head: Column, name: str) -> Column:
    """A header field's value; null where the header has no such line."""
    return F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive, one row each.

    ``source_id`` (text), ``record_id``, ``record_type``, ``url``, ``refers_to`` (the
    response's ``source_id`` for revisits), ``header``, ``payload`` (the full one also of a
    revisit) and ``record``, the record's bytes as a WARC file has them.
    """
    records = spark.read.schema("header binary, address binary").parquet(f"{path}/records")
    payloads = spark.read.schema("address binary, payload binary").parquet(f"{path}/payloads")
    head = F.col("header").cast("string")
    absent = lambda c: F.when(c != "", c)
    names = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "url": "WARC-Target-URI", "source_id": "X-Source-ID", "__refers": "WARC-Refers-To", "__digest": "WARC-Payload-Digest", "__length": "Content-Length"}
    parsed = records.select("header", "address", *[absent(field(head, name)).alias(alias) for alias, name in names.items()])
    first = F.locate(END * 2, head)
    parsed = parsed.withColumn("__http", F.octet_length("header") - F.octet_length(F.left(head, first + 3)))

    # What a revisit refers to is joined while rows are narrow.
    responses = parsed.where("record_type = 'response'").select(F.col("record_id").alias("__refers"), F.col("source_id").alias("refers_to"), F.lit(True).alias("__there"))
    linked = parsed.join(responses, "__refers", "left")
    lost = F.col("__refers").isNotNull() & F.col("__there").isNull()
    linked = linked.withColumn("refers_to", F.when(lost, F.raise_error(F.concat(F.lit("no response "), F.col("__refers"))).cast("string")).otherwise(F.col("refers_to")))

    full = linked.join(payloads, "address", "left")
    in_block = F.when(F.col("record_type") == "revisit", 0).otherwise(F.octet_length("payload"))
    right = (F.concat(F.lit("sha1:"), F.sha1("payload")) == F.col("__digest")) & (F.col("__http") + in_block == F.col("__length").cast("long"))
    full = full.withColumn("payload", F.when(F.coalesce(right, F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("not the payload of "), F.col("record_id"))).cast("binary")))
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return full.select("source_id", "record_id", "record_type", "url", "refers_to", "header", "payload", F.concat("header", body, F.lit((END * 2).encode())).alias("record"))


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark, "warc")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    made = read_archive(spark, path)
    return made.select(F.col("source_id").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = """
SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM (SELECT *, octet_length(encode(body)) >= 1000 AND row_number() OVER (PARTITION BY body ORDER BY page_id DESC NULLS LAST) > 1 AS again,
        max(page_id) OVER (PARTITION BY body) AS last
      FROM (SELECT page_id, coalesce(html, '') AS body FROM pages))
"""
