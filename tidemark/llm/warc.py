"""A content-addressed web archive: payload bytes once by strong digest, exact record headers apart.

An archive is a folder with two tables. ``payloads`` holds each distinct payload once under its SHA-256. ``records``
holds, for every record, the exact header bytes (the WARC header block and the HTTP header) and the address of its
payload. A record is put together again by a join: header bytes, then the payload for a ``response`` (a ``revisit``
carries none and names the response), then the two line ends that close a record. Addresses and header digests are
computed anew from the stored bytes when an archive is read; a mismatch fails the read.

Everything is built-in column functions. Only (address, id) pairs are grouped, with least ids combined on the map
side; payloads are moved once, to keep the winners, keyed by id, so that a payload that fills a third of all rows
does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base-32 alphabet and the texts of the archive format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def base32(sha1_hex: Column) -> Column:
    """A SHA-1 in hex as 32 base-32 characters: each 5 hex digits are 20 bits, 4 characters."""
    parts = []
    for start in range(1, 41, 5):
        bits = F.conv(F.substring(sha1_hex, start, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def _line(name: str, value: Column) -> Column:
    """One header line; nothing for a null. Line ends within a value are percent-encoded, so a value stays one line."""
    value = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", body: str = "html",
                  date: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """Archive all rows of ``pages`` into ``folder``.

    Null bodies are empty payloads. Of rows with equal payloads of at least ``least_bytes`` bytes, that with the
    smallest id is the response (nulls last) and others revisit it; rows that repeat both id and payload repeat the
    response. Smaller payloads are all responses. A null id gives a record without an id, a null url one without a
    target. Other columns are left out. ``date`` goes into the headers, as the rows carry none.
    """
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("address", F.sha2("payload", 256))
    heads = rows.select("page_id", "address", "url", F.octet_length("payload").alias("n"), base32(F.sha1("payload")).alias("digest"))
    order = F.struct(F.col("page_id").isNull(), "page_id", "copies").alias("first")
    first = heads.groupBy("address", "page_id").agg(F.count("*").alias("copies")).groupBy("address").agg(F.min(order).alias("first"))
    first = first.select("address", F.col("first.page_id").alias("first_id"), (F.col("first.copies") > 1).alias("repeated"))
    spark = pages.sparkSession
    first.write.parquet(f"{folder}/firsts")
    first = spark.read.schema(first.schema).parquet(f"{folder}/firsts")

    won = first.withColumnsRenamed({"first_id": "won_id", "address": "won"})
    stored = rows.join(won, (rows.address == won.won) & rows.page_id.eqNullSafe(won.won_id)).select("address", "payload", "repeated")
    once = stored.where("not repeated").unionByName(stored.where("repeated").dropDuplicates(["address"]))
    once.select("address", "payload").write.option("compression", "zstd").parquet(f"{folder}/payloads")

    records = heads.join(first, "address")
    response = (F.col("n") < least_bytes) | F.col("page_id").eqNullSafe(F.col("first_id"))
    kind = F.when(response, "response").otherwise("revisit")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n").cast("string"), F.lit(EOL * 2))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"), _line("WARC-Type", kind), _line("WARC-Record-ID", _name(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Refers-To", F.when(~response, _name(F.col("first_id")))),
        _line("WARC-Profile", F.when(~response, F.lit(IDENTICAL_PAYLOAD))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.when(response, F.col("n")).otherwise(0)).cast("string")),
        F.lit(EOL), http,
    )
    records.select(head.cast("binary").alias("head"), "address").write.option("compression", "zstd").parquet(f"{folder}/records")


def _field(name: str, pattern: str = "([^\r\n]*)") -> Column:
    """A header's value by its name; null without one. Names stand at the start of a line of the first block."""
    found = F.regexp_extract(F.substring_index(F.col("head").cast("string"), EOL * 2, 1), f"\r\n{name}: {pattern}", 1)
    return F.when(found != "", found)


def _checked(value: Column, holds: Column, message: str) -> Column:
    return F.when(holds, value).otherwise(F.raise_error(F.lit(message)))


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """address, payload, n, digest: stored payloads, each verified against its address."""
    stored = spark.read.schema("address string, payload binary").parquet(f"{folder}/payloads")
    payload = _checked(F.col("payload"), F.col("address") == F.sha2("payload", 256), "a stored payload differs from its address")
    return stored.select("address", payload.alias("payload")).select(
        "address", "payload", F.octet_length("payload").alias("n"), base32(F.sha1("payload")).alias("digest"))


def read_records(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """head, address and the parsed page_id, url, record_type, refers_to and header_digest of every record."""
    records = spark.read.schema("head binary, address string").parquet(f"{folder}/records")
    return records.select(
        "head", "address", _field("WARC-Record-ID", "<urn:page:([^\r\n]*)>").cast(id_type).alias("page_id"),
        _field("WARC-Target-URI").alias("url"), _field("WARC-Type").alias("record_type"),
        _field("WARC-Refers-To", "<urn:page:([^\r\n]*)>").cast(id_type).alias("refers_to"),
        _field("WARC-Payload-Digest", "sha1:([A-Z2-7]*)").alias("header_digest"),
    )


def inventory(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """Every record with size and digest of its stored payload; the payload itself is not moved."""
    records = read_records(spark, folder, id_type)
    found = records.join(read_payloads(spark, folder).drop("payload"), "address", "left")
    digest = _checked(F.col("digest"), F.col("digest").eqNullSafe(F.col("header_digest")), "a record's payload is missing or not the one of its header")
    return found.withColumn("digest", digest)


def reconstruct(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """``inventory`` with ``payload`` and ``record``, the record's bytes as an archive file holds them.

    Size and digest are those of the joined payload. A record without a payload, with another one than its header
    names, or with a block that is not as long as its Content-Length says, fails the read of ``n``, ``digest`` or
    ``record``.
    """
    joined = read_records(spark, folder, id_type).join(read_payloads(spark, folder).select("address", "payload"), "address", "left")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    whole = joined.withColumn("record", F.concat("head", body, F.lit(EOL * 2).cast("binary"))).withColumn("digest", base32(F.sha1("payload")))
    # the block begins after the empty line that ends the WARC header and ends before the record's two line ends
    header = F.substring_index(F.col("head").cast("string"), EOL * 2, 1)
    block = F.octet_length("record") - F.octet_length(header) - 2 * len(EOL * 2)
    long = block.cast("long").eqNullSafe(_field("Content-Length", "([0-9]+)").cast("long"))
    right = F.col("digest").eqNullSafe(F.col("header_digest"))
    return whole.select(
        *joined.columns, _checked(F.octet_length("payload"), long, "a record's block is not as long as its Content-Length").alias("n"),
        _checked(F.col("digest"), right, "a record's payload is missing or not the one of its header").alias("digest"),
        _checked(F.col("record"), long, "a record's block is not as long as its Content-Length").alias("record"),
    )
