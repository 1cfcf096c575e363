"""Discovery and fingerprints of delivered files, and their lines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.numbering import number_file_rows


def _path(path: Column | str) -> Column:
    """One spelling for local paths, which Spark's readers report with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _options(pattern: str, recursive: bool, since: dt.datetime | None) -> dict[str, str]:
    recent = {"modifiedAfter": since.strftime("%Y-%m-%dT%H:%M:%S"), "timeZone": "UTC"} if since else {}
    return {"pathGlobFilter": pattern, "recursiveFileLookup": str(recursive).lower(), **recent}


def listed(spark: SparkSession, folder: str, pattern: str, recursive: bool = False, since: dt.datetime | None = None) -> DataFrame:
    """Files of ``folder`` whose name matches the glob: path, name, length, time of arrival; those modified after ``since`` (UTC),
    if given. Contents are not read. Spark lists no empty files."""
    found = (
        spark.read.format("binaryFile").options(**_options(pattern, recursive, since)).load(folder)
        .select(_path("path").alias("file_path"), F.col("length"), F.col("modificationTime").alias("arrived_at"))
    )
    return found.withColumn("file_name", F.element_at(F.split("file_path", "/"), -1))


def discover(spark: SparkSession, folder: str, pattern: str, recursive: bool = False, since: dt.datetime | None = None) -> DataFrame:
    """Files matching the glob with a fingerprint of their content: file_path, file_name, length, arrived_at, file_hash.

    One rule for every size: the file is cut at line feeds, every piece is hashed together with its number, and the
    hashes are added up; the fingerprint is the digest of the sums, their count and the length in bytes. The sums do
    not depend on how the file was split, and Spark forms them with an ordinary aggregate. Other line ends stay part
    of their piece, and a line feed at the end shows in the length, so files that differ in any byte differ here.
    """
    found = listed(spark, folder, pattern, recursive, since)
    numbered = number_file_rows(_placed(spark.read.option("lineSep", "\n").options(**_options(pattern, recursive, since)).text(folder)))
    digest = F.sha2(F.concat_ws(":", F.col("row_num").cast("string"), F.col("value")), 256)

    def part(at: int) -> Column:
        return F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")

    starts = (1, 16, 31, 46)
    sums = numbered.groupBy("file_path").agg(F.count("*").alias("n"), *[F.sum(part(at)).alias(f"p{at}") for at in starts])
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", *[f"p{at}" for at in starts], "length")]
    return found.join(sums, "file_path", "left").select(
        "file_path", "file_name", "length", "arrived_at", F.sha2(F.concat_ws("|", *parts), 256).alias("file_hash")
    )


def lines(spark: SparkSession, paths: Iterable[str], whole: bool = False) -> DataFrame:
    """The lines of text files (or each file as one text) with their place: file_path, file_name, split_start, value."""
    return _placed(spark.read.text(list(paths), wholetext=whole))


def folder_lines(spark: SparkSession, folder: str, pattern: str, since: dt.datetime | None = None) -> DataFrame:
    """The same for the files of ``folder`` that match the glob. Their list stays where it is."""
    return _placed(spark.read.options(**_options(pattern, False, since)).text(folder))


def _placed(text: DataFrame) -> DataFrame:
    return text.select(
        _path("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("split_start"),
        "value",
    )


def require(spark: SparkSession, folder: str, names: Iterable[str]) -> None:
    """Fail, naming what is missing, unless every named input lies in ``folder``."""
    wanted = spark.createDataFrame([(n,) for n in sorted(names)], "file_name string")
    missing = wanted.join(listed(spark, folder, "*").select("file_name"), "file_name", "left_anti")
    absent = sorted(r.file_name for r in missing.collect())
    if absent:
        raise FileNotFoundError(f"Missing required input files: {absent}")
