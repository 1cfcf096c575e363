"""Vendor feed: CSV files, each with its own header line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.keyed import lookup_join
from ..operators.numbering import number_file_rows
from ..schemas import SNAPSHOT_FIELDS
from ..session import written
from .files import lines

# Expected fields, approved alias.
EXPECTED = SNAPSHOT_FIELDS["client_deposit"]
ALIASES = {"method": "payment_method"}


class SchemaDrift(ValueError):
    """A header that is not the expected one, up to order and approved aliases."""


def check_header(file_name: str, header: list[str]) -> tuple[list[str], list[str]]:
    """The header under the expected names, and a warning for every alias used."""
    renamed = [ALIASES.get(f, f) for f in header]
    missing = sorted(set(EXPECTED) - set(renamed))
    unexpected = sorted(set(renamed) - set(EXPECTED))
    unexpected += sorted({f for f in renamed if renamed.count(f) > 1})  # an alias beside its target
    if missing or unexpected:
        raise SchemaDrift(f"Unapproved schema drift in {file_name}: missing={missing}, unexpected={unexpected}")
    used = [f for f in header if f in ALIASES]
    return renamed, [f"Approved schema alias '{f}' normalized to '{ALIASES[f]}' in {file_name}" for f in used]


def drift_report(headers: DataFrame) -> DataFrame:
    """Missing and unexpected fields per header, as data: file_name and header (array of names)."""
    expected = F.array(*[F.lit(f) for f in EXPECTED])
    renamed = F.col("header")
    for alias, name in ALIASES.items():
        renamed = F.when(
            F.array_contains("header", alias) & ~F.array_contains("header", name),
            F.transform(renamed, lambda f: F.when(f == alias, F.lit(name)).otherwise(f)),
        ).otherwise(renamed)
    report = headers.withColumn("renamed", renamed).select(
        "file_name",
        F.array_join(F.array_sort(F.array_except(expected, "renamed")), ",").alias("missing"),
        F.array_join(F.array_sort(F.array_except("renamed", expected)), ",").alias("unexpected"),
        F.array_contains("header", "method").alias("alias_used"),
    )
    return report.withColumn("approved", (F.col("missing") == "") & (F.col("unexpected") == ""))


#: A record: anything up to a line end outside quotes.
_RECORD = r'(?:[^"\r\n]++|"(?:[^"]++|"")*+"?+)++'
#: A cell and the comma behind it: quoted, with quotes inside doubled, or anything without a comma.
_CELL = r'("(?:[^"]|"")*+"|[^,]*+),'


def cells_of(record: Column | str) -> Column:
    """The cells of a CSV record. A quoted cell gives its content; an empty one without quotes is null."""
    raw = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(_CELL), F.lit(1))
    quoted = lambda c: F.length(c).__ge__(2) & c.startswith('"') & c.endswith('"')
    inner = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(raw, lambda c: F.when(quoted(c), inner(c)).when(c != "", c))


def headers_of(first_lines: DataFrame) -> DataFrame:
    """One row per file: file_path, file_name, delivered and expected names, and the place of each expected field."""
    delivered = F.transform(cells_of("value"), lambda c: F.coalesce(c, F.lit("")))
    renamed = lambda name: F.coalesce(*[F.when(name == old, F.lit(new)) for old, new in ALIASES.items()], name)
    named = first_lines.select("file_path", "file_name", delivered.alias("delivered")).withColumn("names", F.transform("delivered", renamed))
    return named.withColumns({f"at_{f}": (F.array_position("names", F.lit(f)) - 1).cast("int") for f in EXPECTED})


def refuse_drift(headers: DataFrame, shown: int = 20) -> None:
    """Fail if a header is not the expected one, naming the first files and how many there are. Decided where the headers are."""
    expected = F.array(*[F.lit(f) for f in EXPECTED])
    twice = F.filter(F.array_distinct("names"), lambda name: F.size(F.filter("names", lambda n: n == name)) > 1)  # an alias beside its target
    judged = headers.select(
        "file_name", F.array_sort(F.array_except(expected, "names")).alias("missing"),
        F.concat(F.array_sort(F.array_except("names", expected)), F.array_sort(twice)).alias("unexpected"),
    ).where((F.size("missing") > 0) | (F.size("unexpected") > 0))
    found = judged.orderBy("file_name").limit(shown).collect()
    if found:
        listed = "; ".join(f"{r.file_name}: missing={r.missing}, unexpected={r.unexpected}" for r in found)
        more = judged.count() - len(found) if len(found) == shown else 0
        raise SchemaDrift(f"Unapproved schema drift in {listed}" + (f" and {more} more files" if more else ""))


def alias_warnings(headers: DataFrame) -> DataFrame:
    """A row (file_name, warning) for every approved alias that a file uses."""
    used = headers.select("file_name", F.explode("delivered").alias("alias")).where(F.col("alias").isin(*ALIASES))
    name = F.coalesce(*[F.when(F.col("alias") == old, F.lit(new)) for old, new in ALIASES.items()])
    return used.select("file_name", F.format_string("Approved schema alias '%s' normalized to '%s' in %s", "alias", name, "file_name").alias("warning"))


def read_vendor(
    spark: SparkSession, paths: list[str] | DataFrame, multiline: bool = False, chosen: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of the files as text columns with raw_payload, file_path, file_name and row_num, and the warnings about aliases.

    ``paths``: files or folders, or their lines as ``files.folder_lines`` gives them; ``chosen`` names the files that count, by
    ``file_path``. All files are scanned together, and their lines are numbered and written once. Headers stay on the executors: each file's header becomes an array of names and the
    places of the expected fields, the files' rows are joined to them, and cells are taken by place. So neither plan nor
    driver knows how many files or layouts there are; drift is decided by an aggregate, of which the first few cases are shown. A
    missing trailing cell is null. ``raw_payload`` has the cells under the names of the delivered header; where their
    number is not the header's, also the whole record, as ``_record``.

    With ``multiline`` a quoted cell may hold line ends; a file is then read by one task.
    """
    if isinstance(paths, DataFrame):
        text = paths
    elif not paths:
        raise ValueError("no vendor files given")
    else:
        text = lines(spark, paths, whole=multiline)
    if multiline:
        text = text.withColumn("value", F.explode(F.regexp_extract_all("value", F.lit(_RECORD), F.lit(0))))
    numbered = number_file_rows(text.where("trim(value) <> ''"), "line_num")
    if chosen is not None:
        numbered = lookup_join(numbered, chosen.select("file_path"), ["file_path"], "left_semi")
    numbered = written(numbered, "vendor-lines")
    headers = written(headers_of(numbered.where("line_num = 1")), "vendor-headers")
    refuse_drift(headers)
    body = lookup_join(numbered.where("line_num > 1"), headers.drop("file_name"), ["file_path"], "inner")
    body = body.withColumn("cells", cells_of("value"))
    width = F.size("delivered")
    padded = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.get("cells", i))
    own = F.map_from_arrays("delivered", padded)
    whole = F.map_concat(own, F.create_map(F.lit("_record"), "value"))
    payload = F.to_json(F.when(F.size("cells") == width, own).otherwise(whole), {"ignoreNullFields": "false"})
    rows = body.select(
        *[F.get("cells", F.col(f"at_{f}")).alias(f) for f in EXPECTED], payload.alias("raw_payload"),
        "file_path", "file_name", (F.col("line_num") - 1).alias("row_num"),
    )
    return rows, alias_warnings(headers)
