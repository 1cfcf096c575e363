"""Published tables: Parquet folders, and a list of publications that says which of them count.

A batch writes its rows to folders nobody reads yet. Its last write adds one row to ``publications``; with
that row data and control state appear together. A batch that fails before it has changed nothing, and can
be run again. Publications are numbered; of two batches that began from the same one, the second to publish
finds its number taken and fails.

A table is a list of parts. Facts, raw rows and control rows are appended, so a batch writes what it brought
and not the whole table. The tables in ``schemas.BUCKETED`` are cut by a hash of their client (or other key) into
a fixed number of buckets, and each of their parts holds rows of one bucket. What has to be rewritten, a version that
ends or history that is rebuilt, is put in place bucket by bucket: the cost of a batch follows the clients it touches,
and never the size of the dimension.

Rows and top keys are counted by the writes themselves, and travel with the publication.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..operators.dims import top_key
from ..schemas import BUCKETED, CLUSTERING, COUNTERS, PERIODS, TABLES, conform, empty, period_of

#: Buckets of a new warehouse; they bound the number of folders that a batch writes and the list of live parts.
BUCKETS = 32
#: Tasks, and so files, of a bucket at most, where its rows are not sorted.
SPREAD = 8
_BUCKET, _PART = "bucket", "part="
_PUBLICATION = (
    "seq long, batch_id string, changes array<struct<table_name:string,part:string,bucket:int,replaces:boolean>>, "
    "counters map<string,long>, published_at timestamp"
)


class Overtaken(RuntimeError):
    """Another batch has published since this one began."""


class Part(NamedTuple):
    """A folder of rows below its table's folder, and the bucket they belong to, if any."""

    path: str
    bucket: int | None = None


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.hash(key), F.lit(buckets))


class Warehouse:
    """The published tables under one folder. ``buckets`` counts for a new warehouse only; it never changes later."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self._buckets = spark, root.rstrip("/"), buckets

    def _publications(self) -> DataFrame:
        try:
            return self.spark.read.schema(_PUBLICATION).option("recursiveFileLookup", True).parquet(f"{self.root}/publications")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _PUBLICATION)  # nothing published yet

    def latest(self) -> tuple[int, dict[str, list[Part]], dict[str, int]]:
        """Number of the publication in force, the parts of every table and the counters; (0, {}, {}) before the first one.

        A publication lists only what it changed. The parts of a table, or of a bucket, are those since it was last replaced.
        """
        published = self._publications()
        last = published.agg(F.max("seq").alias("seq"), F.max_by("counters", "seq").alias("counters")).first()
        changes = published.select("seq", F.posexplode("changes").alias("pos", "c")).select("seq", "pos", "c.*")
        named = changes.groupBy("table_name", "bucket").agg(
            F.max(F.when(F.col("replaces"), F.col("seq"))).alias("since"), F.collect_list(F.struct("seq", "pos", "part")).alias("all"))
        live = F.filter("all", lambda x: x["part"].isNotNull() & (x["seq"] >= F.coalesce("since", F.lit(0))))
        found = named.select("table_name", "bucket", "since", live.alias("live")).collect()  # names of folders: a few for each table and bucket
        whole = {r.table_name: r.since for r in found if r.bucket is None and r.since}
        placed: dict[str, list[tuple[int, int, Part]]] = {}
        for row in found:
            mine = [(x.seq, x.pos, Part(x.part, row.bucket)) for x in row.live if x.seq >= whole.get(row.table_name, 0)]
            placed.setdefault(row.table_name, []).extend(mine)
        parts = {name: [part for _, _, part in sorted(entries, key=lambda e: e[:2])] for name, entries in placed.items() if entries}
        return last.seq or 0, parts, dict(last.counters or {})

    def published(self, batch_id: str) -> bool:
        return not self._publications().where(F.col("batch_id") == batch_id).isEmpty()

    def read(self, table: str, parts: list[Part] | None = None) -> DataFrame:
        """The table as published, or the given parts of it."""
        chosen = self.latest()[1].get(table, []) if parts is None else parts
        if not chosen:
            return empty(self.spark, table)
        if table in PERIODS:
            return self._read_by_period(table, chosen)
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.root}/{table}/{p.path}" for p in chosen])

    def _read_by_period(self, table: str, chosen: list[Part]) -> DataFrame:
        """A fact with its months as a partition column. Parts of an older version have no folders for them."""
        base = f"{self.root}/{table}"
        cut = [f"{base}/{p.path}" for p in chosen if p.path.startswith(_PART)]
        whole = [f"{base}/{p.path}" for p in chosen if not p.path.startswith(_PART)]
        found = []
        if cut:
            names = empty(self.spark, table).columns
            rows = self.spark.read.schema(TABLES[table] + f", {_PART[:-1]} string, period string").option("basePath", base).parquet(*cut)
            found.append(rows.select(*names))
        if whole:
            found.append(self.spark.read.schema(TABLES[table]).parquet(*whole).withColumn("period", period_of(PERIODS[table])))
        return reduce(DataFrame.unionByName, found)

    def _subfolders(self, folder: str) -> list[str]:
        """Names below a folder that was just written: one for each bucket that has rows."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return [entry.getPath().getName() for entry in found if entry.isDirectory()]

    def write_part(self, table: str, df: DataFrame, batch_id: str, buckets: int) -> tuple[list[Part], dict[str, int | None]]:
        """Write rows to a folder of their own; returns its parts, and the number of rows and the top keys as the write saw them.

        Large tables are clustered by date and key: range partitions split a hot date or client, and their file
        statistics let filters skip files. Tables with buckets have a folder for each inside."""
        part = (_PART if table in PERIODS else "") + f"{batch_id}-{uuid.uuid4().hex[:8]}"
        rows, order = conform(df, table), list(CLUSTERING.get(table, ()))
        first = []
        if table in BUCKETED:
            rows, first = rows.withColumn(_BUCKET, bucket_of(BUCKETED[table], buckets)), [_BUCKET]
        if table in PERIODS:
            rows, first = rows.withColumn("period", period_of(PERIODS[table])), ["period"]
        if order:
            rows = rows.repartitionByRange(*first, *order).sortWithinPartitions(*first, *order)
        elif first:  # dealt out without a look at the rows first; a client with most of a bucket's rows is several tasks
            rows = rows.repartition(*first, F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)))
        seen = Observation()
        tops = [F.max(c).alias(c) for c in COUNTERS.get(table, ())]
        writer = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *tops).write
        folder = f"{self.root}/{table}/{part}"
        if table not in BUCKETED:
            (writer.partitionBy("period") if table in PERIODS else writer).parquet(folder)
            return [Part(part)], seen.get
        writer.partitionBy(_BUCKET).parquet(folder)
        named = sorted(int(name.partition("=")[2]) for name in self._subfolders(folder) if name.startswith(f"{_BUCKET}="))
        return [Part(f"{part}/{_BUCKET}={bucket}", bucket) for bucket in named], seen.get

    def begin(self, batch_id: str) -> "Batch":
        return Batch(self, batch_id)


class Batch:
    """Tables as they will be once the batch is published. Until then only this object sees them."""

    def __init__(self, warehouse: Warehouse, batch_id: str):
        self.warehouse, self.batch_id, self.spark = warehouse, batch_id, warehouse.spark
        self.seq, self.parts, self.counters = warehouse.latest()
        self.buckets = self.counters.setdefault("buckets", warehouse._buckets)
        self.replaced: set[tuple[str, int | None]] = set()
        self.added: dict[str, list[Part]] = {}
        self.rows_written: dict[str, int] = {}  #: rows the batch has put into each table, rewritten ones included
        self.at: Column = F.lit(
            self.spark.sql("select cast(convert_timezone('UTC', current_timestamp()) as string) as now").first().now
        ).cast("timestamp_ntz")

    @property
    def id(self) -> Column:
        return F.lit(self.batch_id)

    def table(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or the named buckets of it."""
        parts = self.parts.get(name, [])
        if buckets is not None:
            self._adopt(name)
            wanted = set(buckets)
            parts = [p for p in self.parts.get(name, []) if p.bucket in wanted]
        return self.warehouse.read(name, parts)

    def buckets_of(self, rows: DataFrame, key: str = "client_id") -> list[int]:
        """The buckets of the keys in ``rows``: at most as many numbers as there are buckets."""
        found = rows.select(bucket_of(key, self.buckets).alias("bucket")).distinct().collect()
        return sorted(r.bucket for r in found)

    def top_key(self, column: str = "client_sk") -> int:
        """The highest surrogate key in use, as the writes have counted it; looked up once where an older version wrote the table."""
        if column not in self.counters:
            self.counters[column] = top_key(self.table("dim_client"), column)
        return self.counters[column]

    def _write(self, name: str, rows: DataFrame) -> list[Part]:
        parts, seen = self.warehouse.write_part(name, rows, self.batch_id, self.buckets)
        self.rows_written[name] = self.rows_written.get(name, 0) + seen["rows"]
        for column in COUNTERS.get(name, ()):
            self.counters[column] = max(self.top_key(column), seen[column] or 0)
        self.parts.setdefault(name, []).extend(parts)
        self.added.setdefault(name, []).extend(parts)
        return parts

    def _adopt(self, name: str) -> None:
        """Give buckets to a table that an older version wrote without; once."""
        if any(p.bucket is None for p in self.parts.get(name, [])):
            self.replace(name, self.table(name))

    def append(self, name: str, rows: DataFrame) -> DataFrame:
        """Add rows to a table; returns them as written."""
        return self.warehouse.read(name, self._write(name, rows))

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """Put a new table in place of the old one, whose files stay for readers of older publications."""
        parts = self._write(name, rows)
        self.parts[name], self.added[name] = list(parts), list(parts)
        self.replaced = {key for key in self.replaced if key[0] != name} | {(name, None)}
        return self.warehouse.read(name, parts)

    def replace_buckets(self, name: str, rows: DataFrame, buckets: Iterable[int]) -> DataFrame:
        """Put ``rows`` in place of the named buckets, to which they must belong; returns them as written."""
        self._adopt(name)
        gone = set(buckets)
        stays = [p for p in self.parts.get(name, []) if p.bucket not in gone]
        new = [p for p in self.added.get(name, []) if p.bucket not in gone]
        parts = self._write(name, rows)
        strangers = [p.bucket for p in parts if p.bucket not in gone]
        if strangers:
            raise ValueError(f"rows of buckets {strangers} are not part of what is replaced in {name}")
        self.parts[name], self.added[name] = stays + parts, new + parts
        if (name, None) not in self.replaced:
            self.replaced |= {(name, bucket) for bucket in gone}
        return self.warehouse.read(name, parts)

    def changes(self) -> list[tuple[str, str | None, int | None, bool]]:
        """What the publication will say: new parts, and what they take the place of. A replaced table or bucket is named once
        by itself, so that one that became empty is replaced as well."""
        gone = [(name, None, bucket, True) for name, bucket in sorted(self.replaced, key=str)]
        return gone + [(name, part.path, part.bucket, False) for name, parts in self.added.items() for part in parts]

    def publish(self) -> None:
        row = self.spark.createDataFrame([(self.seq + 1, self.batch_id, self.changes(), self.counters, None)], _PUBLICATION)
        row = row.withColumn("published_at", F.current_timestamp()).coalesce(1)
        try:
            row.write.mode("errorifexists").parquet(f"{self.warehouse.root}/publications/{self.seq + 1:012d}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
            raise Overtaken(f"publication {self.seq + 1} exists: another batch was faster than {self.batch_id}; run it again") from error
