"""Catalogue tables in the shared folder: declared columns with a version, copies clustered for each lookup, and versions that appear only whole.

A table is a folder of versions and a small file that names the current one. A version is written first, audited, and then named
by renaming that file into place, so readers see the old or the new rows and never a part.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.operators.staging import written

SCHEMA_VERSION = 2
BUCKETS = 16

#: Columns of the catalogue's tables, and the columns by which rows are looked up (fixed values of the catalogue's contract).
TABLES = {
    "studies": ("id string, app_id string, owner string, name string, source string, status string, uids array<string>, state string, created_at long, updated_at long, deleted_at long", ("id", "app_id", "owner")),
    "presets": ("id string, app_id string, study_id string, name string, value string, created_at long, updated_at long, deleted_at long", ("id", "study_id")),
    "projects": ("id string, study_id string, version int, manifest string, updated_at long", ("id", "study_id")),
}
SOURCES, STATUSES = ("local", "remote", "sample", "upload"), ("draft", "ready", "archived")


def migrated(rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` of any earlier version with the columns of ``kind``, and ``schema_version``.

    Version 1 had no app_id, uids and created_at, one uid, and a flag ``deleted``: uid becomes the only one of uids, the
    flag the time of the last change, created_at that time too. Columns that a row's version does not have are null; others than the declared ones go.
    """
    columns = [c.split(" ", 1) for c in TABLES[kind][0].split(", ")]
    there = {c.lower() for c in rows.columns}
    old = F.coalesce(F.col("schema_version"), F.lit(1)) < SCHEMA_VERSION if "schema_version" in there else F.lit(True)
    value = {n: F.col(n) if n in there else F.lit(None) for n, _ in columns}
    if "uid" in there and "uids" in value:
        value["uids"] = F.when(old & value["uids"].isNull() & F.col("uid").isNotNull(), F.array(F.col("uid").cast("string"))).otherwise(value["uids"])
    if "deleted" in there and "deleted_at" in value:
        value["deleted_at"] = F.when(old & F.col("deleted").cast("boolean"), F.coalesce(value["deleted_at"], value["updated_at"])).otherwise(value["deleted_at"])
    if "created_at" in value:
        value["created_at"] = F.when(old, F.coalesce(value["created_at"], value["updated_at"])).otherwise(value["created_at"])
    return rows.select(*(value[n].cast(t).alias(n) for n, t in columns), F.lit(SCHEMA_VERSION).alias("schema_version"))


def catalogue_checks(kind: str) -> dict[str, Column]:
    """What must hold for every row of a catalogue table, by name."""
    checks = {"id": F.col("id").isNotNull() & (F.col("id") != "")}
    if kind == "studies":
        checks |= {"source": F.col("source").isin(*SOURCES), "status": F.col("status").isNull() | F.col("status").isin(*STATUSES), "times": F.coalesce(F.col("deleted_at"), F.lit(0)) >= 0}
    return checks


class AuditError(ValueError):
    """A version that was not published, with the number of rows against each check."""

    def __init__(self, failed: dict[str, int]):
        super().__init__(f"checks failed: {failed}")
        self.failed = failed


def audited(rows: DataFrame, checks: dict[str, Column], unique: str | None = None) -> dict[str, int]:
    """How many rows stand against each check, in one pass (a null counts as against it), and how many keys stand twice."""
    failed = {}
    if checks:
        got = rows.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items())).head().asDict()
        failed = {n: k for n, k in got.items() if k}
    if unique:
        twice = rows.groupBy(unique).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()
        failed |= {"unique": twice} if twice else {}
    return failed


@dataclass
class VersionedTable:
    """A table of versions below ``path``; ``clustered`` names columns, for each of which a copy is kept that lookups read a bucket of."""

    spark: SparkSession
    path: str
    clustered: tuple[str, ...] = ()
    buckets: int = BUCKETS
    known: set[str] = field(default_factory=set)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> dict | None:
        """What is said of the current version; None before the first."""
        p, fs = self._fs(f"{self.path}/current.json")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _name(self, about: dict) -> None:
        p, fs = self._fs(f"{self.path}/current-{uuid.uuid4().hex}.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(about).encode()))
        out.close()
        files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark._sc._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        files.rename(p, self._fs(f"{self.path}/current.json")[0], options)

    def _catalogued(self, version: str, column: str) -> str:
        return "voxloom_" + hashlib.sha256(f"{self.path}/{version}/{column}".encode()).hexdigest()[:32]

    def publish(self, rows: DataFrame, checks: dict[str, Column] | None = None, unique: str | None = None, **about) -> dict:
        """Write, audit, publish: the new version is current once all checks hold; if one fails, an AuditError says which and nothing changes.

        What a failed or cancelled run has written is deleted, and no reader ever saw it.
        """
        version = uuid.uuid4().hex
        top = f"{self.path}/{version}"
        try:
            rows.write.parquet(f"{top}/rows")
            made = self.spark.read.schema(rows.schema).parquet(f"{top}/rows")
            failed = audited(made, checks or {}, unique)
            if failed:
                raise AuditError(failed)
            for c in self.clustered:
                dealt = made.repartition(self.buckets, c)
                dealt.write.option("path", f"{top}/by-{c}").bucketBy(self.buckets, c).sortBy(c).saveAsTable(self._catalogued(version, c))
            said = about | {"version": version, "columns": made.schema.jsonValue(), "buckets": self.buckets, "clustered": list(self.clustered)}
            self._name(said)
            return said
        except BaseException:
            for c in self.clustered:
                self.spark.sql(f"DROP TABLE IF EXISTS {self._catalogued(version, c)}")
            p, fs = self._fs(top)
            fs.delete(p, True)
            raise

    def read(self) -> DataFrame | None:
        """All rows of the current version."""
        now = self.current()
        if now is None:
            return None
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(now["columns"])).parquet(f"{self.path}/{now['version']}/rows")

    def lookup(self, column: str, value) -> DataFrame | None:
        """Rows of a value of a clustered column: one bucket's files are read, and in them the row groups that may hold it."""
        now = self.current()
        if now is None:
            return None
        if column not in now["clustered"]:
            return self.read().where(F.col(column) == value)
        name = self._catalogued(now["version"], column)
        if not self.spark.catalog.tableExists(name):  # another session wrote it
            from pyspark.sql.types import StructType

            columns = StructType.fromJson(now["columns"]).toDDL()
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({column}) SORTED BY ({column}) INTO {now['buckets']} BUCKETS LOCATION '{self.path}/{now['version']}/by-{column}'")
        return self.spark.table(name).where(F.col(column) == value)


def catalogue_table(spark: SparkSession, top: str, kind: str) -> VersionedTable:
    """The table of ``kind`` below a folder, clustered by its lookups."""
    return VersionedTable(spark, f"{top.rstrip('/')}/{kind}", TABLES[kind][1])


def put(table: VersionedTable, kind: str, rows: DataFrame) -> dict:
    """Publish ``rows`` of any version as the table of ``kind``, if its checks hold and every id stands once."""
    return table.publish(written(migrated(rows, kind), f"catalogue-{kind}"), catalogue_checks(kind), "id")
