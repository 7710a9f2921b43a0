"""Views of a catalogue that follow a stream of its changes: each batch is merged once, however often it is sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.sources.store import VersionedTable


def merged(current: DataFrame | None, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key by ``order``, of what is there and what changes; of equals the changes', then the one of the larger hash.

    Rows that are deleted (deleted_at is set) stay as such, so an older change that comes late does not bring them back.
    """
    new = changes.withColumn("_new", F.lit(1))
    both = new if current is None else new.unionByName(current.withColumn("_new", F.lit(0)))
    names = [c for c in changes.columns if c != key]
    newest = F.max_by(F.struct(*names), F.struct(F.col(order), F.col("_new"), F.xxhash64(*names)))
    return both.groupBy(key).agg(newest.alias("_r")).select(*(F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in changes.columns))


def follow(changes: DataFrame, table: VersionedTable, key: str, order: str, checkpoint: str, name: str, **write):
    """Keep ``table`` the newest row of each key of a stream of changes; returns the query.

    The ledger of merged batches is in the table's current version itself: a batch and its number become current in one step,
    so a batch that is sent again after a failure, in whatever order the failure came, changes nothing. ``name`` is the stream's; several streams
    may feed one table one after the other, each with a ledger of its own.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        now = table.current()
        ledger = dict((now or {}).get("ledger", {}))
        if epoch <= ledger.get(name, -1):
            return
        table.publish(merged(table.read(), batch, key, order), ledger=ledger | {name: epoch})

    return changes.writeStream.queryName(name).option("checkpointLocation", checkpoint).options(**write).foreachBatch(apply).start()


def live(table: VersionedTable, at: str = "deleted_at", order: str | None = None) -> DataFrame | None:
    """The rows that are not deleted, for a view that is read again whenever it changes; sorted only if an order is given."""
    rows = table.read()
    if rows is None:
        return None
    rows = rows.where(F.col(at).isNull())
    return rows.orderBy(F.desc(order)) if order else rows


def latest_of(table: VersionedTable, by: str, order: str) -> DataFrame | None:
    """The newest row of each group."""
    rows = table.read()
    if rows is None:
        return None
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return rows.withColumn("_n", nth).where("_n = 1").drop("_n")
