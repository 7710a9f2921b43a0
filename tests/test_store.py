"""Versions that appear whole, lookups by bucket, streams that are sent again, and runs that are watched and stopped."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from voxloom.operators import jobs
from voxloom.sources import store
from voxloom.streaming import catalogue


def _studies(n, **more):
    return [{"id": f"s{k}", "app_id": f"a{k % 3}", "owner": f"o{k % 40}", "name": f"n{k}", "source": "local", "status": "ready", "updated_at": k} | more for k in range(n)]


SCHEMA = "id string, app_id string, owner string, name string, source string, status string, updated_at long"


def _rows_read(df):
    """Rows that the scans of a collected frame gave."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size()))


def test_lookups_read_one_bucket(spark, tmp_path):
    t = store.catalogue_table(spark, f"file://{tmp_path}", "studies")
    assert t.current() is None and t.read() is None and t.lookup("id", "s1") is None
    store.put(t, "studies", spark.createDataFrame(_studies(2000), SCHEMA))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells of buckets
    for column, value, n in (("id", "s77", 1), ("owner", "o7", 50), ("app_id", "a1", 667)):
        got = t.lookup(column, value)
        plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
        assert got.count() == n and f"SelectedBucketsCount: 1 out of {store.BUCKETS}" in plan
        # the rows of one file of the copy, and no others
        one = spark.table(t._catalogued(t.current()["version"], column)).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(column) == value).alias("hits"))
        assert _rows_read(t.lookup(column, value)) == one.where("hits > 0").agg(F.sum("n")).head()[0] and one.where("hits > 0").count() == 1
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    # another session knows only the folder
    for c in t.clustered:
        spark.sql(f"DROP TABLE {t._catalogued(t.current()['version'], c)}")
    again = store.catalogue_table(spark, f"file://{tmp_path}", "studies")
    assert [r["name"] for r in again.lookup("id", "s5").collect()] == ["n5"]


def test_rows_of_the_first_version_are_migrated(spark):
    old = spark.createDataFrame([("a", "1.2", True, 7, "x"), ("b", None, False, 8, "y")], "id string, uid string, deleted boolean, updated_at long, other string")
    got = {r["id"]: r for r in store.migrated(old, "studies").collect()}
    assert got["a"]["uids"] == ["1.2"] and got["a"]["deleted_at"] == 7 and got["a"]["created_at"] == 7 and got["a"]["schema_version"] == 2
    assert got["b"]["uids"] is None and got["b"]["deleted_at"] is None and "other" not in got["b"].asDict()
    again = {r["id"]: r for r in store.migrated(store.migrated(old, "studies"), "studies").collect()}
    assert again == got


def test_a_failing_check_publishes_nothing(spark, tmp_path):
    t = store.catalogue_table(spark, f"file://{tmp_path}", "studies")
    store.put(t, "studies", spark.createDataFrame(_studies(10), SCHEMA))
    now = t.current()
    bad = [*_studies(5), {**_studies(1)[0], "id": "", "source": "moon"}, _studies(1)[0]]
    with pytest.raises(store.AuditError) as e:
        store.put(t, "studies", spark.createDataFrame(bad, SCHEMA))
    assert e.value.failed == {"id": 1, "source": 1, "unique": 1}
    assert t.current() == now and t.read().count() == 10
    assert sorted(p.name for p in (tmp_path / "studies").iterdir() if p.is_dir()) == [now["version"]]


CHANGE = "id string, name string, updated_at long, deleted_at long"


def test_batches_that_are_sent_again_change_nothing(spark, tmp_path):
    t = store.VersionedTable(spark, f"file://{tmp_path}/view")
    parts = [[("a", "one", 1, None), ("b", "two", 5, None)], [("a", "three", 3, None), ("b", "late", 2, None)], [("b", None, 9, 9), ("c", "new", 1, None), ("c", "same", 1, None)]]

    def run(upto, fail=None):
        for k, rows in enumerate(parts[:upto]):
            if not (tmp_path / f"in/{k}").exists():
                spark.createDataFrame(rows, CHANGE).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(CHANGE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = catalogue.follow(stream, fail or t, "id", "updated_at", f"{tmp_path}/check", "changes")
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run(1)

    class Fails(store.VersionedTable):
        """Publishes, and ends before the stream hears of it."""

        def publish(self, rows, *a, **about):
            super().publish(rows, *a, **about)
            raise RuntimeError("lost")

    with pytest.raises(Exception):  # noqa: B017
        run(2, Fails(spark, t.path))
    done = t.current()
    assert done["ledger"] == {"changes": 1}
    run(2)  # the batch comes again
    assert t.current() == done
    run(3)
    assert t.current()["ledger"] == {"changes": 2}
    got = {r["id"]: (r["name"], r["deleted_at"]) for r in t.read().collect()}
    assert got["a"] == ("three", None) and got["b"] == (None, 9) and got["c"][0] in ("new", "same")
    assert {r["id"] for r in catalogue.live(t).collect()} == {"a", "c"}


def test_a_stopped_run_leaves_no_table(spark, tmp_path):
    def slow(batches):
        for b in batches:
            time.sleep(30)
            yield b

    t = store.VersionedTable(spark, f"file://{tmp_path}/slow")
    run = jobs.Run(spark, lambda: t.publish(spark.range(100, numPartitions=8).mapInArrow(slow, "id long"))).start()
    until = time.time() + 60
    while not run.progress().running and time.time() < until:
        time.sleep(0.1)
    assert run.progress().tasks >= 8 and run.progress().share < 1
    other = []
    own = threading.Thread(target=lambda: other.append(spark.range(10).count()))
    own.start()
    run.cancel()
    own.join()
    with pytest.raises(jobs.Cancelled):
        run.result()
    assert other in ([10], []) and t.current() is None
    assert not [p for p in (tmp_path / "slow").rglob("*.parquet")] if (tmp_path / "slow").exists() else True


def test_runs_give_results_and_errors(spark):
    run = jobs.Run(spark, lambda: spark.range(1000, numPartitions=3).selectExpr("sum(id)").head()[0]).start()
    assert run.result(120) == 499500 and run.progress().done >= 3
    with pytest.raises(ZeroDivisionError):
        jobs.Run(spark, lambda: 1 // 0).start().result(60)


def test_streams_are_watched(spark, tmp_path):
    watch = jobs.StreamWatch()
    spark.streams.addListener(watch)
    try:
        spark.range(25).write.parquet(f"{tmp_path}/in")
        q = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("noop").queryName("watched").option("checkpointLocation", f"{tmp_path}/c").start()
        q.processAllAvailable()
        q.stop()
        until = time.time() + 30
        while "watched" not in watch.ended and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(watch)
    assert watch.rows["watched"] == 25 and watch.ended["watched"] is None


def test_columns_are_declared(spark):
    for kind, (columns, by) in store.TABLES.items():
        names = [c.split()[0] for c in columns.split(", ")]
        assert set(by) <= set(names)
        empty = store.migrated(spark.createDataFrame([], "id string"), kind)
        assert empty.columns == [*names, "schema_version"] and empty.where(F.col("id").isNull()).count() == 0
