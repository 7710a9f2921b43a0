"""Small operators that no query covers: brush shapes, opening, relabelling, settled views, magic numbers, catalogue ids."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from tests.test_sources import _dicom
from tests.test_volumes import _vox
from voxloom.operators import candidates, catalogue, masks
from voxloom.operators.voxels import Grid
from voxloom.sources import dicom, sinks
from voxloom.streaming import sessions


def test_brush_erases_in_squares_and_keeps_locked_labels(spark):
    v = np.zeros((2, 7, 7), dtype=int)
    v[1, 2:5, 2:5] = 3
    v[1, 3, 3] = 5
    grid = Grid(7, 7, 2, 1.0, 2.0, 1.0)
    labels = _vox(spark, v).withColumnRenamed("v", "label")
    yy, xx = np.indices((7, 7))

    def run(**how):
        got = {r["i"]: r["label"] for r in masks.brush(labels, grid, (3, 3, 1), 4.0, **how).collect()}
        return np.array([got[k] for k in range(98)]).reshape(2, 7, 7)

    near = {True: np.hypot(xx - 3, (yy - 3) * 2.0) <= 2, False: (abs(xx - 3) <= 2) & (abs(yy - 3) <= 1)}
    for circle in (True, False):
        erased, drawn = v.copy(), v.copy()
        erased[1][near[circle] & (v[1] == 3)] = 0
        drawn[1][near[circle] & (v[1] != 5)] = 3
        assert (run(value=3, erase=True, circle=circle) == erased).all()
        assert (run(value=3, circle=circle, locked=(5,)) == drawn).all()


def test_opening_drops_what_is_thin(spark):
    v = np.zeros((5, 6, 7), dtype=int)
    v[1:4, 1:4, 1:4] = 1
    v[2, 2, 4:7] = 1
    got = {r["i"] for r in masks.opening(masks.threshold(_vox(spark, v), 1, 1), Grid(7, 6, 5)).collect()}
    crosses = [(2 + z, 2 + y, c + x) for c in (2, 3) for z, y, x in [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]]
    want = {(z * 6 + y) * 7 + x for z, y, x in crosses}
    assert got == want


def test_relabelled_maps(spark):
    labels = spark.createDataFrame([(0, 1, 4), (0, 2, 9), (0, 3, 7)], "volume_id long, i long, label long")
    instances = spark.createDataFrame([(4, 2), (9, 0)], "id long, label long")
    assert {r["i"]: r["label"] for r in candidates.relabelled(labels, instances).collect()} == {1: 2, 2: 0, 3: 0}


def test_views_settle_after_a_quiet_time(spark, tmp_path):
    at = lambda ms: datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)
    rows = [("a", at(0), 1), ("a", at(50), 2), ("a", at(400), 3), ("b", at(10), 9), ("a", at(60_000), 4)]
    spark.createDataFrame(rows, "session string, ts timestamp, value long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("session string, ts timestamp, value long").parquet(f"{tmp_path}/in")
    q = sessions.settled_views(stream).writeStream.format("memory").queryName("settled").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["session"], r["value"]) for r in spark.table("settled").collect()} == {("a", 2), ("a", 3), ("b", 9)}


def test_dicom_by_magic_or_ending(spark):
    rows = [("x/noname", _dicom(0, [1] * 6)), ("x/a.DCM", b"short"), ("x/b.txt", b"text"), ("x/empty", b"")]
    got = dicom.by_magic(spark.createDataFrame(rows, "path string, content binary"))
    assert {r["path"] for r in got.collect()} == {"x/noname", "x/a.DCM"}


def test_report_rows_are_escaped(spark):
    schema = "label long, name string, volume_mm3 double, quality_status string"
    got = sinks.report_rows_html(spark.createDataFrame([(1, "<b> & c", 12.0, "accepted")], schema)).head()["value"]
    assert got.startswith("<tr><td>&lt;b&gt; &amp; c</td><td>") and got.endswith("<td>accepted</td></tr>")


def test_new_ids_differ(spark):
    made = spark.range(100).select(catalogue.app_id("study").alias("id"))
    assert made.select(F.countDistinct("id")).head()[0] == 100 and made.where("id not rlike '^study_[0-9a-f-]{36}$'").count() == 0
