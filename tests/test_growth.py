"""Work that must not grow faster than its input."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom.operators import inference, masks, regions, voxels, watershed
from voxloom.operators.voxels import Grid
from voxloom.plans import region_queries
from voxloom.sources import dicom, sinks, tree


def _uses(column, name: str) -> int:
    return str(column).count(name)


def test_directions_are_evaluated_a_few_times(spark):
    """A nested expression is as large as what it repeats: units and products hold their arguments once."""
    axes = dicom.patient_axes(F.col("iop_"))
    assert max(_uses(c, "iop_") for c in axes.values()) <= 8
    frame = dicom.axis_map([F.col(c) for c in ("a_", "b_", "c_")])
    assert _uses(frame["axes"], "a_") + _uses(frame["signs"], "a_") <= 2
    row = spark.sql("SELECT array(0.0D, 2.0D, 0.0D, 3.0D, 0.0D, 0.0D) AS iop_").select(axes["superior"].alias("s")).head()
    assert [v + 0.0 for v in row.s] == [0.0, 0.0, -1.0]


def test_transform_texts_are_read_once(spark):
    assert _uses(sinks.parse_transform(F.col("text_")), "text_") <= 1
    assert _uses(sinks.transform_text(F.col("matrix_")), "matrix_") <= 1
    bad = spark.createDataFrame([(None,), ("",), ("Parameters: 1 2",)], "text_ string").select(sinks.parse_transform(F.col("text_")).alias("m"))
    assert [r.m for r in bad.collect()] == [None, None, None]


def test_boxes_of_claims_are_not_broadcast(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(regions, "assigned_instances", lambda claims, *_: seen.append(claims._jdf.queryExecution().sparkPlan().toString()) or (claims, claims))
    region_queries._claims(spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in seen[0]


@pytest.mark.parametrize("out", [(9, 7, 150), (2, 70, 3)])
def test_linear_resampling_by_bricks(spark, out):
    """Against the eight corners of each voxel, with missing voxels, a null, a volume that lies in one brick, and text ids."""
    g, o = Grid(5, 6, 75), Grid(*out)
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(0, 100, (75, 6, 5)), 3)
    gone = rng.random(a.shape) < 0.2
    rows = [("one", int(x), int(y), int(z), None if (x, y, z) == (1, 1, 1) else float(a[z, y, x])) for z, y, x in np.argwhere(~gone)]
    got = voxels.resample_linear(spark.createDataFrame([*rows, ("two", 0, 0, 0, 1.0), ("two", 9, 0, 0, 5.0)], "volume_id string, x long, y long, z long, v double"), g, o)
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan  # no row for each corner
    a[gone] = 0
    a[1, 1, 1] = 0
    two = np.zeros(a.shape)
    two[0, 0, 0] = 1

    def expected(v):
        for axis, (n, m) in enumerate(zip((75, 6, 5), out[::-1], strict=True)):
            s = np.clip((np.arange(m) + 0.5) * (n / m) - 0.5, 0, n - 1)
            lo = np.floor(s).astype(int)
            w = (s - lo).reshape([-1 if k == axis else 1 for k in range(3)])
            v = v.take(lo, axis) * (1 - w) + v.take(np.minimum(lo + 1, n - 1), axis) * w
        return v

    found = {"one": np.full(out[::-1], np.nan), "two": np.full(out[::-1], np.nan)}
    for r in got.collect():
        assert np.isnan(found[r.volume_id][r.z, r.y, r.x])
        found[r.volume_id][r.z, r.y, r.x] = r.v
    np.testing.assert_allclose(found["one"], expected(a), atol=1e-9)
    np.testing.assert_allclose(found["two"], expected(two), atol=1e-9)


@pytest.mark.parametrize("size,window,overlap", [(16, 16, 0.5), (17, 16, 0.5), (25, 16, 0.25), (7, 16, 0.5), (50, 8, 0.0), (33, 5, 0.9), (1, 4, 0.5)])
def test_windows_that_hold_a_place(spark, size, window, overlap):
    axis, padded = inference._Axis(size, window, overlap), max(size, window)
    at = inference.starts(padded, window, overlap)
    assert [axis.start(k) for k in range(axis.count)] == at
    src = inference._mirror(np.arange(padded) - (padded - size) // 2, size)
    want = sorted((int(src[a + o]), k, o) for k, a in enumerate(at) for o in range(window))
    got = axis.dealt(spark.range(-1, size + 1).select(F.col("id").alias("x")), "x").select("x", "_kx", "_ox").collect()
    assert sorted(map(tuple, got)) == want


def test_windows_of_long_volumes_need_no_list_of_places(spark, monkeypatch):
    mirror = inference._mirror

    def short(i, n):
        assert len(i) <= 4
        return mirror(i, n)

    monkeypatch.setattr(inference, "_mirror", short)
    vox = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 3, 3, 99_999, 2.0)], "volume_id long, x long, y long, z long, v double")
    got = inference.patches(vox, Grid(4, 4, 100_000), (4, 4, 4), 0.5).select("w", "z0").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (49_998, 99_996)]


def test_long_lines_are_gathered_a_few_at_a_time(spark, monkeypatch):
    for n in (1, 25, 1_000, 14_400, 86_400, 5_000_000):
        side = masks.lines_together(n)
        assert side == 1 or side * side * n <= masks.CELLS
    rng = np.random.default_rng(3)
    here = np.argwhere(rng.random((40, 6, 6)) < 0.9)
    vox = spark.createDataFrame([(0, int(x), int(y), int(z), int(rng.random() < 0.9)) for z, y, x in here], "volume_id long, x long, y long, z long, m long")
    distances = lambda: sorted(map(tuple, masks.squared_distance(vox, vox.where("m = 1"), Grid(6, 6, 40)).collect()))
    whole = distances()
    monkeypatch.setattr(masks, "CELLS", 160)
    assert distances() == whole


def test_children_of_manifests_are_handed_on_together():
    files = [{"url": f"f/{k}.txt"} for k in range(10_000)]
    node = {"path": "m.json", "content": json.dumps({"files": files}).encode(), "label": None, "lineage": [], "kind": "manifest"}
    got = list(tree._opened([pa.RecordBatch.from_pylist([node])]))
    assert len(got) <= 3
    assert [p for b in got for p in b.column("path").to_pylist()] == [f["url"] for f in files]


def test_means_of_neighbours_by_bricks(spark, monkeypatch):
    """No row for each neighbour; nulls, other columns, text ids and voxels at the rims of bricks and of the grid."""
    monkeypatch.setattr(masks.with_rims, "__defaults__", (4,))
    g = Grid(9, 5, 11)
    rng = np.random.default_rng(8)
    a = rng.integers(-50, 50, (11, 5, 9)).astype(float)
    here = rng.random(a.shape) < 0.7
    here[0, 0, 0] = True
    rows = [("one", int((z * 5 + y) * 9 + x), int(x), int(y), int(z), None if (x, y, z) == (0, 0, 0) else float(a[z, y, x]), "t") for z, y, x in np.argwhere(here)]
    got = masks.smooth(spark.createDataFrame([*rows, ("two", 0, 0, 0, 0, 8.0, "t")], "volume_id string, i long, x long, y long, z long, v double, other string"), g)
    assert "Join" not in got._jdf.queryExecution().analyzed().toString() and got.columns == ["volume_id", "i", "x", "y", "z", "v", "other", "smooth"]
    found = {(r.volume_id, r.z, r.y, r.x): r.smooth for r in got.collect()}
    a[~here] = 0
    a[0, 0, 0] = 0
    for z, y, x in np.argwhere(here):
        near = [a[z + dz, y + dy, x + dx] for dx, dy, dz in [(0, 0, 0), *masks.offsets(6)] if 0 <= z + dz < 11 and 0 <= y + dy < 5 and 0 <= x + dx < 9]
        assert found.pop(("one", z, y, x)) == (None if not (x or y or z) else pytest.approx(sum(near) / len(near)))
    assert found == {("two", 0, 0, 0): 2.0}


def test_voxels_go_to_the_bricks_that_they_touch(spark, monkeypatch):
    """Only bricks of the grid, each once, and no list of all neighbours for every voxel."""
    g, brick = Grid(7, 3, 10), 3
    places = [(x, y, z) for x in range(7) for y in range(3) for z in range(10)]
    rows = spark.createDataFrame([(0, (z * 3 + y) * 7 + x, x, y, z, 1.0, 0) for x, y, z in places], "volume_id long, i long, x long, y long, z long, dist double, marker long")
    got = sorted(tuple(r) for r in masks.with_rims(rows, g, brick).select("x", "y", "z", "_bx", "_by", "_bz", "_own").collect())
    want = set()
    for p in places:
        for d in [(0, 0, 0), *masks.offsets(26)]:
            q = [a + b for a, b in zip(p, d, strict=True)]
            if all(0 <= a < n for a, n in zip(q, (7, 3, 10), strict=True)):
                b = tuple(a // brick for a in q)
                want.add((*p, *b, b == tuple(a // brick for a in p)))
    assert got == sorted(want)
    plans = {}
    written = watershed.written
    monkeypatch.setattr(watershed, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().analyzed().toString()) and written(df, name))
    watershed.grown(rows, g, brick)
    assert plans["ws-bricks"].lower().count("floor(") <= 12
