"""Compositions of operators on small scans."""

import numpy as np
from pyspark.sql import functions as F

from tests.test_volumes import _vox
from voxloom.operators import inference, pipelines
from voxloom.operators.voxels import Grid


def test_anatomy_groups(spark):
    v = np.zeros((4, 6, 8), dtype=int)
    v[:, :, 4:] = 900
    config = inference.ModelConfig(2, (4, 4, 4), (1.0, 1.0, 1.0), -100.0, 1000.0, 0.0, 100.0)
    labels, groups = pipelines.anatomy(_vox(spark, v), Grid(8, 6, 4, 0.5, 1.0, 2.0), lambda patch, window: np.stack([np.full(window, 1.0), patch]), config, [(1, "a", "A", "#111111"), (2, "b", "B", "#222222")])
    got = groups.collect()
    n = labels.where("label = 1").count()
    assert len(got) == 1 and got[0]["active_value"] == 1 and n > 0
    assert [(s["value"], s["name"], s["voxels"], s["volume_mm3"]) for s in got[0]["segments"]] == [(1, "A", n, float(n)), (2, "B", 0, 0.0)]


def _balls(shape, centers):
    zz, yy, xx = np.indices(shape)
    out = np.zeros(shape, dtype=int)
    for z, y, x, r in centers:
        out[(zz - z) ** 2 + (yy - y) ** 2 + (xx - x) ** 2 <= r * r] = 1000
    return out


def test_library_of_a_region(spark, monkeypatch):
    monkeypatch.setattr(pipelines, "REGION_EDGE", (160, 10, 240))
    v = _balls((16, 18, 30), [(8, 8, 7, 5.5), (8, 9, 18, 4.5), (3, 15, 27, 1.2)])
    grid = Grid(30, 18, 16)
    model = lambda patch, window: np.stack([np.zeros(window), np.where(patch > 0.5, 9.0, -9.0)])
    got = pipelines.region_library(_vox(spark, v), grid, model, (15, 9, 8), 400, 1.0, (16, 16, 16), noise=2, least=50, most=5)
    items = {r["label"]: r for r in got.items.collect()}
    sizes = [int((_balls(v.shape, [b]) > 0).sum()) for b in ((8, 8, 7, 5.5), (8, 9, 18, 4.5), (3, 15, 27, 1.2))]
    assert [items[k]["voxels"] for k in (1, 2)] == sizes[:2] and set(items) == {1, 2} and got.candidates.head()["candidates"] == 3
    subs = {(r["label"], r["n"], r["x0"], r["y1"]) for r in got.submasks.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("y").alias("y1")).collect()}
    assert subs == {(k, sizes[k - 1], 0, items[k]["y1"] - items[k]["y0"] - 1) for k in (1, 2)}
    box = got.triangles.groupBy("volume_id", "label").agg(*(F.min(F.least(*(f"{p}{c}" for p in "abc"))).alias(f"{c}0") for c in "xyz"), *(F.max(F.greatest(*(f"{p}{c}" for p in "abc"))).alias(f"{c}1") for c in "xyz"))
    rows = {r["label"]: r for r in box.collect()}
    assert set(rows) == {1, 2} and all(r["volume_id"] == 0 for r in rows.values())
    for k, r in rows.items():  # half a voxel around the object, in the whole volume
        assert [r[f"{c}0"] for c in "xyz"] == [items[k][f"{c}0"] - 0.5 for c in "xyz"] and [r[f"{c}1"] for c in "xyz"] == [items[k][f"{c}1"] - 0.5 for c in "xyz"]
    assert got.previews.where("intensity > 1 or intensity < 0.45").count() == 0 and got.previews.select("label").distinct().count() == 2


def test_face_surface(spark):
    v = np.full((8, 8, 8), -1000)
    v[1:7, 1:7, 1:7] = 50
    v[4, 4, 4] = -1000
    triangles, stats = pipelines.face_surface(_vox(spark, v), Grid(8, 8, 8, 0.7, 0.7, 0.7))
    got = stats.collect()
    assert [(r["voxels"], round(r["volume_mm3"], 6)) for r in got] == [(216, round(216 * 0.343, 6))]
    assert triangles.count() == got[0]["triangles"] > 0
