"""Surfaces of label maps, their text, reports, locked labels and ellipses."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxloom.functions import geometry
from voxloom.operators import masks, mesh
from voxloom.operators.voxels import Grid
from voxloom.sources import sinks


def _labels(spark, values):
    z, y, x = np.nonzero(values)
    return spark.createDataFrame(pa.table({"volume_id": np.zeros(len(x), dtype=np.int64), "x": x, "y": y, "z": z, "label": values[z, y, x].astype(np.int64)}))


def test_every_label_has_a_closed_surface_and_neighbours_share_faces(spark):
    values = np.random.default_rng(1).integers(0, 4, (4, 5, 6))
    grid = Grid(6, 5, 4, 0.5, 1.0, 2.0)
    faces = mesh.label_faces(_labels(spark, values), grid)
    got = {(r["axis"], r["x"], r["y"], r["z"]): (r["low"], r["high"]) for r in faces.collect()}
    assert faces.count() == len(got)
    pad = np.pad(values, 1)
    want = {}
    for axis, name in enumerate("zyx"):
        a, b = np.delete(pad, -1, axis), np.delete(pad, 0, axis)
        for p in np.argwhere(a != b):
            q = p - 1
            want[name, int(q[2]), int(q[1]), int(q[0])] = (int(a[tuple(p)]), int(b[tuple(p)]))
    assert got == want
    triangles = mesh.label_triangles(faces, grid).collect()
    for label in (1, 2, 3):
        edges, volume = Counter(), 0.0
        for t in (t for t in triangles if t["label"] == label):
            a, b, c = (np.array([t[f"{p}{k}"] for k in "xyz"]) for p in "abc")
            volume += a @ np.cross(b, c) / 6
            n = np.cross(b - a, c - a)
            assert n @ [t["nx"], t["ny"], t["nz"]] > 0
            for p, q in ((a, b), (b, c), (c, a)):
                edges[tuple(p), tuple(q)] += 1
        assert all(edges[q, p] == n for (p, q), n in edges.items())
        assert abs(volume - (values == label).sum() * 1.0) < 1e-9


def test_ascii_stl(spark):
    values = np.zeros((1, 1, 2), dtype=int)
    values[0, 0] = 7, 9
    faces = mesh.label_faces(_labels(spark, values), Grid(2, 1, 1))
    lines = mesh.stl_lines(mesh.label_triangles(faces, Grid(2, 1, 1)), mesh.face_number())
    text = [r["value"] for r in lines.where("label = 7").orderBy("block", "line").collect()]
    assert len(text) == 2 + 12 * 7 and text[0] == "solid label_7" and text[-1] == "endsolid label_7"
    assert text[1:8] == ["  facet normal 0.000000 0.000000 -1.000000", "    outer loop", "      vertex 0.000000 0.000000 0.000000", "      vertex 1.000000 1.000000 0.000000", "      vertex 1.000000 0.000000 0.000000", "    endloop", "  endfacet"]
    assert sum(t.startswith("  facet") for t in text) == 12 and lines.where("label = 9").count() == 2 + 12 * 7


def test_locked_labels_stay(spark):
    values = np.zeros((1, 3, 9), dtype=int)
    values[0, 0] = [1, 1, 0, 1, 0, 1, 1, 1, 0]
    values[0, 2] = [2, 0, 2, 2, 0, 3, 3, 3, 3]
    rows = _labels(spark, values).withColumn("i", (F.col("y") * 9 + F.col("x")).cast("long"))
    rooted = masks.component_roots(rows.select("volume_id", "i", "x", "y", "z", "label"), Grid(9, 3, 1), 6, by="label")
    split = {(r["label"], r["part"]): r["n"] for r in masks.split_labels(rooted, (2,), 2).groupBy("label", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert split == {(1, 1): 3, (1, 2): 2, (2, 0): 3, (3, 0): 4}
    kept = {r["label"]: r["n"] for r in masks.keep_largest_of(rooted, (2,)).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kept == {1: 3, 2: 3, 3: 4}


def test_ellipses(spark):
    p = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0)], "x double, y double")
    assert p.where(geometry.in_ellipse(F.col("x"), F.col("y"), (2, 2), (0.0, 0.0))).count() == 4
    assert p.where(geometry.in_ellipse(F.col("x"), F.col("y"), (0, 0), (0.0, 2.0))).count() == 0


def test_report_pages(spark):
    schema = "scan_id string, label long, fdi int, fdi_name string, voxels long, volume_mm3 double, cz double, cy double, cx double, quality_status string, quality_reasons array<string>"
    items = [("s<1>", 2, None, None, 1234567, None, 1.5, 2.4, 3.0, None, None), ("s<1>", 1, 11, "a & b", 12, 1200.0, 0.0, 0.0, 0.0, "review", ["small", "x<y"])]
    scans = spark.createDataFrame([("s<1>", "from & to", "m", 5), ("none", None, "", None)], "scan_id string, source_label string, algorithm string, candidates long")
    got = {r["scan_id"]: r["value"] for r in sinks.report_html(spark.createDataFrame(items, schema), scans).collect()}
    one, none = got["s<1>"], got["none"]
    rows = [x for x in one.split("\n") if x.startswith("<tr><td>")]
    assert rows[0].startswith("<tr><td>1</td><td>11 a &amp; b</td><td>12</td><td>") and rows[0].endswith('<td>0, 0, 0</td><td class="review">review</td><td>small, x&lt;y</td></tr>')
    assert rows[1] == '<tr><td>2</td><td>—</td><td>1,234,567</td><td>—</td><td>2, 2, 3</td><td class="accepted">accepted</td><td></td></tr>'
    assert "<title>Tooth separation report — s&lt;1&gt;</title>" in one and "  <div>Source: from &amp; to</div>" in one and "<strong>2</strong> items · <strong>1</strong> accepted · <strong>5</strong> candidates · total volume" in one
    assert "Source" not in none and "Method" not in none and "<strong>0</strong> items" in none and one.endswith("</html>")
