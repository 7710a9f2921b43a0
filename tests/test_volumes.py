"""Volume operators against plain versions on small volumes: floods, surfaces, models, regions, archives."""

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.test_sources import _dicom, _explicit
from voxloom.operators import catalogue, inference, masks, mesh, voxels, watershed, workflows
from voxloom.operators.voxels import Grid
from voxloom.sources import dicom, files, projects


def _vox(spark, values, volume=0):
    d, h, w = values.shape
    i = np.arange(values.size)
    return spark.createDataFrame(pa.table({"volume_id": np.full(values.size, volume), "i": i, "x": i % w, "y": i // w % h, "z": i // (w * h), "v": values.ravel().astype(np.int64)}))


def _flood(dist, marker):
    """Priority flood voxel by voxel."""
    label = marker.copy()
    queue = [(-dist[p], p) for p in zip(*np.nonzero(marker), strict=True)]
    heapq.heapify(queue)
    while queue:
        _, p = heapq.heappop(queue)
        for step in np.ndindex(3, 3, 3):
            q = tuple(a + b - 1 for a, b in zip(p, step, strict=True))
            if all(0 <= a < n for a, n in zip(q, dist.shape, strict=True)) and dist[q] > 0 and not label[q]:
                label[q] = label[p]
                heapq.heappush(queue, (-dist[q], q))
    return label


def _forest(dist, marker):
    """Edges from the best on join trees, never two with a marker."""
    ids = {tuple(p): k for k, p in enumerate(np.argwhere(dist > 0).tolist())}
    flat = lambda p: (p[0] * dist.shape[1] + p[1]) * dist.shape[2] + p[2]
    edges = []
    for p in ids:
        for step in np.ndindex(3, 3, 3):
            q = tuple(a + b - 1 for a, b in zip(p, step, strict=True))
            if q in ids and p < q:
                edges.append((-min(dist[p], dist[q]), -max(dist[p], dist[q]), flat(p), flat(q), p, q))
    up, mark = {p: p for p in ids}, {p: marker[p] for p in ids}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for *_, p, q in sorted(edges):
        a, b = root(p), root(q)
        if a != b and not (mark[a] and mark[b]):
            up[b], mark[a] = a, mark[a] or mark[b]
    out = np.zeros(dist.shape, dtype=int)
    for p in ids:
        out[p] = mark[root(p)]
    return out


def test_basins_against_plain_versions(spark):
    r = np.random.default_rng(3)
    shape = (7, 9, 11)
    dist = r.permutation(7 * 9 * 11).reshape(shape) + 1.0
    dist[r.random(shape) < 0.3] = 0
    marker = np.where((r.random(shape) < 0.02) & (dist > 0), np.arange(dist.size).reshape(shape) + 1, 0)
    want, flood = _forest(dist, marker), _flood(dist, marker)
    assert (want == flood)[dist > 0].mean() > 0.9 and ((want > 0) == (flood > 0)).all()
    z, y, x = np.nonzero(dist)
    i = (z * 9 + y) * 11 + x
    rows = spark.createDataFrame(pa.table({"volume_id": np.zeros(len(i), dtype=np.int64), "i": i, "x": x, "y": y, "z": z, "dist": dist[z, y, x], "marker": marker[z, y, x]}))
    for brick, small in ((64, 10**9), (4, 10**9), (4, 0)):
        got = {p["i"]: p["basin"] for p in watershed.grown(rows, Grid(11, 9, 7), brick, small).collect()}
        assert got == dict(zip(i.tolist(), want[z, y, x].tolist(), strict=True)), (brick, small)


def test_distances_by_slabs(spark, monkeypatch):
    monkeypatch.setattr(masks, "SLAB", 3)
    r = np.random.default_rng(4)
    v = (r.random((6, 7, 8)) < 0.9).astype(int)
    vox = _vox(spark, v)
    got = {(p["z"], p["y"], p["x"]): p["d2"] for p in masks.squared_distance(vox, masks.threshold(vox, 1, 1), Grid(8, 7, 6)).collect()}
    off = np.argwhere(v == 0)
    assert got == {tuple(p): float(((off - p) ** 2).sum(axis=1).min()) for p in map(tuple, np.argwhere(v == 1).tolist())}


def test_surfaces_are_closed_and_hold_the_volume(spark):
    r = np.random.default_rng(5)
    v = np.zeros((7, 7, 7), dtype=int)
    v[1:6, 1:6, 1:6] = r.random((5, 5, 5)) < 0.6
    vox, g = _vox(spark, v), Grid(7, 7, 7, 0.5, 1.0, 2.0)
    t = mesh.iso_triangles(masks.threshold(vox, 1, 1), g).toPandas()
    p = t[[f"{a}{c}" for a in "abc" for c in "xyz"]].to_numpy().reshape(-1, 3, 3)
    n = t[["nx", "ny", "nz"]].to_numpy()
    place = p / (0.5, 1.0, 2.0)
    assert np.allclose(place * 2, np.round(place * 2))  # middles of edges of the grid
    edges = Counter()
    for tri in np.round(p * 100).astype(int).tolist():
        for a, b in ((0, 1), (1, 2), (2, 0)):
            edges[frozenset((tuple(tri[a]), tuple(tri[b])))] += 1
    assert all(k % 2 == 0 for k in edges.values())  # no edge is open
    area = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
    assert np.allclose(n * np.linalg.norm(area, axis=1, keepdims=True), area)
    want = Counter()  # the middles of the cut edges of each tetrahedron, by how many of its corners are set
    at = lambda c: all(0 <= k < 7 for k in c) and v[c[2], c[1], c[0]]
    for z, y, x in np.ndindex(8, 8, 8):
        for tet in mesh._TETS:
            corners = [(x - 1 + a, y - 1 + b, z - 1 + c) for a, b, c in (mesh._CORNERS[j] for j in tet)]
            inner, outer = [c for c in corners if at(c)], [c for c in corners if not at(c)]
            if inner and outer:
                want[frozenset(tuple(i + o for i, o in zip(a, b, strict=True)) for a in inner for b in outer)] += 1
    # a cut of four middles is two triangles
    made = Counter()
    for tri in np.round(place * 2).astype(int).tolist():
        made.update({tuple(q) for q in tri})
    expect = Counter()
    for cut, k in want.items():
        for q in cut:
            expect[q] += k
    assert len(p) == sum(k * (1 if len(c) == 3 else 2) for c, k in want.items()) and set(made) == set(expect)


def test_surface_of_a_body(spark):
    v = np.zeros((9, 9, 9), dtype=int)
    v[1:7, 1:7, 1:7] = 1
    v[4, 4, 4] = 0  # a hole that is filled
    v[8, 8, 8] = 1
    vox = _vox(spark, v).unionByName(_vox(spark, np.zeros((9, 9, 9), dtype=int), 1))
    triangles, stats = workflows.surface_of(vox, masks.threshold(vox, 1, 1), Grid(9, 9, 9, 0.5, 0.5, 0.5), "draft")
    got = {x["volume_id"]: x for x in stats.collect()}
    assert (got[0]["voxels"], got[0]["volume_mm3"], got[0]["area_mm2"], got[0]["triangles"]) == (216, 27.0, 54.0, 216) and got[1]["error"] == "E_EMPTY"
    assert {x["volume_id"] for x in triangles.select("volume_id").distinct().collect()} == {0}


def test_model_over_a_whole_volume(spark):
    """A model that looks at its input alone: labels come back on the source grid."""
    v = np.zeros((6, 8, 10), dtype=int)
    v[:, :, 5:] = 900
    v[0, 0, 0] = 900  # a small component
    config = inference.ModelConfig(2, (4, 4, 4), (1.0, 1.0, 1.0), -100.0, 1000.0, 0.0, 100.0)
    model = lambda patch, window: np.stack([np.full(window, 1.0), patch])
    vox = _vox(spark, v)
    got = {x["i"]: x["label"] for x in inference.segment_volume(vox, Grid(10, 8, 6), model, config).collect()}
    assert [got[i] for i in range(v.size)] == (v.ravel() > 0).astype(int).tolist()
    clean = {x["i"]: x["label"] for x in inference.segment_volume(vox, Grid(10, 8, 6), model, config, min_mm3=5).collect()}
    assert clean[0] == 0 and sum(clean.values()) == 6 * 8 * 5
    half = inference.segment_volume(vox, Grid(10, 8, 6, 0.5, 0.5, 0.5), model, config).groupBy("label").count().collect()
    assert sum(x["count"] for x in half) == v.size and len(half) == 2
    front = inference.segment_region(vox, Grid(10, 8, 6), lambda patch, window: np.stack([np.zeros(window), patch]), (2, 1, 1), (8, 7, 5), (4, 4, 4))
    assert {x["i"] for x in front.collect()} == {(z * 8 + y) * 10 + x for z in range(1, 5) for y in range(1, 7) for x in range(5, 8)}


def test_greedy_choice_against_a_loop(spark):
    r = np.random.default_rng(6)
    xy = np.round(r.random((400, 2)) * 20, 2)
    xy[:60] = xy[0]
    rows = [(k % 2, k, int(r.integers(0, 50)), *xy[k].tolist()) for k in range(400)] + [(0, 999, 7, None, 1.0)]
    df = spark.createDataFrame(rows, "g long, id long, size long, x double, y double")
    got = {x["id"]: (x["kept"], x["place"]) for x in workflows.greedy_apart(df, "g", [("size", "descending"), ("id", "ascending")], 2.5).collect()}
    for g in (0, 1):
        kept = []
        for _, i, _, x, y in sorted((q for q in rows if q[0] == g and q[3] is not None), key=lambda q: (-q[2], q[1])):
            ok = all(np.hypot(x - a, y - b) >= 2.5 for a, b in kept)
            kept += [(x, y)] if ok else []
            assert got[i] == (ok, len(kept) if ok else 0)
    assert got[999] == (False, 0)


def test_encodings_that_are_not_native_are_reported(spark, tmp_path):
    pixels = [1, 2, 3, 4, 5, 6]
    made = {
        "ok": _dicom(0, pixels),
        "jpeg": _dicom(0, pixels, syntax=b"1.2.840.10008.1.2.4.70"),
        "big": _dicom(0, pixels, syntax=b"1.2.840.10008.1.2.2"),
        "short": _dicom(0, pixels)[:-4],
        "color": _dicom(0, pixels).replace(_explicit((0x28, 0x10), "US", b"\2\0"), _explicit((0x28, 0x2), "US", b"\3\0") + _explicit((0x28, 0x10), "US", b"\2\0")),
    }
    for k, b in made.items():
        (tmp_path / f"{k}.dcm").write_bytes(b)
    head = dicom.read_headers(files.scan_folder(spark, str(tmp_path)))
    got = {x["path"].rsplit("/", 1)[1][:-4]: x["error"] for x in head.collect()}
    assert got == {"ok": None, "jpeg": "E_DICOM_SYNTAX", "big": "E_DICOM_SYNTAX", "short": "E_DICOM_TRUNCATED", "color": "E_DICOM_COLOR"}
    assert [x["path"].rsplit("/", 1)[1] for x in dicom.series(head).collect()] == ["ok.dcm"]
    assert {x["path"].rsplit("/", 1)[1] for x in dicom.is_native(head).collect()} == {"ok.dcm", "short.dcm"}


def _item(body):
    return b"\xfe\xff\x00\xe0" + len(body).to_bytes(4, "little") + body


def test_frames_of_one_file_by_mapped_axes(spark, tmp_path):
    """A sagittal stack: frames run along x, rows along -z."""
    frame = lambda k: _item(_explicit((0x20, 0x9113), "SQ", _item(_explicit((0x20, 0x32), "DS", b"%d\\0\\0" % (2 * k)))))
    shared = _item(_explicit((0x20, 0x9116), "SQ", _item(_explicit((0x20, 0x37), "DS", b"0\\1\\0\\0\\0\\-1"))) + _explicit((0x28, 0x9110), "SQ", _item(_explicit((0x28, 0x30), "DS", b"0.5\\0.25"))))
    values = np.arange(2 * 3 * 4, dtype="<i2")  # 2 frames of 3 rows and 4 columns
    body = b"".join([
        _explicit((8, 0x60), "CS", b"MR"), _explicit((8, 0x103E), "LO", b"t1 ax"), _explicit((0x28, 0x8), "IS", b"2"), _explicit((0x28, 0x10), "US", b"\3\0"), _explicit((0x28, 0x11), "US", b"\4\0"),
        _explicit((0x28, 0x100), "US", b"\x10\0"), _explicit((0x28, 0x103), "US", b"\1\0"), _explicit((0x5200, 0x9229), "SQ", shared), _explicit((0x5200, 0x9230), "SQ", frame(0) + frame(1)), _explicit((0x7FE0, 0x10), "OW", values.tobytes()),
    ])
    (tmp_path / "m.dcm").write_bytes(b"\0" * 128 + b"DICM" + _explicit((2, 0x10), "UI", b"1.2.840.10008.1.2.1") + body)
    entries = files.scan_folder(spark, str(tmp_path))
    head = dicom.read_headers(entries)
    h = head.head()
    assert (h["error"], h["frames"], h["frame_positions"], h["iop"], h["pixel_spacing"]) == (None, 2.0, [[0.0, 0.0, 0.0], [2.0, 0.0, 0.0]], [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], [0.5, 0.25])
    assert dicom.series(head).count() == 0
    c = dicom.frame_candidates(head)
    x = c.head()
    assert (x["source"], x["dims"], x["map"]["axes"], x["map"]["signs"], x["rank"]) == ([4, 3, 2], [2, 4, 3], [1, 2, 0], [1, -1, 1], 1)
    got = {(r["x"], r["y"], r["z"]): r["v"] for r in dicom.frame_voxels(c, entries).collect()}
    assert got == {(f, col, 2 - row): int(values[(f * 3 + row) * 4 + col]) for f in range(2) for row in range(3) for col in range(4)}


def test_projects_round_trip(spark):
    parts = [("p", "mask", 0, "a b", b"1234"), ("p", "mask", 1, "a b", b"56"), ("p", "labelmap", 0, "l", b"12345678"), ("q", "surface", 0, "s", b"stl")]
    heads = [("p", "now", '{"activeTool":"pan"}'), ("q", "now", None), ("empty", "now", "{}")]
    df = spark.createDataFrame(parts, "project string, kind string, ord long, id string, content binary")
    made = projects.project_archives(spark.createDataFrame(heads, "project string, exported_at string, state string"), df, "viewer")
    broken = made.unionByName(spark.createDataFrame([("bad", b"no zip")], "project string, content binary"))
    whole, read = projects.read_projects(broken, "viewer")
    info = {x["project"]: x for x in whole.collect()}
    assert {k: v["error"] for k, v in info.items()} == {"p": None, "q": None, "empty": None, "bad": "E_MANIFEST"}
    assert info["p"]["manifest"]["state"]["activeTool"] == "pan" and len(info["p"]["manifest"]["dataSources"]) == 3
    assert sorted((x["project"], x["kind"], x["id"], bytes(x["content"]), x["error"]) for x in read.collect()) == sorted((p, k, i, c, None) for p, k, _, i, c in parts)
    images = spark.createDataFrame([("p", 4)], "project string, voxels long")
    assert sorted((x["kind"], x["id"], x["error"]) for x in projects.restored(read, images).collect() if x["error"]) == [("mask", "a b", "E_SIZE")]
    assert projects.read_projects(made, "other")[0].where("error = 'version'").count() == 3


def test_ply_lines_in_order(spark):
    v = np.zeros((3, 3, 3), dtype=int)
    v[1, 1, 1] = 1
    t = mesh.face_triangles(masks.threshold(_vox(spark, v), 1, 1), Grid(3, 3, 3))
    lines = [x["value"] for x in mesh.ply_lines(t, ["i", "nx", "ny", "nz", "t"]).orderBy("part", "n").collect()]
    assert lines[:4] == ["ply", "format ascii 1.0", "comment binary mask surface", "element vertex 36"] and lines[7] == "element face 12"
    assert len(lines) == 10 + 36 + 12 and lines[-1] == "3 33 34 35"
    assert mesh.decimated(t, 0.5, ["i", "nx", "ny", "nz", "t"]).count() == 6


def test_uploads_and_formats(spark):
    rows = spark.createDataFrame([("a/b.dcm",), ("a/c",)], "path string")
    assert {(x["label"], x["error"]) for x in catalogue.uploaded(rows).collect()} == {("a", None)}
    assert {(x["label"], x["error"]) for x in catalogue.uploaded(rows.select(F.lit("x").alias("path"))).collect()} == {(None, "E_DIRECTORY_UPLOAD")}


def test_small_readers(spark):
    v = np.arange(24).reshape(2, 3, 4)
    blob = spark.createDataFrame([(5, v.astype("<i2").tobytes())], "volume_id long, content binary")
    slices = files.raw_volume(spark.createDataFrame([(5, 4, 3, 2)], "volume_id long, width long, height long, depth long"), blob)
    got = {x["i"]: x["v"] for x in files.voxels_of_slices(slices).collect()}
    assert got == dict(enumerate(v.ravel().tolist()))
    pts = spark.createDataFrame([(0, 1, 1, 1), (0, 9, 0, 0)], "volume_id long, x long, y long, z long")
    assert sorted(x["v"] for x in voxels.value_at(_vox(spark, v), pts).collect()) == [0, 17]
