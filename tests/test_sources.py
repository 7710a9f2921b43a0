"""Readers, writers and streams on synthetic files."""

import gzip
import io
import struct
import zipfile

import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import masks, mesh
from voxloom.operators.voxels import Grid
from voxloom.sources import dicom, files, nifti, sinks
from voxloom.streaming import sessions


def _explicit(tag, vr, value):
    value = value + (b" " if len(value) % 2 else b"")
    head = struct.pack("<HH", *tag) + vr.encode()
    return head + (b"\0\0" + struct.pack("<I", len(value)) if vr in ("OW", "OB", "SQ") else struct.pack("<H", len(value))) + value


def _dicom(z, pixels, slope=b"2", series=b"1.2.3", syntax=b"1.2.840.10008.1.2.1"):
    short = lambda n: struct.pack("<H", n)
    body = b"".join(
        [
            _explicit((8, 0x60), "CS", b"CT"),
            struct.pack("<HH", 8, 0x1115) + b"SQ\0\0" + struct.pack("<I", 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + _explicit((8, 0x60), "CS", b"XX") + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0),
            _explicit((0x20, 0xE), "UI", series),
            _explicit((0x20, 0x13), "IS", b"1"),
            _explicit((0x20, 0x32), "DS", b"0\\0\\%d" % z),
            _explicit((0x20, 0x37), "DS", b"1\\0\\0\\0\\1\\0"),
            _explicit((0x28, 0x10), "US", short(2)),
            _explicit((0x28, 0x11), "US", short(3)),
            _explicit((0x28, 0x30), "DS", b"0.5\\0.5"),
            _explicit((0x28, 0x100), "US", short(16)),
            _explicit((0x28, 0x103), "US", short(1)),
            _explicit((0x28, 0x1052), "DS", b"-1000"),
            _explicit((0x28, 0x1053), "DS", slope),
            _explicit((0x7FE0, 0x10), "OW", np.array(pixels, dtype="<i2").tobytes()),
        ]
    )
    return b"\0" * 128 + b"DICM" + _explicit((2, 0x10), "UI", syntax) + body


def test_dicom_series_to_voxels(spark, tmp_path):
    for k, z in enumerate((2, 0, 1, 1)):
        (tmp_path / f"{k}.dcm").write_bytes(_dicom(z, [z * 10 + j for j in range(5)] + [32767]))
    (tmp_path / "bad.dcm").write_bytes(b"no dicom")
    entries = files.scan_folder(spark, str(tmp_path), "*.dcm")
    assert {r["magic"] for r in files.described(entries).collect()} == {"dicom", None}
    head = dicom.read_headers(entries)
    assert {r["error"] for r in head.collect()} == {None, "E_FORMAT"}
    ordered = dicom.series(head)
    assert sorted((r["z"], r["ipp"][2], r["duplicates"], r["orientation"]) for r in ordered.collect()) == [(0, 0.0, 1, "axial"), (1, 1.0, 1, "axial"), (2, 2.0, 1, "axial")]
    got = dicom.assemble(ordered, entries).withColumn("volume_id", F.lit(7).cast("long"))
    vox = files.voxels_of_slices(got)
    rows = {r["i"]: r["v"] for r in vox.collect()}
    assert len(rows) == 18 and rows[0] == -1000 and rows[6] == -980 and rows[5] == (32767 * 2 - 1000 + 32768) % 65536 - 32768
    back = files.slices_of_voxels(vox, 3, 2).collect()
    assert sorted((r["z"], bytes(r["pixels"])) for r in back) == sorted((r["z"], bytes(r["pixels"])) for r in got.collect())


def test_nifti_and_zip(spark):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 2, 2, 2, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 16)
    struct.pack_into("<8f", head, 76, 1, 0.4, 0.5, 0.6, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352, 0, 5)
    data = bytes(head) + np.array([0, 1.5, -2.5, 1e6, -1e6, 3, 4, 5], dtype="<f4").tobytes()
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a/../v.nii.gz", gzip.compress(data))
        f.writestr("w.nii", data)
    entries = files.expand_zips(spark.createDataFrame([("in\\x.zip", z.getvalue())], "path string, content binary"))
    assert sorted(r["path"] for r in entries.collect()) == ["in/x/a/v.nii.gz", "in/x/w.nii"]
    rows = nifti.read(entries).collect()
    assert len(rows) == 4 and all(abs(r["sx"] - 0.4) < 1e-6 for r in rows)
    first = [r for r in rows if r["z"] == 0 and r["path"].endswith("w.nii")][0]
    assert np.frombuffer(first["pixels"], "<i2").tolist() == [5, 7, 3, 32767]


def test_transform_and_landmarks_round_trip(spark):
    m = [0.0, -1.0, 0.0, 5.0, 1.0, 0.0, 0.0, -3.0, 0.0, 0.0, 1.0, 2.0, 0.0, 0.0, 0.0, 1.0]
    df = spark.createDataFrame([(m,)], "m array<double>").withColumn("t", sinks.transform_text(F.col("m")))
    assert df.select(sinks.parse_transform(F.col("t")).alias("b")).head()["b"] == m
    pts = spark.createDataFrame([("s", 0, "1", "N", "d", 1.0, 2.0, 3.0), ("s", 1, "2", "Ba", None, -4.0, 5.0, -6.0)], "k string, ord int, id string, label string, description string, x double, y double, z double")
    got = sinks.landmarks(sinks.landmark_json(pts, "k"), "value", "k").orderBy("ord").collect()
    assert [(r["label"], r["x"], r["y"], r["z"]) for r in got] == [("N", 1.0, 2.0, 3.0), ("Ba", -4.0, 5.0, -6.0)]


def test_one_voxel_surface(spark):
    one = spark.createDataFrame([(0, 0, 0, 0, 0)], "volume_id long, i long, x long, y long, z long")
    g = Grid(1, 1, 1)
    t = mesh.face_triangles(one, g)
    assert t.count() == 12 and mesh.iso_triangles(one, g).count() > 0
    normal = mesh.triangle_normal()
    made = t.select("nx", "ny", "nz", *(n.alias(f"m{k}") for k, n in enumerate(normal))).collect()
    assert all(tuple(r)[:3] == tuple(r)[3:] for r in made)
    assert len(mesh.stl_files(t).head()["content"]) == 84 + 50 * 12
    assert mesh.smoothed(mesh.iso_triangles(one, g), 2).count() == mesh.iso_triangles(one, g).count()


def test_components_against_flood_fill(spark):
    r = np.random.default_rng(6)
    a = r.random((9, 10, 11)) < 0.3
    g = Grid(11, 10, 9)
    rows = [(1, int((z * 10 + y) * 11 + x), int(x), int(y), int(z)) for z, y, x in np.argwhere(a)]
    df = spark.createDataFrame(rows, "volume_id long, i long, x long, y long, z long")
    for n in (6, 26):
        want, seen = {}, set()
        for z, y, x in np.argwhere(a).tolist():
            if (z, y, x) in seen:
                continue
            todo, members = [(z, y, x)], []
            seen.add((z, y, x))
            while todo:
                c = todo.pop()
                members.append((c[0] * 10 + c[1]) * 11 + c[2])
                for dx, dy, dz in masks.offsets(n):
                    q = (c[0] + dz, c[1] + dy, c[2] + dx)
                    if all(0 <= v < m for v, m in zip(q, a.shape, strict=True)) and a[q] and q not in seen:
                        seen.add(q)
                        todo.append(q)
            want |= dict.fromkeys(members, min(members))
        for brick in (4, 64):  # across bricks and within one
            assert {x["i"]: x["root"] for x in masks.component_roots(df, g, n, brick=brick).collect()} == want


def test_undo_stream(spark, tmp_path):
    rows = [("a", k, op, k) for k, op in enumerate(["commit", "commit", "undo", "redo", "undo", "commit", "redo"])]
    schema = "session string, seq long, op string, edit long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    q = sessions.edit_sessions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("undo_log").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("undo_log").orderBy("seq").collect()
    assert [(r["current"], r["depth"], r["redo"]) for r in got] == [(0, 1, 0), (1, 2, 0), (0, 1, 1), (1, 2, 0), (0, 1, 1), (5, 2, 0), (5, 2, 0)]
