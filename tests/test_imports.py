"""Data sources against the readers of tables, trees of sources, names in archives, and files that cannot be read."""

import gzip
import io
import itertools
import json
import random
import struct
import zipfile

import numpy as np
import pytest

from tests.test_sources import _dicom, _explicit
from voxloom.operators import workflows
from voxloom.sources import dicom, files, formats, nifti, tree


def _nifti(values, kind=4, offset=352):
    head = bytearray(offset)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *values.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, kind)
    struct.pack_into("<8f", head, 76, 1, 0.5, 0.75, 2.0, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, offset, 2, -3)
    return bytes(head) + values.astype("<i2").tobytes()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("volumes")
    v = np.random.default_rng(1).integers(-900, 900, (5, 3, 4))
    (top / "a").mkdir()
    (top / "a" / "v.nii").write_bytes(_nifti(v))
    (top / "a" / "w.nii.gz").write_bytes(gzip.compress(_nifti(v + 1)))
    (top / "bad.nii").write_bytes(b"no volume")
    (top / "bad.nii.gz").write_bytes(b"\x1f\x8bnothing")
    (top / "short.nii").write_bytes(_nifti(v)[:-7])
    for z in range(3):
        (top / f"s{z}.dcm").write_bytes(_dicom(z, np.arange(6) + z))
    (top / "junk.dcm").write_bytes(b"junk")
    (top / "r.raw").write_bytes(v.astype("<i2").tobytes())
    (top / "odd.raw").write_bytes(b"123")
    return top


def _read(spark, name, folder, schema=None, **options):
    formats.register(spark)
    r = spark.read.format(name).options(**options)
    return (r.schema(schema) if schema else r).load(str(folder))


def _plain(rows):
    return sorted((tuple(r.asDict().items()) for r in rows), key=repr)


def test_nifti_source_equals_the_reader(spark, folder):
    got = _read(spark, "volume-nifti", folder, partition_bytes=200)
    assert got.rdd.getNumPartitions() > 2
    table = spark.createDataFrame([(str(p), p.read_bytes()) for p in folder.rglob("*.nii*")], "path string, content binary")
    assert _plain(got.collect()) == _plain(nifti.read(table).collect())
    errors = {r["path"].rsplit("/", 1)[1]: r["error"] for r in got.where("error is not null").collect()}
    assert errors == {"bad.nii": "E_FORMAT", "bad.nii.gz": "E_FORMAT", "short.nii": "E_TRUNCATED"}


def test_filters_and_columns_are_pruned(spark, folder, monkeypatch):
    got = _read(spark, "volume-nifti", folder).where("z between 1 and 2 and path like '%/v.nii'")
    plan = spark._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert "StringEndsWith(path,/v.nii)" in plan and "GreaterThanOrEqual(z,1)" in plan and "ReadSchema" in plan
    assert [r["z"] for r in got.orderBy("z").collect()] == [1, 2]
    assert _read(spark, "volume-nifti", folder).where("z = 4").where("path not like '%gz'").select("error").collect() == [(None,)]
    heads = _read(spark, "volume-nifti", folder, formats.headers_of("volume-nifti"))
    assert "pixels" not in heads.columns and heads.where("error is null").count() == 10
    # what is read: a header and the wanted slice, not the file
    reader = formats.NiftiSource({"path": str(folder)}).reader(heads.schema.add("pixels", "binary"))
    list(reader.pushFilters([formats.EqualTo(("z",), 3)]))
    seen = []

    class File(io.BytesIO):
        def read_at(self, n, at):
            seen.append((at, n))
            return self.getvalue()[at : at + n]

    data = _nifti(np.zeros((5, 300, 400), dtype=int))
    assert [r["z"] for r in reader.rows(File(data), "p", len(data), True)] == [3]
    assert seen == [(0, 1 << 16), (352 + 3 * 240_000, 240_000)]


def test_dicom_and_raw_sources(spark, folder):
    got = _read(spark, "volume-dicom", folder)
    table = spark.createDataFrame([(str(p), p.read_bytes()) for p in folder.rglob("*.dcm")], "path string, content binary")
    assert _plain(got.drop("pixels").collect()) == _plain(dicom.read_headers(table).collect())
    assert {len(r["pixels"]) for r in got.where("error is null").collect()} == {12}
    raw = _read(spark, "volume-raw", folder, width=4, height=3, sz=2.5)
    rows = raw.orderBy("z").collect()
    assert [r["error"] for r in rows] == ["E_SIZE", *[None] * 5] and rows[1]["sz"] == 2.5
    whole = b"".join(bytes(r["pixels"]) for r in rows[1:])
    assert whole == (folder / "r.raw").read_bytes()


def test_headers_longer_than_the_prefix(spark, folder):
    whole = (folder / "s0.dcm").read_bytes()
    at = whole.index(struct.pack("<HH", 0x7FE0, 0x0010))
    filler = _explicit((0x0021, 0x1010), "OB", b"x" * 5000)
    long_ = whole[:at] + filler + whole[at:]
    df = spark.createDataFrame([("a", long_), ("b", whole), ("c", long_[:3000])], "path string, content binary")
    got = {r["path"]: r for r in dicom.read_headers(df, prefix=at + 16).collect()}
    assert got["a"]["error"] is None and got["a"]["pixel_offset"] == got["b"]["pixel_offset"] + len(filler)
    assert got["b"]["error"] is None and got["c"]["error"] == "E_DICOM_TRUNCATED"


def test_bad_files_are_rows(spark):
    sizes = spark.createDataFrame([(1, 2, 2, 1), (2, 2, 2, 2)], "volume_id long, width long, height long, depth long")
    blobs = spark.createDataFrame([(1, b"12345678"), (2, b"123")], "volume_id long, content binary")
    got = {r["volume_id"]: r for r in files.raw_volume(sizes, blobs).collect()}
    assert (got[1]["z"], got[1]["error"]) == (0, None) and (got[2]["z"], got[2]["pixels"], got[2]["error"]) == (None, None, "E_SIZE")
    assert files.voxels_of_slices(files.raw_volume(sizes, blobs)).count() == 4
    zips = files.expand_zips(spark.createDataFrame([("x.zip", b"PK\x03\x04 no")], "path string, content binary"), errors=True)
    assert [tuple(r) for r in zips.collect()] == [("x.zip", None, "E_ARCHIVE")]


def _zip(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in entries.items():
            z.writestr(n.replace("_", "."), c)
    return out.getvalue()


def test_tree_of_sources(spark):
    inner = _zip(deep_txt=b"deep")
    manifest = json.dumps({"name": "set", "files": [{"url": "http://h/x.bin", "name": "first"}, {"url": "http://h/none"}, {"url": "all.json"}]}).encode()
    store = [("http://h/x.bin", b"remote", None), ("all.json", manifest, None), ("pack.zip", _zip(a_txt=b"one", in_zip=inner), None), ("loop", None, ["loop2"]), ("loop2", None, ["loop", "lone.txt"]), ("lone.txt", b"lone", None)]
    roots = [("all.json", manifest, None), ("top", None, ["pack.zip", "./loop"]), ("bad.zip", b"PK\x03\x04", None), ("plain.json", b'{"files": "no"}', None)]
    schema = "path string, content binary, children array<string>"
    got = tree.import_tree(spark.createDataFrame(roots, schema), spark.createDataFrame(store, schema)).collect()
    assert {(r["path"], None if r["content"] is None else bytes(r["content"]), r["source"], r["label"], ">".join(r["lineage"]), r["error"]) for r in got} == {
        ("http://h/x.bin", b"remote", "all.json", "first", "all.json", None),
        ("http://h/none", None, "all.json", "set", "all.json", "E_MISSING"),
        ("all.json", None, "all.json", "set", "all.json", "E_CYCLE"),
        ("pack/a.txt", b"one", "top", None, "top>pack.zip", None),
        ("pack/in/deep.txt", b"deep", "top", None, "top>pack.zip>pack/in.zip", None),
        ("lone.txt", b"lone", "top", None, "top>loop>loop2", None),
        ("loop", None, "top", None, "top>loop>loop2", "E_CYCLE"),
        ("bad.zip", None, "bad.zip", None, "", "E_ARCHIVE"),
        ("plain.json", b'{"files": "no"}', "plain.json", None, "", None),
    }


def _names(rows):
    used, out = set(), {}
    for ord_, stem in sorted(rows):
        path = next(p for p in itertools.chain([f"m/{stem}.bin"], (f"m/{stem}_{k}.bin" for k in itertools.count(2))) if p.lower() not in used)
        used.add(path.lower())
        out[ord_] = path
    return out


def test_names_in_archives_as_one_by_one(spark):
    r = random.Random(4)
    cases = [["a", "a", "a_2", "a_2_2"], ["a_2", "a", "a", "A_2", "a_3", "a"], ["x_2", "x_3", "x", "x", "X", "x_2", "x_2_2"]]
    cases += [[r.choice(["a", "A", "a_2", "a_3", "a_2_2", "b"]) + r.choice(["", "", "_2"]) for _ in range(25)] for _ in range(2)]
    rows = [(g, k, n) for g, names in enumerate(cases) for k, n in enumerate(names)]
    got = workflows.archive_paths(spark.createDataFrame(rows, "g long, ord long, name string"), "m", "name", "bin", plain=True, by=["g"]).collect()
    for g, names in enumerate(cases):
        assert {x["ord"]: x["path"] for x in got if x["g"] == g} == _names(list(enumerate(names)))
