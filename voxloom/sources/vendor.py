"""Vendor reconstructions: folders of gzipped slices with one tag header, and single-file z-fastest volumes."""

from __future__ import annotations

import gzip
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.jsnum import round_half_up
from voxloom.functions.text import comma_number

#: Fixed values of the single-file format.
MARKER, ARRAY_NAME, SCALE, SENTINEL = b"JmVolumeVersion=1", b"CArray3D", 100, -32768


def tag_text(text: Column, tag: str) -> Column:
    """Trimmed content of the first such element, null where it is missing or empty."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), r"^\s+|\s+$", ""), F.lit(""))


def tag_number(text: Column, *tags: str) -> Column:
    """The first of the tags with a number, decimal commas allowed."""
    return F.coalesce(*(comma_number(tag_text(text, t)) for t in tags))


def _unzipped(col: str, df: DataFrame) -> DataFrame:
    """``df`` with the binary column ``col`` inflated where it is gzipped."""

    at = df.columns.index(col)

    def run(batches):
        for b in batches:
            got = [gzip.decompress(x) if x is not None and x[:2] == b"\x1f\x8b" else x for x in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(got, pa.binary())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def slice_folders(entries: DataFrame) -> DataFrame:
    """Headers of gzipped-slice folders: folder, scan_id, size, spacing, scalar range, slices and error.

    ``error`` is E_HEADER without exactly one header, E_SLICES without a slice, E_SLICE_GAP where a
    number is missing, E_DUPLICATE where a name is there twice.
    """
    e = entries.select("content", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    head = e.where(F.col("name").rlike(r"(?i)^.+_vol_0$"))
    text = _unzipped("content", head.select("folder", "name", "content")).withColumn("t", F.decode("content", "ISO-8859-1"))
    one = text.groupBy("folder").agg(F.count(F.lit(1)).alias("headers"), F.min("t").alias("t"), F.min("name").alias("name"))
    num = F.regexp_extract("name", r"(?i)_vol_0_(\d+)$", 1)
    s = e.where(F.col("name").rlike(r"(?i)_vol_0_\d+$")).select("folder", "name", num.cast("long").alias("k"))
    step = s.withColumn("gap", F.col("k") - F.lag("k").over(Window.partitionBy("folder").orderBy("k")))
    n = step.groupBy("folder").agg(F.count(F.lit(1)).alias("slices"), F.count_distinct("name").alias("names"), F.max(F.coalesce("gap", F.lit(1))).alias("gap"))
    t = F.col("t")
    size = lambda k, tag, other: F.coalesce(F.regexp_extract(t, r"(\d+)\s*[xX]\s*(\d+)\s*[xX]\s*(\d+)", k).try_cast("long"), round_half_up(tag_number(t, tag)), other)
    error = (
        F.when(F.coalesce("headers", F.lit(0)) != 1, "E_HEADER")
        .when(F.coalesce("slices", F.lit(0)) < 1, "E_SLICES")
        .when(F.col("names") < F.col("slices"), "E_DUPLICATE")
        .when(F.col("gap") > 1, "E_SLICE_GAP")
    )
    return one.join(n, "folder", "full").select(
        "folder",
        F.coalesce(tag_text(t, "ScanID"), F.regexp_extract("name", r"(?i)^(.+)_vol_0$", 1)).alias("scan_id"),
        size(1, "VolSizeX", F.lit(512)).alias("width"),
        size(2, "VolSizeY", F.lit(512)).alias("height"),
        size(3, "VolSizeZ", F.col("slices")).alias("depth"),
        *(F.coalesce(tag_number(t, f"VoxelSize{c}", "VoxelSize", "Spacing"), F.lit(0.16)).alias(f"s{c.lower()}") for c in "XYZ"),
        F.coalesce(tag_number(t, "VoxelValueMin", "ScalarMin", "Min"), F.lit(0.0)).alias("scalar_min"),
        F.coalesce(tag_number(t, "VoxelValueMax", "ScalarMax", "Max"), F.lit(4095.0)).alias("scalar_max"),
        F.coalesce("slices", F.lit(0)).alias("slices"),
        error.alias("error"),
    )


def slice_folder_slices(entries: DataFrame, headers: DataFrame) -> DataFrame:
    """Slice rows (folder, z, width, height, pixels) of the folders without error; a short slice is filled with 0."""
    num = F.regexp_extract("path", r"(?i)_vol_0_(\d+)$", 1)
    s = entries.where(F.col("path").rlike(r"(?i)_vol_0_\d+$")).select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), num.cast("long").alias("k"), "content")
    first = headers.where("error is null").select("folder", F.col("width").cast("long"), F.col("height").cast("long"))
    rows = s.join(first, "folder").withColumn("z", F.row_number().over(Window.partitionBy("folder").orderBy("k")).cast("long") - 1).drop("k")

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                n = r["width"] * r["height"] * 2
                data = gzip.decompress(r["content"])
                out.append({"folder": r["folder"], "z": r["z"], "width": r["width"], "height": r["height"], "pixels": data[: min(n, len(data) // 2 * 2)].ljust(n, b"\0")})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("folder", pa.string()), ("z", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("pixels", pa.binary())]))

    return rows.mapInArrow(run, "folder string, z long, width long, height long, pixels binary")


def _number(text: str, tag: str, other: float | None = None) -> float | None:
    m = re.search(rf'<{tag}[^>]*value="([^"]*)"', text, re.I) or re.search(rf"<{tag}[^>]*>(.*?)</{tag}>", text, re.I | re.S)
    try:
        return float(m[1].strip().replace(",", ".")) if m else other
    except ValueError:
        return other


def parse_single(data: bytes, constants: str | None = None) -> tuple[np.ndarray, dict]:
    """Voxels (z, y, x) and meta of a single-file volume; ``constants`` may crop it to a physical size."""
    at = 4 + len(MARKER)
    if data[4:at] != MARKER:
        raise ValueError("E_ONEVOLUME_HEADER")
    n = struct.unpack_from("<I", data, at)[0]
    text, at = data[at + 4 : at + 4 + n].decode("shift_jis", "replace"), at + 4 + n
    name_n = struct.unpack_from("<I", data, at)[0]
    if data[at + 4 : at + 4 + name_n] != ARRAY_NAME:
        raise ValueError("E_ONEVOLUME_ARRAY")
    at += 4 + name_n
    b = struct.unpack_from("<6i", data, at)
    full = [b[2 * k + 1] - b[2 * k] + 1 for k in range(3)]
    spacing = [_number(text, f"tf{c}GridSize", 0.16) for c in "XYZ"]
    slope, intercept = _number(text, "tfSystemV2HuSlope", 190.0), _number(text, "tfSystemV2HuIntercept", 0.0)
    raw = np.frombuffer(data, dtype="<i2", offset=at + 24)
    if len(raw) != full[0] * full[1] * full[2]:
        raise ValueError("E_ONEVOLUME_SIZE")
    size, off = list(full), [0, 0, 0]
    want = [_number(constants or "", t) for t in ("dXX", "dYY", "dZZ")]
    if all(w is not None for w in want):
        size = [max(1, min(f, int(np.floor(w / s + 0.5)))) for f, w, s in zip(full, want, spacing, strict=True)]
        off = [max(0, min(full[k] - size[k], max(0, -b[2 * k] - b[2 * k + 1]))) for k in range(3)]
    v = raw.reshape(full[0], full[1], full[2])[off[0] : off[0] + size[0], off[1] : off[1] + size[1], off[2] : off[2] + size[2]].transpose(2, 1, 0)
    hu = np.floor(v.astype(np.float64) * SCALE / slope + intercept * SCALE + 0.5).astype(np.int64)
    out = np.where(v == SENTINEL, SENTINEL, ((hu + 32768) % 65536) - 32768).astype("<i2")
    return out, {"sx": spacing[0], "sy": spacing[1], "sz": spacing[2], "slope": slope, "intercept": intercept}


def single_file_slices(files: DataFrame, constants: DataFrame | None = None) -> DataFrame:
    """Slice rows (folder, z, width, height, sx, sy, sz, pixels) of single-file volumes (path, content).

    ``constants`` (folder, xml) gives the physical size of a folder's volume, where it has one.
    """
    f = files.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), "content")
    f = f.withColumn("xml", F.lit(None).cast("string")) if constants is None else f.join(constants.select("folder", "xml"), "folder", "left")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                v, m = parse_single(r["content"], r["xml"])
                n = len(v)
                yield pa.RecordBatch.from_pydict({"folder": [r["folder"]] * n, "z": list(range(n)), "width": [v.shape[2]] * n, "height": [v.shape[1]] * n, **{c: [m[c]] * n for c in ("sx", "sy", "sz")}, "pixels": [x.tobytes() for x in v]})

    return f.select("folder", "content", "xml").mapInArrow(run, "folder string, z long, width long, height long, sx double, sy double, sz double, pixels binary")
