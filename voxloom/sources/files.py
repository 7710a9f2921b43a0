"""Scan folders as tables of files: listing, format detection, archives, and slices as voxels."""

from __future__ import annotations

import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.text import extension, media_type, normal_path

ENTRY = "path string, content binary"


def scan_folder(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, content) of all files below a folder; the content is read only where it is used."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    r = r.option("pathGlobFilter", glob) if glob else r
    return r.load(path).select("path", "length", "content")


def described(entries: DataFrame) -> DataFrame:
    """``entries`` (path, content) with folder, ext, media and the magic of the content."""
    head = lambda s, n: F.substring("content", s, n)
    magic = (
        F.when(head(129, 4) == F.lit(b"DICM"), "dicom")
        .when(head(1, 4) == F.lit(b"PK\x03\x04"), "zip")
        .when(head(1, 2) == F.lit(b"\x1f\x8b"), "gzip")
    )
    return entries.withColumns({"folder": F.regexp_replace("path", r"/[^/]*$", ""), "ext": extension(F.col("path")), "media": media_type(F.col("path")), "magic": magic})


def folder_formats(entries: DataFrame) -> DataFrame:
    """(folder, format): the first that fits of a reconstruction with one header, a DICOM series, a single-file volume."""
    d = entries.withColumns({"folder": F.regexp_replace("path", r"/[^/]*$", ""), "name": F.lower(F.regexp_extract("path", r"([^/]*)$", 1))})
    n = d.groupBy("folder").agg(
        F.count_if(F.col("name").rlike(r"_vol_0$")).alias("headers"),
        F.count_if(F.col("name").rlike(r"_vol_0_\d+$")).alias("slices"),
        F.count_if(F.col("name").rlike(r"\.(dcm|dicom)$")).alias("dicoms"),
        F.count_if(F.col("name") == "ct_0.vol").alias("vols"),
    )
    kind = F.when((F.col("headers") == 1) & (F.col("slices") >= 1), "galileos").when(F.col("dicoms") >= 2, "dicom").when(F.col("vols") == 1, "onevolume")
    return n.select("folder", kind.alias("format")).where("format is not null")


def expand_zips(entries: DataFrame, errors: bool = False) -> DataFrame:
    """Files inside the archives of ``entries`` (path, content), under the archive's name without its ending; one level.

    An archive that cannot be read gives no files; with ``errors`` it gives a row of its path, without content, with error E_ARCHIVE.
    """

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                        for i in z.infolist():
                            if not i.is_dir():
                                yield row(f"{path.removesuffix('.zip')}/{i.filename}", z.read(i), None)
                except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
                    if errors:
                        yield row(path, None, "E_ARCHIVE")

    def row(path: str, content: bytes | None, error: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary()), pa.array([error], pa.string())], names=["path", "content", "error"])

    found = entries.where("content is not null").select("path", "content").mapInArrow(run, f"{ENTRY}, error string").withColumn("path", normal_path(F.col("path")))
    return found if errors else found.drop("error")


def voxels_of_slices(slices: DataFrame) -> DataFrame:
    """``voxels(volume_id, i, x, y, z, v)`` of slice rows (volume_id, z, width, height, pixels: little-endian int16); rows of errors have none."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                v = np.frombuffer(r["pixels"], dtype="<i2").astype(np.int64)
                k = np.arange(len(v))
                yield pa.RecordBatch.from_pydict({"volume_id": np.full(len(v), r["volume_id"]), "i": r["z"] * r["width"] * r["height"] + k, "x": k % r["width"], "y": k // r["width"], "z": np.full(len(v), r["z"]), "v": v})

    return slices.where("pixels is not null").select("volume_id", "z", "width", "height", "pixels").mapInArrow(run, "volume_id long, i long, x long, y long, z long, v long")


def slices_of_voxels(vox: DataFrame, width: int, height: int) -> DataFrame:
    """Slice rows of a dense voxel table; one task packs one slice."""

    def run(group: pa.Table) -> pa.Table:
        out = np.zeros(width * height, dtype="<i2")
        out[group.column("y").to_numpy() * width + group.column("x").to_numpy()] = group.column("v").to_numpy()
        return pa.table({"volume_id": group.column("volume_id")[:1], "z": group.column("z")[:1], "width": [width], "height": [height], "pixels": pa.array([out.tobytes()], pa.binary())})

    rows = vox.select(*(F.col(c).cast("long") for c in ("volume_id", "z", "y", "x", "v")))
    return rows.groupBy("volume_id", "z").applyInArrow(run, "volume_id long, z long, width long, height long, pixels binary")


def raw_volume(manifest: DataFrame, blobs: DataFrame) -> DataFrame:
    """Slice rows of raw int16 volumes: manifest (volume_id, width, height, depth), blobs (volume_id, content); with ``error``.

    A content whose size is not width x height x depth x 2 has one row with error E_SIZE, without z and pixels.
    """
    size = F.col("width") * F.col("height") * 2
    m = manifest.join(blobs, "volume_id").withColumn("_ok", F.coalesce(F.length("content") == size * F.col("depth"), F.lit(False)) & (F.col("depth") > 0))
    m = m.withColumn("z", F.explode(F.when(F.col("_ok"), F.sequence(F.lit(0).cast("long"), F.col("depth").cast("long") - 1)).otherwise(F.array(F.lit(None).cast("long")))))
    pixels = F.when(F.col("_ok"), F.substr("content", (F.col("z") * size + 1).cast("int"), size.cast("int")))
    return m.select("volume_id", "z", "width", "height", pixels.alias("pixels"), F.when(~F.col("_ok"), "E_SIZE").alias("error"))
