"""From entries of folders, archives and uploads to volumes: formats are looked up by name and can be added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.text import extension
from voxloom.sources import dicom, nifti
from voxloom.sources.files import ENTRY, expand_zips, folder_formats

#: Reader of each format: entries (path, content) -> rows of its volumes.
FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_format(name: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    FORMATS[name] = reader


def expanded(sources: DataFrame, depth: int = 2) -> DataFrame:
    """Entries (path, content, source) of a tree of sources: archives are opened, and archives in them, ``depth`` levels deep."""
    out, level = None, sources.select("path", "content", F.col("path").alias("source"))
    for k in range(depth + 1):
        is_zip = extension(F.col("path")) == ".zip"
        flat = level.where(~is_zip) if k < depth else level
        out = flat if out is None else out.unionByName(flat)
        if k < depth:
            inner = expand_zips(level.where(is_zip).select("path", "content"))
            level = inner.select("path", "content", F.substring_index("path", "/", 1).alias("source"))
    return out


def read_format(entries: DataFrame, name: str) -> DataFrame:
    """Volumes of the folders of one format, by its reader."""
    if name not in FORMATS:
        raise ValueError(f"no reader of {name}: {sorted(FORMATS)}")
    folders = folder_formats(entries).where(F.col("format") == name).select("folder")
    found = entries.withColumn("folder", F.regexp_replace("path", r"/[^/]*$", ""))
    return FORMATS[name](found.join(folders, "folder", "left_semi").select("path", "content"))


def _dicom_slices(entries: DataFrame) -> DataFrame:
    return dicom.assemble(dicom.series(dicom.read_headers(entries)), entries)


register_format("dicom", _dicom_slices)
register_format("nifti", nifti.read)

__all__ = ["ENTRY", "FORMATS", "expanded", "read_format", "register_format"]
