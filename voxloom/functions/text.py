"""Names, paths, media types and report text as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Media types by file ending (fixed values).
MEDIA_TYPES = {
    ".dcm": "application/dicom",
    ".dicom": "application/dicom",
    ".gz": "application/gzip",
    ".mha": "application/vnd.metaimage",
    ".mhd": "application/vnd.metaimage",
    ".nhdr": "application/vnd.nrrd",
    ".nii": "application/vnd.nifti",
    ".nii.gz": "application/vnd.nifti",
    ".nrrd": "application/vnd.nrrd",
    ".stl": "model/stl",
    ".vti": "model/vnd.vtk.image",
    ".zip": "application/zip",
}


def normal_path(path: Column) -> Column:
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")


def extension(path: Column) -> Column:
    low = F.lower(path)
    dot = F.regexp_extract(low, r"(\.[^.]*)$", 1)
    return F.when(low.endswith(".nii.gz"), ".nii.gz").otherwise(dot)


def media_type(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MEDIA_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("application/octet-stream"))


@F.pandas_udf(T.StringType())
def _unaccented(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not "̀" <= c <= "ͯ"))


def file_stem(name: Column, fallback: str = "unnamed", plain: bool = False) -> Column:
    """A name without accents, signs that file systems refuse, and control characters.

    ``plain`` says that the names are ASCII, which keeps the work out of Python.
    """
    s = name if plain else _unaccented(name)
    s = F.regexp_replace(s, r'[<>:"/\\|?*]+', " ")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, r"[\x00-\x1f]", ""), r"\s+", " "))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def path_segment(name: Column, fallback: str = "unnamed", plain: bool = False) -> Column:
    return F.regexp_replace(file_stem(name, fallback, plain), r"[^A-Za-z0-9_\-]+", "_")


def url_filename(url: Column) -> Column:
    """Last path segment of a URL, null where there is none."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*", "")
    return F.nullif(F.regexp_extract(path, r"([^/]*)/*$", 1), F.lit(""))


def disposition_filename(header: Column) -> Column:
    """File name of a Content-Disposition header: the encoded form first, then the quoted or plain one."""
    star = F.nullif(F.regexp_extract(header, r"(?i)filename\*\s*=\s*(?:UTF-8'[^']*')?([^;]+)", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(header, r'(?i)filename\s*=\s*"?([^";]+)"?', 1), F.lit(""))
    return F.coalesce(F.try_url_decode(F.trim(star)), F.trim(plain))


def escape_html(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def csv_text(s: Column) -> Column:
    """Quoted cell with inner quotes as apostrophes."""
    return F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit("'")), F.lit('"'))


def volume_text(mm3: Column) -> Column:
    cm = F.format_string("%.2f cm³", mm3 / 1000)
    return F.when(mm3 >= 1000, cm).otherwise(F.concat(F.floor(mm3 + 0.5).cast("string"), F.lit(" mm³")))


def comma_number(s: Column) -> Column:
    return F.replace(s, F.lit(","), F.lit(".")).try_cast("double")


def number_list(s: Column) -> Column:
    """Backslash-separated decimal strings; what is not a finite number goes."""
    x = F.transform(F.split(s, r"\\"), lambda p: F.trim(p).try_cast("double"))
    return F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))


def voxel_text(voxels: Column, mm3_a_voxel: float) -> Column:
    """Count with thousands separators and volume, as a panel shows them."""
    mm3 = voxels * mm3_a_voxel
    size = F.when(mm3 >= 1000, F.format_string("%.2f cm3", (mm3 / 1000).cast("double"))).otherwise(F.concat(F.floor(mm3 + 0.5).cast("string"), F.lit(" mm3")))
    return F.when(F.coalesce(voxels, F.lit(0)) == 0, "0 voxels").otherwise(F.concat(F.format_number(voxels, 0), F.lit(" voxels · "), size))


def csv_value(text: Column, key: str) -> Column:
    """Number in the second cell of the first line that begins with a key; null if there is none. A decimal comma ends the cell."""
    cell = F.nullif(F.regexp_extract(text, rf"(?m)^{key},([^,\r\n]*)", 1), F.lit(""))
    return F.nullif(F.regexp_extract(cell, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1), F.lit("")).try_cast("double")
