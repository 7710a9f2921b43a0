"""DICOM series: headers of native little-endian files as rows, series by rules, slices by kernels.

Files of other encodings (compressed, big-endian, colour) are reported by code and never read as voxels.
"""

from __future__ import annotations

import struct
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.geometry import cross, minus, once, unit
from voxloom.functions.jsnum import clamp_int16, round_half_up

#: Explicit value representations with a 4-byte length (fixed values).
_LONG = frozenset(("OB", "OD", "OF", "OL", "OW", "SQ", "UC", "UN", "UR", "UT"))
#: Tags read, by column name.
_TEXT = {(0x0008, 0x0060): "modality", (0x0008, 0x103E): "description", (0x0010, 0x0020): "patient_id", (0x0020, 0x000D): "study_uid", (0x0020, 0x000E): "series_uid", (0x0028, 0x0004): "photometric", (0x0008, 0x0008): "image_type", (0x0008, 0x0016): "sop_class"}
_NUMBERS = {(0x0020, 0x0032): "ipp", (0x0020, 0x0037): "iop", (0x0028, 0x0030): "pixel_spacing", (0x0018, 0x1164): "imager_spacing", (0x0028, 0x1053): "slope", (0x0028, 0x1052): "intercept", (0x0020, 0x0013): "instance_number", (0x0018, 0x0050): "slice_thickness", (0x0018, 0x0088): "spacing_between", (0x0028, 0x0008): "frames"}
_SHORTS = {(0x0028, 0x0010): "rows", (0x0028, 0x0011): "columns", (0x0028, 0x0100): "bits_allocated", (0x0028, 0x0103): "pixel_representation", (0x0028, 0x0002): "samples"}
_PIXELS = (0x7FE0, 0x0010)
_PIXEL_TAG = struct.pack("<HH", *_PIXELS)
#: Sequences of frames' geometry, which are searched also where the encoding does not say that they are sequences.
_GROUPS = frozenset(((0x5200, 0x9229), (0x5200, 0x9230), (0x0020, 0x9113), (0x0020, 0x9116), (0x0028, 0x9110), (0x0028, 0x9145)))
_LISTS = ("ipp", "iop", "pixel_spacing", "imager_spacing")
IMPLICIT, EXPLICIT = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1"  # native little-endian encodings (fixed values)
PREFIX = 1 << 20  # bytes of a file that are read for its header
HEADER = (
    "path string, transfer_syntax string, modality string, description string, patient_id string, study_uid string, series_uid string, photometric string, image_type string, "
    "ipp array<double>, iop array<double>, pixel_spacing array<double>, imager_spacing array<double>, slope double, intercept double, instance_number double, slice_thickness double, "
    "sop_class string, spacing_between double, frames double, frame_positions array<array<double>>, "
    "rows long, columns long, bits_allocated long, pixel_representation long, samples long, pixel_offset long, pixel_length long, error string"
)


def _element(data: bytes, at: int, explicit: bool) -> tuple[tuple[int, int], int, int]:
    """Tag, start and length (-1: undefined) of the value of the element at ``at``."""
    tag = struct.unpack_from("<HH", data, at)
    if explicit and tag[0] != 0xFFFE:
        vr = data[at + 4 : at + 6].decode("latin-1")
        if vr in _LONG:
            n, start = struct.unpack_from("<I", data, at + 8)[0], at + 12
        else:
            n, start = struct.unpack_from("<H", data, at + 6)[0], at + 8
    else:
        n, start = struct.unpack_from("<I", data, at + 4)[0], at + 8
    return tag, start, -1 if n == 0xFFFFFFFF else n


def _after_sequence(data: bytes, at: int, explicit: bool) -> int:
    """Where a sequence or item of undefined length that starts at ``at`` ends."""
    while at + 8 <= len(data):
        tag, start, n = _element(data, at, explicit)
        if tag in ((0xFFFE, 0xE0DD), (0xFFFE, 0xE00D)):
            return start
        at = _after_sequence(data, start, explicit) if n < 0 else start + n
    return len(data)


def _numbers(raw: bytes) -> list[float]:
    out = []
    for p in raw.decode("latin-1").split("\\"):
        try:
            x = float(p.strip("\0 "))
        except ValueError:
            continue
        if np.isfinite(x):
            out.append(x)
    return out


def _nested(data: bytes, at: int, end: int, explicit: bool, found: dict[str, list]) -> None:
    """Geometry and scaling of the items of a sequence, every occurrence in order."""
    while at + 8 <= end:
        tag, start, n = _element(data, at, explicit)
        stop = (_after_sequence(data, start, explicit) if n < 0 else start + n) if tag[0] != 0xFFFE else start
        if tag in _NUMBERS:
            found.setdefault(_NUMBERS[tag], []).append(_numbers(data[start:stop]))
        elif tag[0] != 0xFFFE and (n < 0 or tag in _GROUPS or (explicit and data[at + 4 : at + 6] == b"SQ")):
            _nested(data, start, min(stop, end), explicit, found)
        at = stop


def parse_header(data: bytes, size: int | None = None) -> dict:
    """Fields of one file up to its pixels; ``error`` says why there are none, or why they are no native voxels.

    ``data`` may be the first bytes of a file of ``size`` bytes. Of a file with several frames the geometry in
    its sequences counts where the file itself has none, and ``frame_positions`` has that of each frame.
    """
    if data[128:132] != b"DICM":
        return {"error": "E_FORMAT"}
    size = len(data) if size is None else size
    at, syntax, out, nested = 132, IMPLICIT, {}, {}
    try:
        while at + 8 <= len(data):
            explicit = struct.unpack_from("<H", data, at)[0] == 2 or syntax != IMPLICIT
            tag, start, n = _element(data, at, explicit)
            if tag == _PIXELS:
                out |= {"pixel_offset": start, "pixel_length": size - start if n < 0 else n}
                break
            stop = _after_sequence(data, start, explicit) if n < 0 else start + n
            if n < 0 or tag in _GROUPS or (explicit and data[at + 4 : at + 6] == b"SQ"):
                _nested(data, start, stop, explicit, nested)
                at = stop
                continue
            raw = data[start:stop]
            if tag == (0x0002, 0x0010):
                syntax = raw.decode("latin-1").strip("\0 ")
            elif tag in _TEXT:
                out[_TEXT[tag]] = raw.decode("utf-8", "replace").strip("\0 ")
            elif tag in _SHORTS and n >= 2:
                out[_SHORTS[tag]] = struct.unpack_from("<H", raw)[0]
            elif tag in _NUMBERS:
                v = _numbers(raw)
                out[_NUMBERS[tag]] = v if _NUMBERS[tag] in _LISTS else (v[0] if v else None)
            at = stop
    except struct.error:
        out["error"] = "E_DICOM_TRUNCATED"
    out["transfer_syntax"] = syntax
    frames = int(out.get("frames") or 1)
    if frames > 1:
        for name, values in nested.items():
            good = [v for v in values if v]
            if good and not out.get(name):
                out[name] = good[0] if name in _LISTS else good[0][0]
        out["frame_positions"] = [v for v in nested.get("ipp", []) if len(v) == 3]
    if not out.get("slope"):
        out["slope"] = 1.0
    spacing = [s for s in (out.get("pixel_spacing"), out.get("imager_spacing")) if s and len(s) == 2 and min(s) > 0]
    if spacing:
        out["pixel_spacing"] = spacing[0]
    if "error" not in out:
        out["error"] = _refused(out, spacing, frames, size)
    return out


def _refused(h: dict, spacing: list, frames: int, size: int) -> str | None:
    """Why a header's pixels cannot be read as native voxels."""
    if h["transfer_syntax"] not in (IMPLICIT, EXPLICIT):
        return "E_DICOM_SYNTAX"
    if h.get("samples", 1) != 1 or h.get("photometric") not in (None, "", "MONOCHROME1", "MONOCHROME2"):
        return "E_DICOM_COLOR"
    if not (h.get("rows") and h.get("columns") and spacing and len(h.get("ipp") or ()) == 3 and len(h.get("iop") or ()) == 6):
        return "E_DICOM_HEADER"
    if h.get("bits_allocated", 16) != 16:
        return "E_DICOM_BITS"
    need = h["rows"] * h["columns"] * frames * 2
    if "pixel_offset" not in h or h["pixel_length"] < need or h["pixel_offset"] + need > size:
        return "E_DICOM_TRUNCATED"
    return None


def read_headers(files: DataFrame, prefix: int = PREFIX) -> DataFrame:
    """Header rows of ``files`` (path, content): the first ``prefix`` bytes of each file go to Python, a batch of rows at once.

    A file whose pixels do not begin there (their tag is not among these bytes) goes whole. If only a picture inside the header has
    the tag there, the error is E_DICOM_PREFIX: read such a file again with a larger ``prefix``.
    """
    names = [c.split()[0] for c in HEADER.split(", ")]

    def run(batches):
        for b in batches:
            rows = [{"path": p} | parse_header(c or b"", n or 0) for p, c, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
            for r, c, n in zip(rows, b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if "pixel_offset" not in r and c is not None and len(c) < n and r["error"] != "E_FORMAT":
                    r["error"] = "E_DICOM_PREFIX"
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=_ARROW)

    begin = F.substring("content", 1, prefix)
    head = F.when(F.contains(begin, F.lit(_PIXEL_TAG)), begin).otherwise(F.col("content"))
    return files.select("path", head, F.length("content")).mapInArrow(run, HEADER)


_KIND = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
_ARROW = pa.schema([(c.split()[0], _KIND[c.split()[1]]) for c in HEADER.split(", ")])


def is_native(headers: DataFrame) -> DataFrame:
    """Headers of native little-endian monochrome pixels."""
    one = F.coalesce("samples", F.lit(1)) == 1
    gray = F.coalesce("photometric", F.lit("")).isin("", "MONOCHROME1", "MONOCHROME2")
    return headers.where(F.col("transfer_syntax").isin(IMPLICIT, EXPLICIT) & one & gray)


def by_magic(entries: DataFrame) -> DataFrame:
    """Entries (path, content) that are DICOM by their ending or by their content."""
    return entries.where(F.lower("path").rlike(r"\.(dcm|dicom)$") | (F.substring("content", 129, 4) == F.lit(b"DICM")))


def patient_axes(iop: Column) -> dict[str, Column]:
    """Patient left, anterior and superior along a volume's columns, rows and slices; the usual axes without an orientation."""
    pair = F.struct(unit(F.slice(iop, 1, 3)).alias("row"), unit(F.slice(iop, 4, 3)).alias("col"))
    axes = once(pair, lambda p: F.array(p["row"], p["col"], unit(cross(p["row"], p["col"]))))
    there = F.coalesce((F.size(iop) >= 6) & F.exists(iop, lambda v: v != 0), F.lit(False))
    axis = lambda k, sign: F.transform(axes, lambda v: v[k] * sign)
    usual = {"left": (0, 1.0, (1.0, 0.0, 0.0)), "anterior": (1, -1.0, (0.0, -1.0, 0.0)), "superior": (2, 1.0, (0.0, 0.0, 1.0))}
    return {name: F.when(there, axis(k, sign)).otherwise(F.array(*map(F.lit, plain))) for name, (k, sign, plain) in usual.items()}


_ORDERS = list(permutations(range(3)))


def axis_map(directions: list[Column]) -> Column:
    """For three source directions the volume axis of each (the best of six orders, the first on ties) and whether it runs along it."""

    def mapped(p: Column) -> Column:
        d = [p[k] for k in range(3)]
        scored = F.array(*(F.struct(sum((F.abs(v[a]) for v, a in zip(d[1:], order[1:], strict=True)), F.abs(d[0][order[0]])).alias("score"), F.lit(-k).alias("first"), F.array(*map(F.lit, order)).alias("axes")) for k, order in enumerate(_ORDERS)))
        signs = lambda axes: F.array(*(F.when(F.element_at(v, axes[k] + 1) < 0, -1).otherwise(1) for k, v in enumerate(d)))
        return once(F.array_max(scored)["axes"], lambda axes: F.struct(axes.alias("axes"), signs(axes).alias("signs")))

    return once(F.array(*directions), mapped)


def frame_candidates(headers: DataFrame) -> DataFrame:
    """Multi-frame files that hold a volume, with ``source`` and ``dims`` (sizes before and after the axes are mapped), ``map`` and ``rank``.

    Rank 1 is the one to take: among those that are no localizers first, the largest, axial ones before others.
    """
    frames = F.col("frames").cast("long")
    row, col = unit(F.slice("iop", 1, 3)), unit(F.slice("iop", 4, 3))
    p = F.col("frame_positions")
    third = F.when(F.size(p) > 1, unit(minus(p[1], p[0]))).otherwise(unit(cross(row, col)))
    native = is_native(headers).where(F.col("error").isNull() & (frames > 1) & (F.col("pixel_length") == F.col("rows") * F.col("columns") * frames * 2))
    c = native.withColumn("source", F.array("columns", "rows", frames)).withColumn("map", axis_map([row, col, third]))
    dims = F.array(*(F.element_at("source", F.array_position("map.axes", k).cast("int")) for k in range(3)))
    label = F.coalesce(F.nullif(F.trim("description"), F.lit("")), F.regexp_extract("path", r"([^/]*)$", 1))
    c = c.withColumns({"dims": dims, "label": label, "voxels": F.col("rows") * F.col("columns") * frames})
    local, axial = F.lower("label").contains("localizer"), F.col("label").rlike(r"(?i)(^|[_\W])(tra|ax|axial)([_\W]|$)")
    by = Window.partitionBy("patient_id", "study_uid").orderBy(F.desc(axial), local, F.desc("voxels"), "path")
    return c.withColumn("rank", F.row_number().over(by))


def frame_voxels(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Voxels (path, i, x, y, z, v) of multi-frame files: a row for each frame goes to Python, with its axes mapped."""
    size = F.col("rows") * F.col("columns") * 2
    rows = candidates.select("path", "source", "dims", "map", "rows", "columns", "pixel_representation", "pixel_offset", "slope", F.coalesce("intercept", F.lit(0.0)).alias("intercept"))
    rows = rows.join(files.select("path", "content"), "path").withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("source")[2] - 1)))
    pixels = F.substr("content", (F.col("pixel_offset") + F.col("frame") * size + 1).cast("int"), size.cast("int"))
    rows = rows.select("path", "source", "dims", "map.axes", "map.signs", "pixel_representation", "slope", "intercept", "frame", pixels.alias("pixels"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                w, h, _ = r["source"]
                raw = np.frombuffer(r["pixels"], dtype="<i2" if r["pixel_representation"] else "<u2")
                v = np.floor(raw * r["slope"] + r["intercept"] + 0.5).astype(np.int64)
                k = np.arange(len(v))
                at = [None] * 3
                for place, axis, sign, n in zip((k % w, k // w, np.full(len(v), r["frame"])), r["axes"], r["signs"], r["source"], strict=True):
                    at[axis] = place if sign > 0 else n - 1 - place
                x, y, z = at
                yield pa.RecordBatch.from_pydict({"path": pa.array([r["path"]] * len(v), pa.string()), "i": (z * r["dims"][1] + y) * r["dims"][0] + x, "x": x, "y": y, "z": z, "v": ((v + 32768) % 65536) - 32768})

    return rows.mapInArrow(run, "path string, i long, x long, y long, z long, v long")


def oriented(headers: DataFrame) -> DataFrame:
    """Usable ``headers`` with location along the slice normal and an orientation name."""
    a = F.col("iop")
    n = [a[1] * a[5] - a[2] * a[4], a[2] * a[3] - a[0] * a[5], a[0] * a[4] - a[1] * a[3]]
    loc = sum((F.col("ipp")[k] * n[k] for k in (1, 2)), F.col("ipp")[0] * n[0])
    most = F.greatest(*(F.abs(c) for c in n))
    name = F.when(most < 0.75, "oblique").when(F.abs(n[2]) == most, "axial").when(F.abs(n[1]) == most, "coronal").otherwise("sagittal")
    return headers.where("error is null and coalesce(frames, 1) <= 1").withColumns({"location": loc, "orientation": name})


def series(headers: DataFrame) -> DataFrame:
    """Slices in order: volume key, z and duplicates removed; one row a file that counts.

    Files of one series, orientation and pixel format make a volume; of files at one position (4 decimals)
    the first by path stays.
    """
    key = F.concat_ws("|", "patient_id", "study_uid", "series_uid", "orientation", "rows", "columns", "bits_allocated", "pixel_representation")
    o = oriented(headers).withColumn("volume", key)
    place = F.concat_ws(",", *(F.format_number(F.col("ipp")[k], 4) for k in range(3)))
    first = Window.partitionBy("volume", place).orderBy("path")
    copies = F.count(F.lit(1)).over(Window.partitionBy("volume"))
    o = o.withColumns({"_rank": F.row_number().over(first), "_all": copies}).where("_rank = 1")
    order = Window.partitionBy("volume").orderBy(F.round("location", 6), F.coalesce("instance_number", F.lit(0.0)), "path")
    whole = Window.partitionBy("volume")
    o = o.withColumns({"z": F.row_number().over(order) - 1, "duplicates": F.col("_all") - F.count(F.lit(1)).over(whole)})
    return o.drop("_rank", "_all")


def assemble(ordered: DataFrame, files: DataFrame) -> DataFrame:
    """Slice rows (volume, z, width, height, pixels) of native 16-bit slices.

    Values are scaled by the first slice's slope and intercept, rounded half up and wrapped to 16 bits.
    """
    w = Window.partitionBy("volume").orderBy("z")
    o = ordered.select("volume", "z", "path", "rows", "columns", "pixel_representation", "pixel_offset", F.first("slope").over(w).alias("slope"), F.first("intercept").over(w).alias("intercept"))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                n = r["rows"] * r["columns"]
                raw = np.frombuffer(r["content"], dtype="<i2" if r["pixel_representation"] else "<u2", count=n, offset=r["pixel_offset"])
                v = np.floor(raw * r["slope"] + (r["intercept"] or 0.0) + 0.5).astype(np.int64)
                out.append({"volume": r["volume"], "z": r["z"], "width": r["columns"], "height": r["rows"], "pixels": (((v + 32768) % 65536) - 32768).astype("<i2").tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("volume", pa.string()), ("z", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("pixels", pa.binary())]))

    rows = o.join(files.select("path", "content"), "path").withColumn("z", F.col("z").cast("long"))
    return rows.mapInArrow(run, "volume string, z long, width long, height long, pixels binary")


def rescaled(raw, slope, intercept):
    """The same scaling as a column."""
    return round_half_up(raw * slope + intercept)


def rescaled_half_even(raw: Column, slope: Column | float, intercept: Column | float) -> Column:
    """The scaling of offline builders: halves to the even neighbour, values cut to 16 bits."""
    return clamp_int16(F.rint(raw * slope + intercept))
