"""NIfTI-1 volumes as slice rows."""

from __future__ import annotations

import gzip
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Voxel types by code (fixed values).
_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


class Header(NamedTuple):
    """Size (x, y, z), spacing, voxel type, place of the voxels and their scaling."""

    shape: tuple[int, int, int]
    spacing: tuple[float, ...]
    kind: np.dtype
    offset: int
    slope: float
    inter: float

    def scaled(self, raw: bytes) -> np.ndarray:
        v = np.floor(np.nan_to_num(np.frombuffer(raw, dtype=self.kind).astype(np.float64) * self.slope + self.inter) + 0.5)
        return np.clip(v, -32768, 32767).astype("<i2")


def header(data: bytes) -> Header:
    """The header at the start of an unpacked file; a ValueError of code E_FORMAT says why there is none."""
    if len(data) < 120:
        raise ValueError("E_FORMAT: no NIfTI-1 header")
    end = "<" if struct.unpack_from("<i", data)[0] == 348 else ">"
    if struct.unpack_from(f"{end}i", data)[0] != 348:
        raise ValueError("E_FORMAT: no NIfTI-1 header")
    dim = struct.unpack_from(f"{end}8h", data, 40)
    kind = struct.unpack_from(f"{end}h", data, 70)[0]
    spacing = struct.unpack_from(f"{end}8f", data, 76)[1:4]
    offset, slope, inter = struct.unpack_from(f"{end}3f", data, 108)
    if kind not in _TYPES:
        raise ValueError(f"E_FORMAT: voxel type {kind}")
    if not np.isfinite(slope) or slope == 0:
        slope = 1.0
    size = tuple(max(1, n) for n in dim[1:4])
    return Header(size, tuple(float(abs(s)) or 1.0 for s in spacing), np.dtype(end + _TYPES[kind]), int(offset), slope, inter if np.isfinite(inter) else 0.0)


def parse(data: bytes) -> tuple[np.ndarray, tuple[float, ...]]:
    """Clamped 16-bit voxels (z, y, x) and spacing of the first volume of a file, plain or gzipped."""
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError, zlib.error) as e:
            raise ValueError("E_FORMAT: no gzip file") from e
    h = header(data)
    w, n, d = h.shape
    raw = data[h.offset : h.offset + w * n * d * h.kind.itemsize]
    if len(raw) < w * n * d * h.kind.itemsize:
        raise ValueError("E_TRUNCATED: voxels are missing")
    return h.scaled(raw).reshape(d, n, w), h.spacing


SLICE = "path string, z long, width long, height long, sx double, sy double, sz double, pixels binary, error string"


def read(files: DataFrame) -> DataFrame:
    """(path, z, width, height, sx, sy, sz, pixels, error) of ``files`` (path, content).

    A file that cannot be read has one row with its error, ``E_FORMAT`` or ``E_TRUNCATED``, and nothing but its path besides.
    """
    names = [c.split()[0] for c in SLICE.split(", ")]
    kinds = {"path": pa.string(), "pixels": pa.binary(), "error": pa.string(), "sx": pa.float64(), "sy": pa.float64(), "sz": pa.float64()}
    schema = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                try:
                    v, s = parse(r["content"] or b"")
                    rows = [dict(zip(names, (r["path"], z, v.shape[2], v.shape[1], *s, x.tobytes(), None), strict=True)) for z, x in enumerate(v)]
                except ValueError as e:
                    rows = [{"path": r["path"], "error": str(e).partition(":")[0]}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, SLICE)
