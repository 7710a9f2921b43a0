"""Volume files as Spark data sources: ``spark.read.format("volume-dicom" | "volume-nifti" | "volume-raw").load(folder)``.

Partitions are groups of files of about ``partition_bytes`` bytes. Filters on ``path`` are pushed to the listing and those on ``z`` to the
slices that are read (with spark.sql.python.filterPushdown.enabled). With a schema without ``pixels``
(``spark.read.format(...).schema(headers_of("volume-nifti"))``) only headers are read, in ranges of bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxloom.sources import dicom, nifti

SLICES = "path string, z long, width long, height long, sx double, sy double, sz double, pixels binary, error string"
PARTITION = 64 << 20  # bytes of files in a partition
_TESTS = {
    EqualTo: lambda a, b: a == b,
    In: lambda a, b: a in b,
    StringStartsWith: lambda a, b: a.startswith(b),
    StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
    GreaterThan: lambda a, b: a > b,
    GreaterThanOrEqual: lambda a, b: a >= b,
    LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b,
}


@dataclass
class Files(InputPartition):
    """Files (path, bytes) of one partition."""

    files: list[tuple[str, int]] = field(default_factory=list)


class _Reader(DataSourceReader):
    """Lists the files below a folder, deals them out, and reads what is asked of each."""

    by_z = True

    def __init__(self, schema: StructType, options: dict[str, str], endings: tuple[str, ...]):
        self.schema, self.options, self.endings = schema, dict(options), endings
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if type(f) in _TESTS and (column == "path" or (column == "z" and self.by_z)):
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def passes(self, column: str, value) -> bool:
        return all(_TESTS[kind](value, want) for c, kind, want in self.tests if c == column)

    def _open(self):
        path = self.options["path"]
        return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")

    def partitions(self) -> list[Files]:
        fs, top = self._open()
        most, out, held = int(self.options.get("partition_bytes", PARTITION)), [Files()], 0
        for f in sorted(fs.get_file_info(pafs.FileSelector(top, recursive=True)), key=lambda f: f.path):
            if f.type != pafs.FileType.File or not f.path.lower().endswith(self.endings) or not self.passes("path", f.path):
                continue
            if held + f.size > most and out[-1].files:
                out.append(Files())
                held = 0
            out[-1].files.append((f.path, f.size))
            held += f.size
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = self._open()
        whole = "pixels" in self.schema.names
        shape = to_arrow_schema(self.schema)
        for path, size in partition.files:
            with fs.open_input_file(path) as f:
                try:
                    rows = list(self.rows(f, path, size, whole))
                except ValueError as e:
                    rows = [{"path": path, "error": str(e).partition(":")[0] if str(e).startswith("E_") else "E_FORMAT"}]
                    rows = [] if any(c == "z" for c, *_ in self.tests) else rows  # such a row has no z
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in self.schema.names} for r in rows], schema=shape)

    def rows(self, f, path: str, size: int, whole: bool) -> Iterator[dict]:
        raise NotImplementedError


class _DicomReader(_Reader):
    by_z = False

    def rows(self, f, path, size, whole):
        head = f.read_at(min(size, dicom.PREFIX), 0)
        row = dicom.parse_header(head, size)
        if "pixel_offset" not in row and size > len(head):  # a header longer than what was read
            row = dicom.parse_header(f.read_at(size, 0), size)
        if whole and row.get("error") is None:
            row["pixels"] = f.read_at(min(row["pixel_length"], size - row["pixel_offset"]), row["pixel_offset"])
        yield row | {"path": path}


class _NiftiReader(_Reader):
    def rows(self, f, path, size, whole):
        head = f.read_at(min(size, 64 << 10), 0)
        packed = head[:2] == b"\x1f\x8b"
        try:
            info = nifti.header(zlib.decompressobj(31).decompress(head, 352) if packed else head)
        except zlib.error as e:
            raise ValueError("E_FORMAT") from e
        w, h, d = info.shape
        base = {"path": path, "width": w, "height": h, **dict(zip(("sx", "sy", "sz"), info.spacing, strict=True))}
        wanted = [z for z in range(d) if self.passes("z", z)]
        voxels = nifti.parse(f.read_at(size, 0))[0] if packed and whole and wanted else None
        step = w * h * info.kind.itemsize
        for z in wanted:
            row = base | {"z": z}
            if voxels is not None:
                row["pixels"] = voxels[z].tobytes()
            elif whole:
                raw = f.read_at(step, info.offset + z * step)
                if len(raw) < step:
                    raise ValueError("E_TRUNCATED")
                row["pixels"] = info.scaled(raw).tobytes()
            elif not packed and info.offset + (z + 1) * step > size:
                raise ValueError("E_TRUNCATED")
            yield row


class _RawReader(_Reader):
    def rows(self, f, path, size, whole):
        w, h = int(self.options["width"]), int(self.options["height"])
        step = 2 * w * h
        if not size or size % step:
            raise ValueError("E_SIZE")
        s = [float(self.options.get(c, 1.0)) for c in ("sx", "sy", "sz")]
        for z in range(size // step):
            if self.passes("z", z):
                yield {"path": path, "z": z, "width": w, "height": h, "sx": s[0], "sy": s[1], "sz": s[2]} | ({"pixels": f.read_at(step, z * step)} if whole else {})


class _Volumes(DataSource):
    read_by: type = _Reader
    endings: tuple[str, ...] = ()
    columns = SLICES

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.read_by(schema, self.options, self.endings)


class DicomSource(_Volumes):
    """A row for each file: the header's fields, the pixels as they stand in the file, and why there are none."""

    read_by, endings = _DicomReader, (".dcm", ".dicom")
    columns = dicom.HEADER.replace(", error string", ", pixels binary, error string")

    @classmethod
    def name(cls) -> str:
        return "volume-dicom"


class NiftiSource(_Volumes):
    """A row for each slice, its voxels as 16-bit numbers; files that cannot be read have a row with an error and no z."""

    read_by, endings = _NiftiReader, (".nii", ".nii.gz")

    @classmethod
    def name(cls) -> str:
        return "volume-nifti"


class RawSource(_Volumes):
    """A row for each slice of files of 16-bit voxels; options width and height, and sx, sy, sz."""

    read_by, endings = _RawReader, (".raw", ".bin")

    @classmethod
    def name(cls) -> str:
        return "volume-raw"


SOURCES = (DicomSource, NiftiSource, RawSource)


def headers_of(name: str) -> str:
    """The columns of a source without the pixels."""
    columns = next(s.columns for s in SOURCES if s.name() == name)
    return ", ".join(c for c in columns.split(", ") if not c.startswith("pixels "))


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, and let filters be pushed to them."""
    for s in SOURCES:
        spark.dataSource.register(s)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
