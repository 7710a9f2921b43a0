"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators.staging import fresh_path, linked_sets
from voxloom.operators.staging import written as stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, *frames: DataFrame) -> str:
    """``name``, or with underscores before it, so that no column of ``frames`` is called so (in any case of letters)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def free_prefix(prefix: str, *frames: DataFrame) -> str:
    """``prefix``, or with underscores before it, so that no column of ``frames`` begins with it."""
    while any(c.lower().startswith(prefix.lower()) for f in frames for c in f.columns):
        prefix = f"_{prefix}"
    return prefix


def map_columns(df: DataFrame, run, made: T.StructType) -> DataFrame:
    """``df.mapInArrow`` for columns of any names: ``run`` gets and gives batches by place; the result has the names of ``made``."""
    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    out = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(made)])

    def named(batches):
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=out.names)

    return plain.mapInArrow(named, out).toDF(*made.names)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def slices_by_bytes(col: pa.Array, limit: int = 4_000_000):
    """(start, length) runs of rows of at most ``limit`` bytes of text, or one longer row each."""
    if len(col) == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > start and total + n > limit:
            yield start, i - start
            start, total = i, 0
        total += n
    yield start, len(col) - start


def give_back() -> None:
    """Return freed memory to the system at the end of a task: Python workers are kept for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def split_words(text: pa.Array, sep: str = " "):
    """Split each text at ``sep``: (offsets of the texts in the words, codes of the words, distinct words).

    Null texts count as empty; an empty text has one empty word.
    """
    parts = pc.split_pattern(pc.fill_null(text, "").cast(pa.large_string()), sep)
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.flatten().dictionary_encode()
    return offsets - offsets[0], flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary.to_pylist()


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each begins (and the last ends); null is empty."""
    col = text.cast(pa.large_string())
    col = pc.fill_null(col, "") if col.null_count else col
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, dtype=np.int64)
    data = col.buffers()[2] if len(col) else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of(data: np.ndarray, first: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Codes and distinct values of the runs of bytes that begin where ``first`` is set; spaces are left out."""
    ends = np.flatnonzero(first[~space])
    data = data[~space]
    if not len(ends):
        return np.zeros(0, dtype=np.int64), []
    ends = np.append(ends, len(data)).astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    return runs.indices.to_numpy(zero_copy_only=False).astype(np.int64), runs.dictionary.to_pylist()


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words, as ASCII white space separates them: (offsets of the texts in the words, codes of the words, distinct words).

    No word is empty. The texts' bytes are cut where they lie; only the distinct words become Python strings.
    """
    raw, offsets = text_bytes(text)
    space = _SPACES[raw]
    first = word_starts(space, offsets)
    codes, words = runs_of(raw, first, space)
    return np.searchsorted(np.flatnonzero(first), offsets), codes, [w.decode() for w in words]


def word_starts(space: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks where words begin: bytes that are no space, after a space or at the begin of a text."""
    first = ~space
    first[1:] &= space[:-1]
    at = offsets[:-1][np.diff(offsets) > 0]
    first[at] = ~space[at]
    return first


def ragged_take(values: np.ndarray, starts: np.ndarray, lens: np.ndarray, codes: np.ndarray):
    """Concatenate the runs ``values[starts[c]:starts[c]+lens[c]]`` for c in codes; also their lengths."""
    n = lens[codes]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(starts[codes] - (ends - n), n)
    return values[at], n


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]], empty runs included."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (all arithmetic wraps)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


HOT = 1000  # a key with more than this part of all rows is joined by broadcast: at most so many are


def keyed_join(rows: DataFrame, keys: DataFrame, on: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``keys`` (unique in ``on``, null being a value; ``count`` says in how many rows each is).

    The most frequent keys are sent to every task, so no task gets all rows of one of them.
    """
    cols = [c for c in keys.columns if c != on]
    keys = keys.withColumnRenamed(on, "_on")
    total = keys.agg(F.sum(count)).head()[0] or 0
    hot, cold = keys.where(F.col(count) > total / HOT), keys.where(F.col(count) <= total / HOT)
    same = F.col(on).eqNullSafe(F.col("_on"))
    out = rows.join(F.broadcast(hot), same)
    if not is_empty(cold):
        out = out.unionByName(rows.join(F.broadcast(hot.select("_on")), same, "left_anti").join(cold, same))
    return out.select(*rows.columns, *cols)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b), component = smallest reachable id."""
    return linked_sets(edges).withColumnsRenamed({"node": "id", "root": "component"})
