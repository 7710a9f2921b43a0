"""Sliding-window models: windows over volumes, a pluggable model on patches, and merging."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.masks import component_roots, remove_small
from voxloom.operators.staging import written
from voxloom.operators.voxels import Grid, crop, ct_normalize, resample_linear, resample_nearest, zscore


def window_starts(size: Column, window: int, overlap: float) -> Column:
    """Array of starts of windows along an axis; the last one ends with the axis."""
    step = max(1, int(window * (1 - overlap)))
    last = F.greatest(F.lit(0), F.ceil((size - window) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.greatest(F.lit(0), F.least(k * step, (size - window).cast("int"))))


def starts(size: int, window: int, overlap: float) -> list[int]:
    if size <= window:
        return [0]
    step = max(1, int(window * (1 - overlap)))
    return [min(k * step, size - window) for k in range(-(-(size - window) // step) + 1)]


def _mirror(i: np.ndarray, n: int) -> np.ndarray:
    if n == 1:
        return np.zeros_like(i)
    m = np.mod(i, 2 * (n - 1))
    return np.where(m < n, m, 2 * (n - 1) - m)


@dataclass(frozen=True)
class _Axis:
    """An axis of ``size`` voxels and its windows, without a list of them."""

    size: int
    window: int
    overlap: float

    @property
    def step(self) -> int:
        return max(1, int(self.window * (1 - self.overlap)))

    @property
    def last(self) -> int:
        return max(0, -(-(self.size - self.window) // self.step))

    @property
    def count(self) -> int:
        return self.last + 1

    def start(self, k: int) -> int:
        return max(0, min(k * self.step, self.size - self.window))

    def dealt(self, rows: DataFrame, c: str) -> DataFrame:
        """``rows`` once for each window that holds their place along ``c``: its number ``_k`` and the place in it, ``_o``."""
        if self.size < self.window:  # one window, with mirror images: a literal map of at most its size
            src = _mirror(np.arange(self.window) - (self.window - self.size) // 2, self.size)
            lookup = rows.sparkSession.createDataFrame([(int(i), 0, o) for o, i in enumerate(src)], f"{c} long, _k{c} int, _o{c} int")
            return rows.join(F.broadcast(lookup), c)
        # the windows that hold a place stand in a row; the last one ends with the axis
        at, end = F.col(c).cast("long"), self.size - self.window
        first = F.least(F.lit(self.last), F.greatest(F.lit(0), F.floor((at - self.window) / self.step) + 1))
        final = F.when(at >= end, self.last).otherwise(F.least(F.lit(self.last - 1), F.floor(at / self.step)))
        held = rows.where(at.between(0, self.size - 1) & (first <= final))
        held = held.withColumn(f"_k{c}", F.explode(F.sequence(first.cast("long"), final.cast("long"))))
        return held.withColumn(f"_o{c}", at - F.least(F.col(f"_k{c}") * self.step, F.lit(end)))


def patches(vox: DataFrame, grid: Grid, window: tuple[int, int, int], overlap: float, value: str = "v") -> DataFrame:
    """(volume_id, w, z0, y0, x0, data, held): float32 patches in z, y, x order, mirrored beyond the volume.

    A voxel is sent to each window that holds it or a mirror image of it, and each window is put
    together by one task; ``w`` is the windows' order. Voxels without a row are 0 in ``data``, and the
    bits of ``held`` tell the others.
    """
    dims, names = (grid.depth, grid.height, grid.width), ("z", "y", "x")
    axes = [_Axis(n, w, overlap) for n, w in zip(dims, window, strict=True)]
    rows = vox.select("volume_id", *names, F.col(value).cast("double").alias("v"))
    for c, axis in zip(names, axes, strict=True):
        rows = axis.dealt(rows, c)
    index = (F.col("_oz") * window[1] + F.col("_oy")) * window[2] + F.col("_ox")
    number = (F.col("_kz").cast("long") * axes[1].count + F.col("_ky")) * axes[2].count + F.col("_kx")
    cells = int(np.prod(window))

    def build(group: pa.Table) -> pa.Table:
        data = np.zeros(cells, dtype=np.float32)
        at = group.column("at").to_numpy()
        data[at] = group.column("v").to_numpy()
        held = np.zeros(cells, dtype=bool)
        held[at] = True
        w = group.column("w")[0].as_py()
        k = [w // (axes[1].count * axes[2].count), w // axes[2].count % axes[1].count, w % axes[2].count]
        return pa.table({"volume_id": [group.column("volume_id")[0].as_py()], "w": [w], **{f"{c}0": [a.start(n)] for c, a, n in zip(names, axes, k, strict=True)}, "data": pa.array([data.tobytes()], pa.binary()), "held": pa.array([np.packbits(held).tobytes()], pa.binary())})

    rows = rows.select("volume_id", number.cast("long").alias("w"), index.cast("long").alias("at"), "v")
    return rows.groupBy("volume_id", "w").applyInArrow(build, "volume_id long, w long, z0 long, y0 long, x0 long, data binary, held binary")


def _run_model(pieces: DataFrame, window, grid: Grid, model: Callable, per_voxel, schema: str) -> DataFrame:
    dims = (grid.depth, grid.height, grid.width)
    pad = [(max(n, w) - n) // 2 for n, w in zip(dims, window, strict=True)]

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                logits = np.asarray(model(np.frombuffer(r["data"], dtype=np.float32).reshape(window), window), dtype=np.float64)
                z, y, x = np.meshgrid(*(np.arange(n) + r[c] - p for n, c, p in zip(window, ("z0", "y0", "x0"), pad, strict=True)), indexing="ij")
                held = np.unpackbits(np.frombuffer(r["held"], dtype=np.uint8), count=int(np.prod(window))).reshape(window).astype(bool)
                keep = held & (z >= 0) & (z < dims[0]) & (y >= 0) & (y < dims[1]) & (x >= 0) & (x < dims[2])
                out = per_voxel(logits)
                yield pa.RecordBatch.from_pydict({"volume_id": np.full(int(keep.sum()), r["volume_id"]), "w": np.full(int(keep.sum()), r["w"]), "i": ((z * dims[1] + y) * dims[2] + x)[keep]} | {k: v[keep] for k, v in out.items()})

    return pieces.mapInArrow(run, schema)


def segment_argmax(vox: DataFrame, grid: Grid, model: Callable, window: tuple[int, int, int], overlap: float = 0.5, value: str = "v") -> DataFrame:
    """(volume_id, i, label, prob): the label of the most confident window, the first one on ties.

    ``model(patch, window)`` gives logits of shape (classes, z, y, x). Voxels without a row get none.
    """

    def best(logits):
        top = logits.max(axis=0)
        return {"label": logits.argmax(axis=0).astype(np.int64), "prob": (1 / np.exp(logits - top).sum(axis=0)).astype(np.float32).astype(np.float64)}

    rows = _run_model(patches(vox, grid, window, overlap, value), window, grid, model, best, "volume_id long, w long, i long, label long, prob double")
    # a window's result competes before it is shuffled: highest probability, then earliest window
    pick = F.max(F.struct("prob", (-F.col("w")).alias("first"), "label"))
    return rows.groupBy("volume_id", "i").agg(pick.alias("b")).select("volume_id", "i", F.col("b.label").alias("label"), F.col("b.prob").alias("prob"))


def segment_mean(vox: DataFrame, grid: Grid, model: Callable, window: tuple[int, int, int], overlap: float = 0.25, value: str = "v") -> DataFrame:
    """(volume_id, i, prob) of voxels whose mean foreground probability over windows exceeds one half."""

    def front(logits):
        return {"p": 1 / (1 + np.exp(logits[0] - logits[1]))}

    rows = _run_model(patches(vox, grid, window, overlap, value), window, grid, model, front, "volume_id long, w long, i long, p double")
    return rows.groupBy("volume_id", "i").agg(F.avg("p").alias("prob")).where("prob > 0.5")


@dataclass(frozen=True)
class ModelConfig:
    """What a segmentation model expects: its classes, window and spacing (z, y, x), and the normalisation of its input."""

    classes: int
    window: tuple[int, int, int]
    spacing: tuple[float, float, float]
    low: float
    high: float
    mean: float
    std: float
    overlap: float = 0.5
    keep_small: tuple[int, ...] = ()  # labels whose small components stay


#: Settings that come with the published models (fixed values).
ANATOMY = ModelConfig(6, (128, 160, 112), (0.43164101243019104, 0.31200000643730164, 0.43164101243019104), -208.0, 3070.0, 1178.261474609375, 611.7098999023438, keep_small=(5,))
SKIN = ModelConfig(2, (128, 128, 128), (0.4, 0.4, 0.4), -931.0, 1543.0, 12.869, 370.557)


def segment_volume(vox: DataFrame, grid: Grid, model: Callable, config: ModelConfig, min_mm3: float = 0.0) -> DataFrame:
    """(volume_id, i, x, y, z, label) on the source grid: resample to the model's spacing, normalise, run
    the model on windows, keep the surest label, and bring labels back to the source grid by the nearest voxel.

    With ``min_mm3`` components below it lose their label, but for ``config.keep_small``.
    """
    sz, sy, sx = config.spacing
    size = lambda n, a, b: max(1, int(np.floor(n * a / b + 0.5)))
    inner = Grid(size(grid.width, grid.sx, sx), size(grid.height, grid.sy, sy), size(grid.depth, grid.sz, sz), sx, sy, sz)
    near = written(ct_normalize(resample_linear(vox, grid, inner), config.low, config.high, config.mean, config.std), "model-input")
    found = segment_argmax(near, inner, model, config.window, config.overlap, "norm")
    labels = written(inner.coords(found.select("volume_id", "i", "label")), "model-labels")
    back = resample_nearest(labels, inner, grid, "label").withColumn("i", grid.index(F.col("x"), F.col("y"), F.col("z")))
    back = back.select("volume_id", *(F.col(c).cast("long") for c in ("i", "x", "y", "z", "label")))
    if not min_mm3:
        return back
    rooted = written(component_roots(back.where("label > 0"), grid, 6, by="label"), "model-roots")
    small = rooted.where(~F.col("label").isin(*config.keep_small)) if config.keep_small else rooted
    kept = remove_small(small, min_mm3, grid).unionByName(rooted.where(F.col("label").isin(*config.keep_small))) if config.keep_small else remove_small(small, min_mm3, grid)
    return back.select("volume_id", "i", "x", "y", "z").join(kept.select("volume_id", "i", "label"), ["volume_id", "i"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def segment_region(vox: DataFrame, grid: Grid, model: Callable, lo: tuple[int, int, int], hi: tuple[int, int, int], window: tuple[int, int, int] = (96, 96, 96), overlap: float = 0.25) -> DataFrame:
    """(volume_id, i, prob) on the source grid of the foreground in a box (x, y, z): z-scores of the box, mean probability over windows above one half."""
    inner = Grid(*(b - a for a, b in zip(lo, hi, strict=True)), grid.sx, grid.sy, grid.sz)
    near = written(zscore(crop(vox, lo, hi)), "region-input")
    found = inner.coords(segment_mean(near, inner, model, window, overlap, "norm"))
    return found.select("volume_id", grid.index(*(F.col(c) + a for c, a in zip("xyz", lo, strict=True))).alias("i"), "prob")


def onnx_model(path: str, input_name: str = "input") -> Callable:
    """A model read from an ONNX file that every executor can open, once for each worker."""
    cache: dict = {}

    def run(patch: np.ndarray, window) -> np.ndarray:
        if "s" not in cache:
            import onnxruntime

            cache["s"] = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        return cache["s"].run(None, {input_name: patch[None, None]})[0][0]

    return run
