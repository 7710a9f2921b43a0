"""Scalar volumes as tables: ``voxels(volume_id, i, x, y, z, v)`` with ``i = (z * height + y) * width + x``.

Every operator works on any number of volumes of one grid at once and keeps ``volume_id`` in all keys,
so partitions follow volumes. Per-voxel operators are column expressions without a shuffle; statistics
are partial aggregates by volume and bin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions.jsnum import clamp, gray, one_if_zero, round_half_up

BINS = 4096
OUT = 64  # side of the bricks of output voxels that a resampling makes together


@dataclass(frozen=True)
class Grid:
    """Size in voxels and voxel spacing in millimetres, both in x, y, z order."""

    width: int
    height: int
    depth: int
    sx: float = 1.0
    sy: float = 1.0
    sz: float = 1.0

    @property
    def count(self) -> int:
        return self.width * self.height * self.depth

    def index(self, x: Column, y: Column, z: Column) -> Column:
        return (z * self.height + y) * self.width + x

    def coords(self, df: DataFrame) -> DataFrame:
        i = F.col("i")
        return df.withColumns({"x": i % self.width, "y": F.floor(i / self.width) % self.height, "z": F.floor(i / (self.width * self.height))})

    def inside(self, x: Column, y: Column, z: Column) -> Column:
        return x.between(0, self.width - 1) & y.between(0, self.height - 1) & z.between(0, self.depth - 1)


def value_at(vox: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` (volume_id, x, y, z) with v; 0 outside of the volume."""
    return points.join(vox.select("volume_id", "x", "y", "z", "v"), ["volume_id", "x", "y", "z"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


def windowed(vox: DataFrame, window: float, level: float) -> DataFrame:
    return vox.withColumn("gray", gray(F.col("v"), window, level))


def axial_slice(vox: DataFrame, z: int) -> DataFrame:
    return vox.where(F.col("z") == z).select("volume_id", F.col("y").alias("row"), F.col("x").alias("col"), "v")


def coronal_slice(vox: DataFrame, y: int, grid: Grid) -> DataFrame:
    """Row 0 is the highest z."""
    return vox.where(F.col("y") == y).select("volume_id", (grid.depth - 1 - F.col("z")).alias("row"), F.col("x").alias("col"), "v")


def sagittal_slice(vox: DataFrame, x: int, grid: Grid) -> DataFrame:
    return vox.where(F.col("x") == x).select("volume_id", (grid.depth - 1 - F.col("z")).alias("row"), F.col("y").alias("col"), "v")


def axial_mip(vox: DataFrame, z0: int, z1: int) -> DataFrame:
    """Maximum over the slices z0 to z1, both included: (volume_id, x, y, v)."""
    return vox.where(F.col("z").between(min(z0, z1), max(z0, z1))).groupBy("volume_id", "x", "y").agg(F.max("v").alias("v"))


def crop(vox: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> DataFrame:
    """Voxels from ``lo`` up to but without ``hi`` (x, y, z), with coordinates from the crop's corner."""
    w, h = hi[0] - lo[0], hi[1] - lo[1]
    keep = F.lit(True)
    for c, a, b in zip("xyz", lo, hi, strict=True):
        keep = keep & (F.col(c) >= a) & (F.col(c) < b)
    cut = vox.where(keep).withColumns({c: F.col(c) - a for c, a in zip("xyz", lo, strict=True)})
    return cut.withColumn("i", (F.col("z") * h + F.col("y")) * w + F.col("x"))


def scalar_range(vox: DataFrame, ignore: int | None = None) -> DataFrame:
    """(volume_id, lo, hi), without a sentinel value; 0 and 0 where nothing is left."""
    v = F.col("v") if ignore is None else F.when(F.col("v") != ignore, F.col("v"))
    return vox.groupBy("volume_id").agg(F.coalesce(F.min(v), F.lit(0)).alias("lo"), F.coalesce(F.max(v), F.lit(0)).alias("hi"))


def histogram(vox: DataFrame, bins: int = BINS) -> DataFrame:
    """(volume_id, bin, n, lo, hi): nearest of ``bins`` bins between the volume's least and greatest value."""
    r = scalar_range(vox)
    span = F.greatest(F.lit(1), F.col("hi") - F.col("lo"))
    at = clamp(round_half_up((F.col("v") - F.col("lo")) / span * (bins - 1)), 0, bins - 1)
    return vox.select("volume_id", "v").join(r, "volume_id").groupBy("volume_id", at.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def histogram_quantiles(hist: DataFrame, parts: dict[str, float], bins: int = BINS) -> DataFrame:
    """Per volume, for each named part the value of the first bin whose running count exceeds it.

    ``hist`` has at most ``bins`` rows a volume, so its running sum is bounded work for a task.
    """
    w = Window.partitionBy("volume_id").orderBy("bin")
    all_w = Window.partitionBy("volume_id")
    run = hist.select("volume_id", "bin", "lo", "hi", F.sum("n").over(w).alias("cum"), F.sum("n").over(all_w).alias("total"))
    value = F.col("lo") + F.col("bin") / (bins - 1) * (F.col("hi") - F.col("lo"))
    cols = [F.min(F.when(F.col("cum") > clamp(F.floor(F.col("total") * p), 0, F.col("total") - 1), value)).alias(k) for k, p in parts.items()]
    return run.groupBy("volume_id", "lo", "hi").agg(*cols)


def auto_window_level(vox: DataFrame) -> DataFrame:
    q = histogram_quantiles(histogram(vox), {"low": 0.05, "high": 0.999})
    return q.select("volume_id", F.greatest(F.lit(1), round_half_up(F.col("high") - F.col("low"))).alias("wl_window"), round_half_up((F.col("high") + F.col("low")) / 2).alias("wl_level"))


def preview_threshold(vox: DataFrame, level: float) -> DataFrame:
    q = histogram_quantiles(histogram(vox), {"p95": 0.95, "p99": 0.99})
    t = round_half_up(F.greatest(F.lit(float(level)), F.col("p95") * 0.45 + F.col("p99") * 0.55))
    return q.select("volume_id", clamp(t, F.col("lo"), F.col("hi")).alias("threshold"))


def ct_normalize(vox: DataFrame, lo: float, hi: float, mean: float, std: float) -> DataFrame:
    return vox.withColumn("norm", (clamp(F.col("v").cast("double"), float(lo), float(hi)) - mean) / (std or 1.0))


def zscore(vox: DataFrame) -> DataFrame:
    s = vox.groupBy("volume_id").agg(F.avg("v").alias("mean"), one_if_zero(F.stddev_pop("v")).alias("std"))
    return vox.join(s, "volume_id").withColumn("norm", (F.col("v") - F.col("mean")) / F.col("std")).drop("mean", "std")


def percentile_normalize(vox: DataFrame, lower: float = 0.5, upper: float = 99.5, out: tuple[float, float] = (0.0, 1.0), bins: int = BINS) -> DataFrame:
    """Clip to the bins where the running count reaches the percentiles, then scale to ``out``."""
    r = vox.groupBy("volume_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scale = (bins - 1) / (F.col("hi") - F.col("lo"))
    rows = vox.join(r, "volume_id")
    at = F.when(F.col("hi") > F.col("lo"), round_half_up((F.col("v") - F.col("lo")) * scale)).otherwise(F.lit(0))
    hist = rows.groupBy("volume_id", at.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("volume_id").orderBy("bin")
    run = hist.select("volume_id", "bin", "lo", "hi", F.sum("n").over(w).alias("cum"), F.sum("n").over(Window.partitionBy("volume_id")).alias("total"))
    first = lambda p: F.min(F.when(F.col("cum") >= F.col("total") * p / 100, F.col("bin")))
    q = run.groupBy("volume_id", "lo", "hi").agg(first(lower).alias("b0"), first(upper).alias("b1"))
    same = F.col("lo") == F.col("hi")
    low = F.when(same, F.col("lo")).otherwise(F.col("lo") + F.col("b0") / scale)
    high = F.when(same, F.col("hi")).otherwise(F.col("lo") + F.col("b1") / scale)
    high = F.when((high <= low) & ~same, low + (F.col("hi") - F.col("lo")) / bins).otherwise(high)
    q = q.select("volume_id", low.alias("lower_value"), high.alias("upper_value"), same.alias("flat"))
    t = clamp((F.col("v") - F.col("lower_value")) / F.nullif(F.col("upper_value") - F.col("lower_value"), F.lit(0.0)), 0.0, 1.0)
    return vox.join(q, "volume_id").withColumn("norm", F.when(F.col("flat"), F.lit(out[0])).otherwise(out[0] + t * (out[1] - out[0]))).drop("flat")


def output_grid(spark, volumes: DataFrame, grid: Grid) -> DataFrame:
    """Every voxel of ``grid`` for each volume: made by rows of slices, by many tasks, never on the driver."""
    rows = volumes.select("volume_id", F.explode(F.sequence(F.lit(0), F.lit(grid.depth - 1))).alias("z"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "volume_id", "z")
    rows = rows.select("volume_id", "z", F.explode(F.sequence(F.lit(0), F.lit(grid.height - 1))).alias("y"))
    return rows.select("volume_id", F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))).alias("x"), "y", "z")


def resample_nearest(vox: DataFrame, grid: Grid, out: Grid, value: str = "v") -> DataFrame:
    """Nearest source voxel by voxel centres; labels stay labels."""
    o = output_grid(vox.sparkSession, vox.select("volume_id").distinct(), out)
    pick = lambda c, a, b: clamp(round_half_up((F.col(c) + 0.5) * (a / b) - 0.5), 0, a - 1).cast("long")
    o = o.withColumns({"ix": pick("x", grid.width, out.width), "iy": pick("y", grid.height, out.height), "iz": pick("z", grid.depth, out.depth)})
    src = vox.select("volume_id", F.col("x").cast("long").alias("ix"), F.col("y").cast("long").alias("iy"), F.col("z").cast("long").alias("iz"), F.col(value))
    return o.join(src, ["volume_id", "ix", "iy", "iz"], "left").select("volume_id", "x", "y", "z", F.coalesce(F.col(value), F.lit(0)).alias(value))


def _corners(o: np.ndarray, a: int, b: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of places on an axis of ``b`` voxels, the two places on one of ``a`` between which they lie, and their weights."""
    s = np.clip((o + 0.5) * (a / b) - 0.5, 0.0, float(a - 1))
    lo = np.floor(s)
    return [(lo.astype(np.int64), 1 - (s - lo)), (np.minimum(lo + 1, a - 1).astype(np.int64), s - lo)]


def resample_linear(vox: DataFrame, grid: Grid, out: Grid) -> DataFrame:
    """Trilinear at voxel centres, edges clamped: (volume_id, x, y, z, v) of every voxel of ``out``.

    Each brick of ``OUT`` output voxels a side gathers the source voxels that are corners of its own, and sums the eight of
    each. A source voxel without a row counts as 0; bricks without any have a row of their own, so they are made as well.
    """
    axes = {"x": (grid.width, out.width), "y": (grid.height, out.height), "z": (grid.depth, out.depth)}
    src = vox.where(grid.inside(*(F.col(c) for c in "xyz"))).select("volume_id", *(F.col(c).cast("long").alias(c) for c in "xyz"), F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"))
    seeds = vox.select("volume_id").distinct()
    for c, (a, b) in axes.items():
        # output places whose corner a source voxel may be: less than one source step away, or beyond the edge
        first = F.when(F.col(c) == 0, 0).otherwise(F.ceil((F.col(c) - 0.5) * (b / a) - 0.5 - 1e-6))
        last = F.when(F.col(c) == a - 1, b - 1).otherwise(F.floor((F.col(c) + 1.5) * (b / a) - 0.5 + 1e-6))
        src = src.withColumns({"_f": F.greatest(F.lit(0), first).cast("long"), "_l": F.least(F.lit(b - 1), last).cast("long")}).where("_f <= _l")
        src = src.withColumn(f"b{c}", F.explode(F.sequence(F.floor(F.col("_f") / OUT), F.floor(F.col("_l") / OUT)))).drop("_f", "_l")
        seeds = seeds.withColumn(f"b{c}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((b - 1) // OUT).cast("long"))))
    seeds = seeds.select("volume_id", *(F.lit(None).cast("long").alias(c) for c in "xyz"), F.lit(None).cast("double").alias("v"), *(f"b{c}" for c in "xyz"))

    def run(group: pa.Table) -> pa.Table:
        volume, kept = group.column("volume_id"), group.filter(group.column("x").is_valid())
        base = {c: group.column(f"b{c}")[0].as_py() * OUT for c in "xyz"}
        o = {c: np.arange(base[c], min(base[c] + OUT, axes[c][1])) for c in "xyz"}
        ends = {c: _corners(o[c], *axes[c]) for c in "xyz"}
        need = {c: np.unique(np.concatenate([k for k, _ in ends[c]])) for c in "xyz"}
        at, known = [], np.ones(len(kept), dtype=bool)
        for c in "zyx":
            place = kept.column(c).to_numpy()
            at.append(np.minimum(np.searchsorted(need[c], place), len(need[c]) - 1))
            known &= need[c][at[-1]] == place
        shape = [len(need[c]) for c in "zyx"]
        flat = np.ravel_multi_index([p[known] for p in at], shape)
        dense = np.bincount(flat, weights=kept.column("v").to_numpy()[known], minlength=int(np.prod(shape))).reshape(shape)
        v = np.zeros([len(o[c]) for c in "zyx"])
        for kx, wx in ends["x"]:
            for ky, wy in ends["y"]:
                for kz, wz in ends["z"]:
                    w = wx * wy[:, None] * wz[:, None, None]
                    corner = dense[np.ix_(*(np.searchsorted(need[c], k) for c, k in zip("zyx", (kz, ky, kx), strict=True)))]
                    v += np.where(w > 0, w * corner, 0.0)
        z, y, x = (m.ravel().astype(np.int32) for m in np.meshgrid(*(o[c] for c in "zyx"), indexing="ij"))
        same = volume.combine_chunks().take(pa.array(np.zeros(v.size, dtype=np.int64)))
        return pa.table({"volume_id": same, "x": x, "y": y, "z": z, "v": v.ravel()})

    made = T.StructType([T.StructField("volume_id", vox.schema["volume_id"].dataType), *(T.StructField(c, T.IntegerType()) for c in "xyz"), T.StructField("v", T.DoubleType())])
    return src.select(*seeds.columns).unionByName(seeds).groupBy("volume_id", "bx", "by", "bz").applyInArrow(run, made)


def class_stats(labelmap: DataFrame, classes: DataFrame, grid: Grid) -> DataFrame:
    """(value, voxels, volume_mm3) of every class of ``classes`` (value); 0 for one that is absent."""
    n = labelmap.groupBy(F.col("label").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    voxels = F.coalesce("n", F.lit(0))
    return classes.join(n, "value", "left").select("value", voxels.alias("voxels"), (voxels * (grid.sx * grid.sy * grid.sz)).alias("volume_mm3"))
