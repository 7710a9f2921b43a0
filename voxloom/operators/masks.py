"""Binary masks as sparse tables ``mask(volume_id, i, x, y, z)`` of foreground voxels, and label maps."""

from __future__ import annotations

from itertools import product
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators.staging import linked_sets, written
from voxloom.operators.voxels import Grid

BRICK = 64
SLAB = 32  # lines of a distance pass that are gathered together, in either direction
CELLS = 1 << 20  # most cells of lines that are gathered together, if there are several
_SHIFT = 1 << 40  # volumes' voxels as one number: volume_id * 2**40 + i

#: Named ranges in Hounsfield units (fixed values).
PRESETS = [
    ("bone", 226, 3071),
    ("enamel_adult", 1553, 2850),
    ("enamel_child", 2042, 3023),
    ("compact", 662, 1988),
    ("spongial", 148, 661),
    ("soft", -700, 225),
]


def threshold(vox: DataFrame, lo: float, hi: float) -> DataFrame:
    return vox.where(F.col("v").between(lo, hi)).select("volume_id", "i", "x", "y", "z")


def preset_counts(vox: DataFrame) -> DataFrame:
    """Voxels in each named range: one pass, since the ranges are few and fixed."""
    return vox.select(F.explode(F.array_compact(F.array(*(F.when(F.col("v").between(a, b), F.lit(n)) for n, a, b in PRESETS)))).alias("preset")).groupBy("preset").agg(F.count(F.lit(1)).alias("voxels"))


def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Neighbour steps (dx, dy, dz): 6 by faces, 18 by edges, 26 by corners."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    return [d for d in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, d)) <= most]


def _steps(dirs) -> F.Column:
    return F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(c).alias("dz")) for a, b, c in dirs)))


def neighbours(mask: DataFrame, grid: Grid, dirs) -> DataFrame:
    """``mask`` with the coordinates and index of each neighbour inside the grid: nx, ny, nz, ni."""
    s = mask.withColumn("_d", _steps(dirs))
    nx, ny, nz = F.col("x") + F.col("_d.dx"), F.col("y") + F.col("_d.dy"), F.col("z") + F.col("_d.dz")
    return s.withColumns({"nx": nx, "ny": ny, "nz": nz}).where(grid.inside(F.col("nx"), F.col("ny"), F.col("nz"))).withColumn("ni", grid.index(F.col("nx"), F.col("ny"), F.col("nz"))).drop("_d")


def with_rims(rows: DataFrame, grid: Grid, brick: int = BRICK) -> DataFrame:
    """``rows`` with _bx, _by, _bz and _own: each voxel in its own brick, and once more in every brick of the grid that it touches."""
    cols, own = rows.columns, F.lit(True)
    for c, n in (("x", grid.width), ("y", grid.height), ("z", grid.depth)):
        at = F.floor(F.col(c) / brick)
        if n > brick:
            lo = F.least(at, F.greatest(F.lit(0).cast("long"), F.floor((F.col(c) - 1) / brick)))
            hi = F.greatest(at, F.least(F.lit((n - 1) // brick).cast("long"), F.floor((F.col(c) + 1) / brick)))
            rows, own = rows.withColumn(f"_b{c}", F.explode(F.sequence(lo, hi))), own & (F.col(f"_b{c}") == at)
        else:
            rows = rows.withColumn(f"_b{c}", at)
    return rows.select(*cols, "_bx", "_by", "_bz", own.alias("_own"))


def box(*places: np.ndarray) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Of places (z, y, x) their numbers in the least box that leaves one free step around them, and the steps of its axes."""
    low = [a.min() - 1 for a in places]
    height, width = (int(a.max() - n) + 2 for a, n in zip(places[1:], low[1:], strict=True))
    z, y, x = (a - n for a, n in zip(places, low, strict=True))
    return (z * height + y) * width + x, (height * width, width, 1)


def _local_roots(i: np.ndarray, x: np.ndarray, y: np.ndarray, z: np.ndarray, kind: np.ndarray, grid: Grid, half) -> np.ndarray:
    """Least index of each voxel's component among the given voxels (one brick), by pointer jumping."""
    order = np.argsort(i)
    s = i[order]
    a_all, b_all = [], []
    for dx, dy, dz in half:
        ok = (x + dx >= 0) & (x + dx < grid.width) & (y + dy >= 0) & (y + dy < grid.height) & (z + dz >= 0) & (z + dz < grid.depth)
        target = i + (dz * grid.height + dy) * grid.width + dx
        at = np.minimum(np.searchsorted(s, target), len(s) - 1)
        hit = ok & (s[at] == target) & (kind[order[at]] == kind)
        a_all.append(np.flatnonzero(hit))
        b_all.append(order[at[hit]])
    a, b = np.concatenate(a_all), np.concatenate(b_all)
    rank = np.empty(len(i), dtype=np.int64)
    rank[order] = np.arange(len(i))  # voxels by index: the least rank is the least index
    a, b, label = rank[a], rank[b], np.arange(len(i))
    while len(a):
        new = label.copy()
        least = np.minimum(label[a], label[b])
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return s[label[rank]]


def component_roots(mask: DataFrame, grid: Grid, connectivity: int = 26, by: str | None = None, brick: int = BRICK) -> DataFrame:
    """``mask`` with ``root``: the least voxel index of each voxel's component in its volume.

    Bricks of ``brick``**3 voxels are labelled on their own; only voxels on the faces of bricks look for
    neighbours across, and only the brick components that meet are solved as a graph. ``by`` names a
    column whose values must be equal for voxels to join (label maps).
    """
    half = [d for d in offsets(connectivity) if d > (0, 0, 0)]
    rows = mask.withColumn("_k", F.col(by).cast("long") if by else F.lit(0).cast("long"))
    rows = rows.withColumns({f"_b{c}": F.floor(F.col(c) / brick) for c in "xyz"})
    extra = [f.name for f in mask.schema if f.name not in ("volume_id", "i", "x", "y", "z")]

    def local(group: pa.Table) -> pa.Table:
        i, x, y, z, k = (group.column(c).to_numpy().astype(np.int64) for c in ("i", "x", "y", "z", "_k"))
        return group.append_column("_local", pa.array(_local_roots(i, x, y, z, k, grid, half)))

    cols = ["volume_id", "i", "x", "y", "z", *extra, "_k", "_bx", "_by", "_bz"]
    rows = rows.select(*(F.col(c).cast("long") if c in ("volume_id", "i", "x", "y", "z", "_bx", "_by", "_bz") else F.col(c) for c in cols))
    schema = T.StructType([*rows.schema, T.StructField("_local", T.LongType())])
    done = written(rows.groupBy("volume_id", "_bx", "_by", "_bz").applyInArrow(local, schema), "bricks")
    rim = F.lit(False)
    for c, n in (("x", grid.width), ("y", grid.height), ("z", grid.depth)):
        if n > brick:
            rim = rim | (F.col(c) % brick == 0) | (F.col(c) % brick == brick - 1)
    edge = done.where(rim)
    far = neighbours(edge, grid, half).where(" or ".join(f"floor(n{c} / {brick}) <> _b{c}" for c in "xyz"))
    other = edge.select("volume_id", F.col("i").alias("ni"), F.col("_k"), F.col("_local").alias("_other"))
    key = lambda c: F.col("volume_id") * _SHIFT + F.col(c)
    met = far.join(other, ["volume_id", "ni", "_k"]).select(key("_local").alias("a"), key("_other").alias("b")).distinct()
    sets = linked_sets(met)
    out = done.withColumn("_node", key("_local")).join(sets.withColumnRenamed("node", "_node").withColumnRenamed("root", "_root"), "_node", "left")
    root = F.coalesce(F.col("_root") - F.col("volume_id") * _SHIFT, F.col("_local"))
    return out.select("volume_id", "i", "x", "y", "z", *extra, root.alias("root"))


def component_stats(rooted: DataFrame) -> DataFrame:
    """A row for each component: comp (1, 2, ... by first voxel), voxels, bounds (upper ones exclusive), centroid."""
    s = rooted.groupBy("volume_id", "root").agg(
        F.count(F.lit(1)).alias("voxels"),
        *(F.min(c).alias(f"{c}0") for c in "zyx"),
        *((F.max(c) + 1).alias(f"{c}1") for c in "zyx"),
        *(F.avg(c).alias(f"c{c}") for c in "zyx"),
    )
    return s.withColumn("comp", F.row_number().over(Window.partitionBy("volume_id").orderBy("root")).cast("long"))


def largest(rooted: DataFrame, k: int = 1) -> DataFrame:
    """(volume_id, root, voxels, rank) of the k largest components of each volume; ties go to the first voxel."""
    n = rooted.groupBy("volume_id", "root").agg(F.count(F.lit(1)).alias("voxels"))
    w = Window.partitionBy("volume_id").orderBy(F.desc("voxels"), "root")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keep_largest(rooted: DataFrame) -> DataFrame:
    return rooted.join(largest(rooted).select("volume_id", "root"), ["volume_id", "root"], "left_semi")


def remove_small(rooted: DataFrame, min_mm3: float, grid: Grid) -> DataFrame:
    least = int(np.ceil(min_mm3 / ((grid.sx * grid.sy * grid.sz) or 1)))
    n = rooted.groupBy("volume_id", "root").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return rooted.join(n, ["volume_id", "root"], "left_semi")


def region_grow(vox: DataFrame, grid: Grid, seed: tuple[int, int, int], lo: float, hi: float, connectivity: int = 6) -> DataFrame:
    """Voxels in range that connect with the seed: the seed's component of the threshold mask."""
    rooted = written(component_roots(threshold(vox, lo, hi), grid, connectivity), "grow")
    at = (seed[2] * grid.height + seed[1]) * grid.width + seed[0]
    return rooted.join(rooted.where(F.col("i") == at).select("volume_id", "root"), ["volume_id", "root"], "left_semi")


def complement(vox: DataFrame, mask: DataFrame) -> DataFrame:
    return vox.select("volume_id", "i", "x", "y", "z").join(mask.select("volume_id", "i"), ["volume_id", "i"], "left_anti")


def fill_holes(vox: DataFrame, mask: DataFrame, grid: Grid, most: int | None = None) -> DataFrame:
    """``mask`` with background components (by faces) that touch no border and have at most ``most`` voxels."""
    hole = written(component_roots(complement(vox, mask), grid, 6), "holes")
    border = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("z") == 0) | (F.col("x") == grid.width - 1) | (F.col("y") == grid.height - 1) | (F.col("z") == grid.depth - 1)
    s = hole.groupBy("volume_id", "root").agg(F.count(F.lit(1)).alias("n"), F.max(border).alias("open"))
    fill = s.where(~F.col("open") & (F.lit(True) if most is None else F.col("n") <= most))
    new = hole.join(fill, ["volume_id", "root"], "left_semi")
    cols = ["volume_id", "i", "x", "y", "z"]
    return mask.select(*cols).unionByName(new.select(*cols))


def dilate(mask: DataFrame, grid: Grid, connectivity: int = 6) -> DataFrame:
    near = neighbours(mask, grid, offsets(connectivity)).select("volume_id", F.col("ni").alias("i"), F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("nz").alias("z"))
    return mask.select("volume_id", "i", "x", "y", "z").unionByName(near).distinct()


def erode(mask: DataFrame, grid: Grid, connectivity: int = 6) -> DataFrame:
    """Voxels all of whose neighbours are set; beyond the grid nothing is set."""
    need = len(offsets(connectivity))
    n = neighbours(mask, grid, offsets(connectivity)).groupBy("volume_id", F.col("ni").alias("i")).agg(F.count(F.lit(1)).alias("_n"))
    return mask.join(n.where(F.col("_n") == need), ["volume_id", "i"], "left_semi")


def mask_rows(rows: DataFrame) -> DataFrame:
    return rows.select("volume_id", "i", "x", "y", "z")


def opening(mask: DataFrame, grid: Grid, connectivity: int = 6) -> DataFrame:
    """Erosion, then dilation: what is thinner than the neighbourhood goes."""
    return dilate(written(erode(mask, grid, connectivity), "eroded"), grid, connectivity)


def closing(mask: DataFrame, grid: Grid, connectivity: int = 6) -> DataFrame:
    """Dilation, then erosion: gaps narrower than the neighbourhood are filled; beyond the grid nothing is set."""
    return erode(written(dilate(mask, grid, connectivity), "dilated"), grid, connectivity)


def split_masks(rooted: DataFrame, most: int = 24) -> DataFrame:
    """(volume_id, part, i, x, y, z): the ``most`` largest components as masks of their own, part 1 the largest."""
    top = largest(rooted, most).select("volume_id", "root", F.col("rank").alias("part"))
    return rooted.join(top, ["volume_id", "root"]).select("volume_id", "part", "i", "x", "y", "z")


def split_labels(rooted: DataFrame, locked: tuple[int, ...] = (), most: int = 24) -> DataFrame:
    """``rooted`` (volume_id, label, root, ...: components of each label) with ``part``: of every label in several components, which is not
    locked, the ``most`` largest components are parts 1, 2, ... from the largest on, and the others go; all other labels stay whole as part 0."""
    n = rooted.groupBy("volume_id", "label", "root").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("volume_id", "label")
    n = n.withColumns({"_all": F.count(F.lit(1)).over(whole), "_nth": F.row_number().over(whole.orderBy(F.desc("_n"), "root"))})
    keep = (F.col("_all") == 1) | F.col("label").isin(*locked) if locked else F.col("_all") == 1
    part = n.select("volume_id", "label", "root", F.when(keep, 0).otherwise(F.col("_nth")).cast("long").alias("part")).where(F.col("part") <= most)
    return rooted.join(part, ["volume_id", "label", "root"])


def keep_largest_of(rooted: DataFrame, locked: tuple[int, ...] = ()) -> DataFrame:
    """``rooted`` (volume_id, label, root, ...) with the largest component of each label; locked labels stay as they are."""
    n = rooted.groupBy("volume_id", "label", "root").agg(F.count(F.lit(1)).alias("_n"))
    nth = F.row_number().over(Window.partitionBy("volume_id", "label").orderBy(F.desc("_n"), "root"))
    top = n.withColumn("_nth", nth).where((F.col("_nth") == 1) | (F.col("label").isin(*locked) if locked else F.lit(False)))
    return rooted.join(top.select("volume_id", "label", "root"), ["volume_id", "label", "root"], "left_semi")


def exposed_faces(mask: DataFrame, grid: Grid) -> DataFrame:
    """(volume_id, i, dx, dy, dz): faces without a set voxel beyond."""
    s = mask.select("volume_id", "i", "x", "y", "z", _steps(offsets(6)).alias("d")).select("volume_id", "i", "x", "y", "z", "d.*")
    s = s.withColumns({"nx": F.col("x") + F.col("dx"), "ny": F.col("y") + F.col("dy"), "nz": F.col("z") + F.col("dz")})
    other = mask.select("volume_id", F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"))
    return s.join(other, ["volume_id", "nx", "ny", "nz"], "left_anti").drop("nx", "ny", "nz")


def surface_estimates(mask: DataFrame, grid: Grid) -> DataFrame:
    """Triangles (two a face) and area in mm2 of the voxel surface."""
    area = F.when(F.col("dx") != 0, grid.sy * grid.sz).when(F.col("dy") != 0, grid.sx * grid.sz).otherwise(grid.sx * grid.sy)
    return exposed_faces(mask, grid).groupBy("volume_id").agg((F.count(F.lit(1)) * 2).alias("triangles"), F.sum(area).alias("area_mm2"))


def smooth(mask_values: DataFrame, grid: Grid, value: str = "v") -> DataFrame:
    """Mean of each set voxel and its six neighbours inside the grid, unset ones counting 0. Each brick gets the voxels around it."""
    cols = mask_values.columns

    def run(group: pa.Table) -> pa.Table:
        at, steps = box(*(group.column(c).to_numpy().astype(np.int64) for c in "zyx"))
        dense = np.bincount(at, pc.fill_null(group.column(value).cast(pa.float64()), 0.0).to_numpy(), int(at.max()) + steps[0] + 1)
        around = sum(dense[at + d] + dense[at - d] for d in steps)
        return group.append_column("_s", pa.array(around)).filter(group.column("_own")).select([*cols, "_s"])

    around = with_rims(mask_values, grid).groupBy("volume_id", "_bx", "_by", "_bz").applyInArrow(run, T.StructType([*mask_values.schema, T.StructField("_s", T.DoubleType())]))
    count = F.lit(7)
    for c, n in (("x", grid.width), ("y", grid.height), ("z", grid.depth)):
        count = count - F.when(F.col(c) == 0, 1).otherwise(0) - F.when(F.col(c) == n - 1, 1).otherwise(0)
    return around.withColumn("smooth", (F.col(value) + F.col("_s")) / count).drop("_s")


def downsample_any(mask: DataFrame, stride: int) -> DataFrame:
    return mask.select("volume_id", *(F.floor(F.col(c) / stride).alias(c) for c in "xyz")).distinct()


def _running_max(a: np.ndarray, width: int, axis: int) -> np.ndarray:
    """The largest of each ``width`` values in a row along an axis, by doubling."""
    a, n = np.moveaxis(a, axis, 0), 1
    while 2 * n <= width:
        a, n = np.maximum(a[:-n], a[n:]), 2 * n
    return np.moveaxis(np.maximum(a[: len(a) - (width - n)], a[width - n :]), 0, axis)


def local_maxima(rows: DataFrame, value: str, reach: int) -> DataFrame:
    """``rows`` (volume_id, x, y, z, value, ...) that no row at most ``reach`` steps away along each axis exceeds.

    Places without a row count as lower than all. Each brick gets the rows around it and looks along one axis after another.
    """
    brick = max(BRICK, reach)
    cols, dealt = rows.columns, rows
    for c in "xyz":
        at = [F.floor((F.col(c) + d) / brick) for d in (-reach, 0, reach)]
        dealt = dealt.withColumns({f"_o{c}": at[1], f"_b{c}": F.explode(F.array_distinct(F.array(*at)))})
    dealt = dealt.select(*cols, *(f"_b{c}" for c in "xyz"), (F.expr(" and ".join(f"_o{c} = _b{c}" for c in "xyz"))).alias("_own"))

    def run(group: pa.Table) -> pa.Table:
        at = [group.column(c).to_numpy() for c in "zyx"]
        low = [int(a.min()) - reach for a in at]
        dense = np.full([int(a.max()) + reach + 1 - n for a, n in zip(at, low, strict=True)], -np.inf)
        place = tuple(a - n for a, n in zip(at, low, strict=True))
        v = group.column(value).to_numpy().astype(np.float64)
        dense[place] = v
        for axis in range(3):
            dense = _running_max(dense, 2 * reach + 1, axis)
        top = dense[tuple(p - reach for p in place)]
        return group.filter(pa.array(np.asarray(group.column("_own").to_numpy(zero_copy_only=False), dtype=bool) & (v == top))).select(cols)

    return dealt.groupBy("volume_id", "_bx", "_by", "_bz").applyInArrow(run, rows.schema)


def lines_together(n: int) -> int:
    """How many lines of ``n`` voxels a distance pass gathers in either direction."""
    return max(1, min(SLAB, isqrt(CELLS // max(1, n))))


def squared_distance(vox: DataFrame, mask: DataFrame, grid: Grid, in_mm: bool = False) -> DataFrame:
    """Squared distance in voxels, or in millimetres, of every set voxel to the nearest unset one, by three passes over lines.

    A pass gathers at most ``SLAB`` x ``SLAB`` lines of one axis at a time, fewer where they are long (``CELLS``), and looks along them as far as distances reach. Without any unset
    voxel in the volume the distance stays at 1e20.
    """
    far = 1e20
    rows = vox.select("volume_id", "x", "y", "z").join(mask.select("volume_id", "x", "y", "z", F.lit(True).alias("_m")), ["volume_id", "x", "y", "z"], "left")
    rows = rows.select(*(F.col(c).cast("long") for c in ("volume_id", "x", "y", "z")), F.when(F.col("_m"), F.lit(far)).otherwise(F.lit(0.0)).alias("d"))

    def along(axis: str, n: int, step: float):
        others = [c for c in "xyz" if c != axis]

        def run(group: pa.Table) -> pa.Table:
            at = group.column(axis).to_numpy()
            a, b = (group.column(c).to_numpy() for c in others)
            _, line = np.unique(a * (1 << 32) + b, return_inverse=True)
            f = np.full((line.max() + 1, n), np.inf)
            f[line, at] = group.column("d").to_numpy()
            d = f.copy()
            for k in range(1, n):
                away = (k * step) ** 2
                if away >= d[line, at].max():  # nothing so far away can be nearer
                    break
                np.minimum(d[:, k:], f[:, :-k] + away, out=d[:, k:])
                np.minimum(d[:, :-k], f[:, k:] + away, out=d[:, :-k])
            return group.set_column(group.schema.get_field_index("d"), "d", pa.array(np.minimum(d[line, at], far)))

        side = lines_together(n)
        return run, [F.floor(F.col(c) / side).alias(f"_s{c}") for c in others]

    for axis, n, step in (("x", grid.width, grid.sx), ("y", grid.height, grid.sy), ("z", grid.depth, grid.sz)):
        run, slab = along(axis, n, step if in_mm else 1)
        rows = rows.groupBy("volume_id", *slab).applyInArrow(run, rows.schema)
    return rows.join(mask.select("volume_id", "x", "y", "z"), ["volume_id", "x", "y", "z"], "left_semi").withColumnRenamed("d", "d2")


def merge_labels(layers: DataFrame) -> DataFrame:
    """(volume_id, i, label) of several masks (with ord and label): the last in order wins."""
    return layers.groupBy("volume_id", "i").agg(F.max_by("label", "ord").alias("label"))


def brush(labelmap: DataFrame, grid: Grid, center: tuple[int, int, int], size_mm: float, value: int, erase: bool = False, circle: bool = True, locked: tuple[int, ...] = ()) -> DataFrame:
    """``labelmap`` (dense: volume_id, i, x, y, z, label) after one stamp in the axial plane of ``center``."""
    r = max(0.25, size_mm / 2)
    ru, rv = int(np.ceil(r / max(grid.sx, 0.001))), int(np.ceil(r / max(grid.sy, 0.001)))
    du, dv = F.col("x") - center[0], F.col("y") - center[1]
    hit = (F.col("z") == center[2]) & (F.abs(du) <= ru) & (F.abs(dv) <= rv)
    if circle:
        hit = hit & (F.hypot(du * grid.sx, dv * grid.sy) <= r)
    if locked:
        hit = hit & ((F.col("label") == value) | ~F.col("label").isin(*locked))
    new = F.when(F.col("label") == value, F.lit(0)).otherwise(F.col("label")) if erase else F.lit(value)
    return labelmap.withColumn("label", F.when(hit, new).otherwise(F.col("label")))


def overlay(gray, layers: list[tuple]) -> list:
    """RGB columns of ``over`` compositing: layers of (set, (r, g, b), opacity) on a gray column."""
    out = [gray.cast("double")] * 3
    for is_set, rgb, opacity in layers:
        a = float(np.floor(opacity * 180 + 0.5)) / 255
        out = [F.when(is_set, c * a + below * (1 - a)).otherwise(below) for c, below in zip(rgb, out, strict=True)]
    return out
