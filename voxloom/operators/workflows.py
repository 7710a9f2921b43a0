"""Workflows over objects and masks: regions of interest, strokes, seeded edits, greedy pruning, libraries, audits."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.jsnum import clamp, round_half_up
from voxloom.functions.text import normal_path, path_segment
from voxloom.operators import masks, objects
from voxloom.operators.staging import written
from voxloom.operators.voxels import Grid, resample_nearest
from voxloom.operators.watershed import watershed


def clamped_roi(lo: list[Column], hi: list[Column], size: tuple[int, int, int]) -> tuple[list[Column], list[Column]]:
    """Rounded corners inside the volume; every side at least one voxel long."""
    a = [clamp(round_half_up(v), 0, n) for v, n in zip(lo, size, strict=True)]
    b = [F.greatest(x + 1, clamp(round_half_up(v), 0, n)) for x, v, n in zip(a, hi, size, strict=True)]
    return a, b


def cube_roi(center: list[Column], edge: int, size: tuple[int, int, int]) -> tuple[list[Column], list[Column]]:
    half = int(np.floor(edge / 2 + 0.5))
    return clamped_roi([c - half for c in center], [c + half for c in center], size)


def center_roi(center: list[Column], edge: Sequence[int | Column], size: tuple[int, int, int]) -> tuple[list[Column], list[Column]]:
    """Box of given edges around a centre, moved inside the volume; shorter only where the volume is."""
    half = [F.floor(e / 2) if isinstance(e, Column) else e // 2 for e in edge]
    hi = [F.least(F.lit(n), F.greatest(F.lit(0), c - h) + e) for c, e, h, n in zip(center, edge, half, size, strict=True)]
    return [F.greatest(F.lit(0), b - e) for b, e in zip(hi, edge, strict=True)], hi


def ratio_to_voxel(axis: str, xr: Column, yr: Column, cursor: list[Column], size: tuple[int, int, int]) -> list[Column]:
    """Voxel under a point of a slice view, given as shares of its width and height; z counts from below."""
    at = lambda r, n: clamp(round_half_up(r * (n - 1)), 0, n - 1)
    w, h, d = size
    if axis == "axial":
        return [at(xr, w), at(yr, h), cursor[2]]
    if axis == "coronal":
        return [at(xr, w), cursor[1], at(1 - yr, d)]
    return [cursor[0], at(xr, h), at(1 - yr, d)]


def stroke_points(strokes: DataFrame) -> DataFrame:
    """(stroke, step, x, y, z): stamps from (ax, ay, az) to (bx, by, bz), one for each step of the longest axis."""
    steps = F.greatest(*(F.abs(F.col(f"b{c}") - F.col(f"a{c}")) for c in "xyz"), F.lit(1))
    s = strokes.withColumn("_n", steps).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n").cast("long"))))
    return s.select("stroke", "step", *(round_half_up(F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * (F.col("step") / F.col("_n"))).alias(c) for c in "xyz"))


def seeded_edit(vox: DataFrame, mask: DataFrame, grid: Grid, seeds: DataFrame, lo: float, hi: float) -> DataFrame:
    """``mask`` after seeds (ord, i, sets) in order: each sets or clears the region that grows from it.

    Voxels of one component share their fate, so the last seed of each component decides it.
    """
    rooted = written(masks.component_roots(masks.threshold(vox, lo, hi), grid, 6), "seeded")
    last = rooted.join(seeds, "i").groupBy("volume_id", "root").agg(F.max_by("sets", "ord").alias("sets"))
    hit = written(rooted.join(last, ["volume_id", "root"]).select("volume_id", "i", "x", "y", "z", "sets"), "seeded-hit")
    cols = ["volume_id", "i", "x", "y", "z"]
    kept = mask.select(*cols).join(hit.where(~F.col("sets")).select("volume_id", "i"), ["volume_id", "i"], "left_anti")
    return kept.unionByName(hit.where("sets").select(*cols)).distinct()


def greedy_apart(rows: DataFrame, by: str, order: list[tuple[str, str]], distance: float, axes: str = "xy", box: bool = False) -> DataFrame:
    """``rows`` (by, and places along ``axes``) with kept and place: in order, a row stays if no kept one of its group is nearer than ``distance``.

    Distances are straight, or, with ``box``, the largest along one axis (of whole numbers). Space is cut into cells so small that two rows of a cell are always too near. In rounds, the first open row of
    each cell stays if no earlier open row around it is too near, and closes all rows that it is too near to. So a cell has one
    candidate a round, however many rows it has, and no group is gathered in one task. Each round is written.
    """
    edge = max(distance, 1e-9) if box else max(distance, 1e-9) / np.sqrt(len(axes)) * (1 - 1e-9)
    nth = F.struct(*((-F.col(c) if how == "descending" else F.col(c)).alias(f"o{k}") for k, (c, how) in enumerate(order)))
    cells = [f"_c{c}" for c in axes]
    base = rows.withColumns({"_nth": nth, **{f"_c{c}": F.floor(F.col(c) / edge) for c in axes}, "_row": F.xxhash64(*rows.columns)})
    base = written(base, "apart")
    there = " and ".join(f"{c} is not null and not isnan({c})" for c in axes)  # a row without a place is not kept
    narrow = base.where(there).select(by, "_nth", "_row", *axes, *cells)
    reach = 1 if box else int(np.ceil(np.sqrt(len(axes))))
    around = F.explode(F.array(*(F.struct(*(F.lit(k).alias(c) for c, k in zip(axes, d, strict=True))) for d in product(range(-reach, reach + 1), repeat=len(axes)))))
    apart = [F.col(c) - F.col(f"_{c}") for c in axes]
    near = (F.greatest(*map(F.abs, apart)) if box else F.hypot(*apart) if len(axes) == 2 else F.sqrt(sum((d * d for d in apart), F.lit(0.0)))) < distance

    def spread(df: DataFrame) -> DataFrame:
        d = df.select(by, F.col("_nth").alias("_of"), *(F.col(c).alias(f"_{c}") for c in axes), *cells, around.alias("_d"))
        return d.select(by, "_of", *(f"_{c}" for c in axes), *((F.col(f"_c{c}") + F.col(f"_d.{c}")).alias(f"_c{c}") for c in axes))

    left, kept = narrow, None
    while left.take(1):
        first = written(left.groupBy(by, *cells).agg(F.min(F.struct("_nth", "_row", *axes)).alias("f")).select(by, *cells, "f.*"), "apart-first")
        late = spread(first).join(left, [by, *cells]).where(near & (F.col("_nth") < F.col("_of"))).select(by, F.col("_of").alias("_nth")).distinct()
        new = written(first.join(late, [by, "_nth"], "left_anti"), "apart-new")
        kept = new if kept is None else kept.unionByName(new)
        gone = spread(new).join(left, [by, *cells]).where(near | (F.col("_nth") == F.col("_of"))).select(by, "_nth", "_row").distinct()
        left = written(left.join(gone, [by, "_nth", "_row"], "left_anti"), "apart-left")
    if kept is None:
        return rows.withColumns({"kept": F.lit(False), "place": F.lit(0).cast("long")}).limit(0)
    places = kept.select(by, "_nth", "_row", F.row_number().over(Window.partitionBy(by).orderBy("_nth")).cast("long").alias("place"))
    out = base.join(places, [by, "_nth", "_row"], "left")
    return out.select(*rows.columns, F.col("place").isNotNull().alias("kept"), F.coalesce("place", F.lit(0).cast("long")).alias("place"))


def projection_preview(mask: DataFrame, height: int) -> DataFrame:
    """(volume_id, z, x, intensity): brighter where more voxels lie along y."""
    n = mask.groupBy("volume_id", "z", "x").agg(F.count(F.lit(1)).alias("n"))
    return n.select("volume_id", "z", "x", (0.45 + 0.55 * F.least(F.lit(1.0), F.col("n") / max(1.0, height * 0.5))).alias("intensity"))


def archive_paths(files: DataFrame, folder: str, name: str, ending: str, plain: bool = False, by: list[str] | None = None) -> DataFrame:
    """``files`` (ord, name) with a path in the archive, of which ``by`` names the keys: in order, each gets the first of
    name, name_2, name_3, ... that no earlier file has, whatever the case of letters.

    At first the nth file of a name has its nth path. In rounds, a path that files of several names want stays with the earliest
    of them, and the others and those after them move on. A refusal is final, as only earlier files take a path over, so this
    ends with what one file after the other would get. Each round is written.
    """
    keys, stem = by or [], path_segment(F.col(name), plain=plain)
    own = Window.partitionBy(*keys, F.lower("_stem")).orderBy("ord")
    f = files.withColumn("_stem", stem).withColumn("_n", F.row_number().over(own)).withColumn("_k", F.col("_n"))
    path = normal_path(F.concat(F.lit(f"{folder}/"), F.when(F.col("_k") == 1, F.col("_stem")).otherwise(F.concat("_stem", F.lit("_"), F.col("_k").cast("string"))), F.lit(f".{ending}")))
    while True:
        now = written(f.withColumn("path", path), "archive-paths")
        first = F.min("ord").over(Window.partitionBy(*keys, F.lower("path")))
        late = now.withColumn("_late", F.col("ord") > first)
        if not late.where("_late").take(1):
            return now.drop("_stem", "_n", "_k")
        ahead = F.max(F.col("_k") + F.col("_late").cast("int") - F.col("_n")).over(own.rowsBetween(Window.unboundedPreceding, 0))
        f = late.withColumn("_k", ahead + F.col("_n")).drop("path", "_late")


def shape_audit(rooted: DataFrame, min_voxels: int, min_extent: int, max_components: int, by: str = "label") -> DataFrame:
    """(by, voxels, components, reasons) of labelled objects, from component roots of each label."""
    c = rooted.groupBy(by, "root").agg(F.count(F.lit(1)).alias("n"), *(F.min(a).alias(f"{a}0") for a in "xyz"), *(F.max(a).alias(f"{a}1") for a in "xyz"))
    o = c.groupBy(by).agg(F.sum("n").alias("voxels"), F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), *((F.max(f"{a}1") - F.min(f"{a}0") + 1).alias(f"e{a}") for a in "xyz"))
    least, most = F.least("ex", "ey", "ez"), F.greatest("ex", "ey", "ez")
    why = F.array_compact(
        F.array(
            F.when(F.col("voxels") < min_voxels, "low-volume"),
            F.when(least < min_extent, "flat-or-clipped"),
            F.when((F.col("components") > max_components) & (F.col("largest") / F.greatest("voxels", F.lit(1)) < 0.985), "fragmented"),
            F.when(most / F.greatest(least, F.lit(1)) > 7, "extreme-aspect"),
        )
    )
    return o.select(by, "voxels", "components", why.alias("reasons"))


def tooth_library(vox: DataFrame, mask: DataFrame, grid: Grid, core: float, noise: int = 200, least: int = 4000, most: int = 64) -> DataFrame:
    """Separated objects of a mask, largest first: size, bounds, centroid, quality; small ones are left out."""
    b = written(watershed(vox, mask, grid, core), "library").withColumnRenamed("label", "root")
    s = masks.component_stats(b).where(F.col("voxels") >= max(noise, least))
    w = Window.partitionBy("volume_id").orderBy(F.desc("voxels"), "comp")
    s = s.withColumn("label", F.row_number().over(w).cast("long")).where(F.col("label") <= most)
    return objects.quality(s.withColumns({f"e{c}": F.col(f"{c}1") - F.col(f"{c}0") for c in "zyx"}))


def skin_mask(vox: DataFrame, grid: Grid, out: Grid, air: int = -400) -> DataFrame:
    """Largest component of the tissue above air on a coarser grid, its holes filled."""
    coarse = written(resample_nearest(vox, grid, out).withColumn("i", out.index(F.col("x"), F.col("y"), F.col("z"))).select("volume_id", *(F.col(c).cast("long") for c in ("i", "x", "y", "z", "v"))), "skin")
    body = written(masks.keep_largest(written(masks.component_roots(masks.threshold(coarse, air, 32767), out, 26), "skin-roots")), "skin-body")
    return masks.fill_holes(coarse, body, out)


#: Presets of a surface: how it is made from a mask (fixed values).
SURFACES = {
    "draft": {"smooth": 0, "reduction": 0.5},
    "balanced": {"smooth": 6, "reduction": 0.35},
    "final": {"smooth": 12, "reduction": 0.0},
}
COARSE = 750_000  # voxels above which a surface is made of every second voxel


def surface_of(vox: DataFrame, mask: DataFrame, grid: Grid, preset: str = "balanced") -> tuple[DataFrame, DataFrame]:
    """Triangles of a mask's largest body with its holes filled, and (volume_id, voxels, volume_mm3, area_mm2, triangles, stride, error).

    A volume without voxels has the error E_EMPTY. Volumes with more than ``COARSE`` voxels are meshed at stride 2.
    """
    from voxloom.operators import mesh

    made = SURFACES[preset]
    filled = written(masks.fill_holes(vox, mask, grid), "surface-filled")
    body = written(masks.mask_rows(masks.keep_largest(written(masks.component_roots(filled, grid, 26), "surface-roots"))), "surface-body")
    count = body.groupBy("volume_id").agg(F.count(F.lit(1)).alias("voxels")).withColumn("stride", F.when(F.col("voxels") > COARSE, 2).otherwise(1))
    half = Grid(-(-grid.width // 2), -(-grid.height // 2), -(-grid.depth // 2), grid.sx * 2, grid.sy * 2, grid.sz * 2)
    triangles = None
    for stride, g in ((1, grid), (2, half)):
        rows = body.join(count.where(F.col("stride") == stride).select("volume_id"), "volume_id", "left_semi")
        t = mesh.iso_triangles(rows if stride == 1 else masks.downsample_any(rows, 2), g)
        triangles = t if triangles is None else triangles.unionByName(t)
    triangles = mesh.decimated(triangles, made["reduction"], ["x", "y", "z", "t"])
    triangles = mesh.smoothed(triangles, made["smooth"]) if made["smooth"] else triangles
    area = masks.surface_estimates(body, grid)
    share = F.ceil(F.col("triangles") / (F.col("stride") * F.col("stride")) * (1 - made["reduction"]))
    whole = vox.select("volume_id").distinct().join(count, "volume_id", "left").join(area, "volume_id", "left")
    stats = whole.select("volume_id", F.coalesce("voxels", F.lit(0)).alias("voxels"), (F.coalesce("voxels", F.lit(0)) * (grid.sx * grid.sy * grid.sz)).alias("volume_mm3"), F.coalesce("area_mm2", F.lit(0.0)).alias("area_mm2"), F.coalesce(share, F.lit(0)).cast("long").alias("triangles"), "stride", F.when(F.col("voxels").isNull(), "E_EMPTY").alias("error"))
    return triangles, stats
