"""Whole analyses of scans, composed of the operators: anatomy by a model, objects of a region with their meshes, the face's surface."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators import masks, mesh, objects, workflows
from voxloom.operators.inference import ANATOMY, ModelConfig, segment_region, segment_volume
from voxloom.operators.staging import written
from voxloom.operators.voxels import Grid
from voxloom.operators.watershed import watershed

#: Classes of the anatomy model: value, key, name, colour (fixed values).
ANATOMY_LABELS = [
    (1, "upperSkull", "Upper Skull", "#d8c3a5"),
    (2, "mandible", "Mandible", "#e8a87c"),
    (3, "upperTeeth", "Upper Teeth", "#54b6e8"),
    (4, "lowerTeeth", "Lower Teeth", "#70d878"),
    (5, "mandibularCanal", "Mandibular canal", "#ea5d5d"),
]
GROUP_NAME = "Full anatomy"
#: Edge of a region in voxels and distance of cores: default, least and most (fixed values); sizes of library objects.
REGION_EDGE, SEPARATION = (160, 96, 240), (7, 3, 16)
NOISE, LEAST, MOST = 200, 4000, 64
FACE_MM, AIR = 0.7, -400


def segment_groups(labels: DataFrame, grid: Grid, classes: list[tuple] = ANATOMY_LABELS, name: str = GROUP_NAME) -> DataFrame:
    """(volume_id, name, active_value, segments) of label maps (volume_id, label): a segment (value, key, name, color, voxels, volume_mm3)
    for each class, also of those that a volume does not hold; the first one is active. A volume without any class has a group too."""
    n = labels.groupBy("volume_id", F.col("label").cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    spark = labels.sparkSession
    known = F.broadcast(spark.createDataFrame([(v, k, t, c) for v, k, t, c in classes], "value long, key string, title string, color string"))
    each = labels.select("volume_id").distinct().crossJoin(known).join(n, ["volume_id", "value"], "left")  # the classes are few and fixed
    voxels = F.coalesce("n", F.lit(0))
    segment = F.struct("value", "key", F.col("title").alias("name"), "color", voxels.alias("voxels"), (voxels * (grid.sx * grid.sy * grid.sz)).alias("volume_mm3"))
    got = each.groupBy("volume_id").agg(F.array_sort(F.collect_list(segment)).alias("segments"))
    return got.select("volume_id", F.lit(name).alias("name"), F.col("segments")[0]["value"].alias("active_value"), "segments")


def anatomy(vox: DataFrame, grid: Grid, model: Callable, config: ModelConfig = ANATOMY, classes: list[tuple] = ANATOMY_LABELS) -> tuple[DataFrame, DataFrame]:
    """The label map of a whole scan by a model, and the segment group of each volume."""
    labels = written(segment_volume(vox, grid, model, config), "anatomy")
    return labels, segment_groups(labels, grid, classes)


@dataclass
class Library:
    """Objects of a region: items, their voxels (volume_id, label, x, y, z, from the item's corner on), triangles and previews; candidates by volume."""

    items: DataFrame
    submasks: DataFrame
    triangles: DataFrame
    previews: DataFrame
    candidates: DataFrame


def library(vox: DataFrame, mask: DataFrame, grid: Grid, core: float = SEPARATION[0], noise: int = NOISE, least: int = LEAST, most: int = MOST) -> Library:
    """Separated objects of a mask, the ``most`` largest of at least ``least`` voxels labelled 1, 2, ... from the largest on.

    Items have their size, bounds, centroid and quality in the whole volume. ``candidates`` counts what is over the
    ``noise`` floor. Meshes are made of each object alone, in millimetres of the whole volume.
    """
    basins = written(watershed(vox, mask, grid, core), "library-basins").withColumnRenamed("label", "root")
    s = written(masks.component_stats(basins), "library-stats")
    candidates = s.where(F.col("voxels") >= noise).groupBy("volume_id").agg(F.count(F.lit(1)).alias("candidates"))
    w = Window.partitionBy("volume_id").orderBy(F.desc("voxels"), "comp")
    kept = s.where(F.col("voxels") >= least).withColumn("label", F.row_number().over(w).cast("long")).where(F.col("label") <= most)
    items = written(objects.quality(kept.withColumns({f"e{c}": F.col(f"{c}1") - F.col(f"{c}0") for c in "zyx"})), "library-items")
    own = written(basins.join(items.select("volume_id", "root", "label", "x0", "y0", "z0"), ["volume_id", "root"]).select("volume_id", "label", "i", "x", "y", "z", "x0", "y0", "z0"), "library-voxels")
    submasks = own.select("volume_id", "label", *((F.col(c) - F.col(f"{c}0")).alias(c) for c in "xyz"))
    # an object's mesh is a volume of its own: volume and label as one number
    alone = own.select((F.col("volume_id") * (most + 1) + F.col("label")).alias("volume_id"), "x", "y", "z")
    made = mesh.iso_triangles(alone, grid)
    triangles = made.withColumns({"label": F.col("volume_id") % (most + 1), "volume_id": F.floor(F.col("volume_id") / (most + 1))})
    front = submasks.groupBy("volume_id", "label", "z", "x").agg(F.count(F.lit(1)).alias("n"))
    height = items.select("volume_id", "label", F.col("ey").alias("_h"))
    previews = front.join(height, ["volume_id", "label"]).select("volume_id", "label", "z", "x", (0.45 + 0.55 * F.least(F.lit(1.0), F.col("n") / F.greatest(F.lit(1.0), F.col("_h") * 0.5))).alias("intensity"))
    return Library(items, submasks, triangles, previews, candidates)


def region_library(vox: DataFrame, grid: Grid, model: Callable, center: tuple[int, int, int], edge: int = REGION_EDGE[0], core: float = SEPARATION[0], window: tuple[int, int, int] = (96, 96, 96), **sizes) -> Library:
    """Objects that a model finds in a cube around ``center``: the probability in the region, its mask over one half, and its separation.

    Edge and core are held within their bounds; the cube is cut off at the volume's ends.
    """
    edge = int(min(max(edge, REGION_EDGE[1]), REGION_EDGE[2], max(REGION_EDGE[1], max(grid.width, grid.height, grid.depth))))
    core = float(min(max(core, SEPARATION[1]), SEPARATION[2]))
    half, size = int(np.floor(edge / 2 + 0.5)), (grid.width, grid.height, grid.depth)
    lo = tuple(min(max(0, c - half), n) for c, n in zip(center, size, strict=True))
    hi = tuple(max(a + 1, min(max(0, c + half), n)) for a, c, n in zip(lo, center, size, strict=True))
    found = written(segment_region(vox, grid, model, lo, hi, window).select("volume_id", "i"), "region-mask")
    mask = vox.join(found, ["volume_id", "i"], "left_semi").select("volume_id", "i", "x", "y", "z")
    return library(vox, mask, grid, core, **sizes)


def face_surface(vox: DataFrame, grid: Grid, spacing: float = FACE_MM, air: int = AIR, preset: str = "draft") -> tuple[DataFrame, DataFrame]:
    """Triangles of the skin of each volume, and (volume_id, voxels, volume_mm3, triangles): tissue on a coarser grid, its largest body, filled, meshed, thinned."""
    size = [max(1, int(np.floor(n * s / spacing + 0.5))) for n, s in ((grid.width, grid.sx), (grid.height, grid.sy), (grid.depth, grid.sz))]
    out = Grid(*size, *(n * s / k for k, n, s in zip(size, (grid.width, grid.height, grid.depth), (grid.sx, grid.sy, grid.sz), strict=True)))
    skin = written(workflows.skin_mask(vox, grid, out, air), "face-skin")
    made = workflows.SURFACES[preset]
    triangles = mesh.decimated(mesh.iso_triangles(skin, out), made["reduction"], ["x", "y", "z", "t"])
    triangles = written(mesh.smoothed(triangles, made["smooth"]) if made["smooth"] else triangles, "face-triangles")
    count = triangles.groupBy("volume_id").agg(F.count(F.lit(1)).alias("triangles"))
    stats = skin.groupBy("volume_id").agg(F.count(F.lit(1)).alias("voxels")).join(count, "volume_id", "left")
    return triangles, stats.select("volume_id", "voxels", (F.col("voxels") * (out.sx * out.sy * out.sz)).alias("volume_mm3"), F.coalesce("triangles", F.lit(0)).alias("triangles"))
