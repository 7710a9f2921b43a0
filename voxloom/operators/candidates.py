"""Candidate regions and instances: parsing, choosing, relabelling, and lists of what is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.workflows import greedy_apart

#: Sizes, region (z, y, x bounds) and most labels of the offline library (fixed values).
LIBRARY_VOXELS, LIBRARY_BOX, LIBRARY_LABELS = (1500, 180_000), ((45, 300), (45, 440), (80, 575)), 33


def parsed_rois(text: Column) -> Column:
    """Array of (z0, y0, x0, z1, y1, x1) of a text of whole numbers in groups of six; null if they do not come out even or one is no number."""
    n = F.filter(F.split(F.trim(text), r"\s+"), lambda p: p != "")
    v = F.transform(n, lambda p: p.try_cast("long"))
    ok = (F.size(v) % 6 == 0) & ~F.exists(v, lambda x: x.isNull())
    names = ("z0", "y0", "x0", "z1", "y1", "x1")
    group = lambda k: F.struct(*(F.element_at(v, (k * 6 + j + 1).cast("int")).alias(c) for j, c in enumerate(names)))
    none = F.array().cast(f"array<struct<{','.join(f'{c}:bigint' for c in names)}>>")
    return F.when(ok & (F.size(v) > 0), F.transform(F.sequence(F.lit(0), (F.size(v) / 6).cast("int") - 1), group)).when(ok, none)


def library_items(objects: DataFrame, *by: str, voxels: tuple[int, int] = LIBRARY_VOXELS, box=LIBRARY_BOX, most: int = LIBRARY_LABELS) -> DataFrame:
    """``objects`` (id, voxels, cz, cy, cx) of fitting size and place, labelled from the largest on, ``most`` at the most."""
    fits = F.col("voxels").between(*voxels)
    for c, (lo, hi) in zip(("cz", "cy", "cx"), box, strict=True):
        fits = fits & F.col(c).between(lo, hi)
    order = (F.desc("voxels"), F.col("id"))
    # without groups only the first ``most`` rows, which tasks choose each on their own, are numbered
    rows, w = (objects.where(fits), Window.partitionBy(*by)) if by else (objects.where(fits).orderBy(*order).limit(most), Window.partitionBy(F.lit(0)))
    return rows.withColumn("label", F.row_number().over(w.orderBy(*order)).cast("long")).where(F.col("label") <= most)


def pruned_instances(instances: DataFrame, by: str, distance: float) -> DataFrame:
    """``instances`` (by, id, voxels, x, y) with label: from the largest on those nearer than ``distance`` to a kept one
    go (label 0, reason duplicate-centroid), and the others are numbered in the order of their ids."""
    kept = greedy_apart(instances, by, [("voxels", "descending"), ("id", "ascending")], distance)
    nth = F.row_number().over(Window.partitionBy(by, "kept").orderBy("id"))
    return kept.withColumns({"label": F.when(F.col("kept"), nth).otherwise(0).cast("long"), "reason": F.when(~F.col("kept"), "duplicate-centroid")}).drop("place")


def relabelled(labelmap: DataFrame, instances: DataFrame) -> DataFrame:
    """``labelmap`` (volume_id, i, label: the instance's id) with the labels that instances got; 0 for those that went."""
    new = instances.select(F.col("id").alias("label"), F.col("label").alias("_new"))
    return labelmap.join(new, "label", "left").withColumn("label", F.coalesce("_new", F.lit(0))).drop("_new")


def manifest_lines(items: DataFrame, *columns: str) -> DataFrame:
    """(label, value): a JSON object of each item, to be written as lines of text."""
    return items.select("label", F.to_json(F.struct("label", *columns)).alias("value"))
