"""Objects found in volumes: quality, numbering, review, and the study catalogue."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUADRANTS = {1: "Upper Right", 2: "Upper Left", 3: "Lower Left", 4: "Lower Right"}
POSITIONS = ["Central Incisor", "Lateral Incisor", "Canine", "First Premolar", "Second Premolar", "First Molar", "Second Molar", "Third Molar"]

#: Limits of a sound object, and two names of each reason: as the library lists it and as the curation does (fixed values).
LEAST_VOXELS, MOST_VOXELS = 10_000, 140_000
LEAST_EXTENT, MOST_EXTENT = 18, (115, 95, 100)
LEAST_CENTER, MOST_CENTER = (55, 55, 95), (260, 380, 520)
GOOD_VOXELS, LEAST_GOOD_EXTENT, MOST_GOOD_EXTENT = (18_000, 120_000), 22, (105, 90, 95)
REASONS = ("low-volume", "high-volume", "flat-or-clipped", "oversized", "off-arch-z", "off-arch-y", "off-arch-x")
CURATION_REASONS = ("small-fragment", "large-region", "thin-fragment", "broad-region", "z-outlier", "y-outlier", "x-outlier")


def quality(objects: DataFrame, names: tuple[str, ...] = REASONS) -> DataFrame:
    """``objects`` (voxels, ez, ey, ex, cz, cy, cx) with quality_status, quality_reasons and quality_score."""
    extents = [F.col(c) for c in ("ez", "ey", "ex")]
    over = lambda most: [e > m for e, m in zip(extents, most, strict=True)]
    fails = [
        F.col("voxels") < LEAST_VOXELS,
        F.col("voxels") > MOST_VOXELS,
        F.least(*extents) < LEAST_EXTENT,
        reduce(or_, over(MOST_EXTENT)),
        *(~F.col(c).between(lo, hi) for c, lo, hi in zip(("cz", "cy", "cx"), LEAST_CENTER, MOST_CENTER, strict=True)),
    ]
    reasons = F.array_compact(F.array(*(F.when(f, F.lit(r)) for f, r in zip(fails, names, strict=True))))
    fits = (F.least(*extents) >= LEAST_GOOD_EXTENT) & ~reduce(or_, over(MOST_GOOD_EXTENT))
    score = 1.0 - 0.18 * F.size(reasons) + F.when(F.col("voxels").between(*GOOD_VOXELS), 0.12).otherwise(0.0) + F.when(fits, 0.12).otherwise(0.0)
    score = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 1000 + 0.5) / 1000
    status = F.when(F.size(reasons) == 0, "accepted").otherwise("review")
    return objects.withColumns({"quality_reasons": reasons, "quality_status": status, "quality_score": score})


def number_arch(objects: DataFrame, jaw: Column, by: str = "volume_id", left=(1.0, 0.0, 0.0), anterior=(0.0, -1.0, 0.0)) -> DataFrame:
    """``objects`` (by, id, x, y, z) with quadrant, position and number, for the given axes.

    Each jaw is centred, split by the sign along ``left`` and ranked by the angle from the front. A volume
    has tens of objects, so a window by volume is bounded.
    """
    o = objects.withColumn("jaw", jaw)
    whole = Window.partitionBy(by, "jaw")
    d = [F.col(c) - F.avg(c).over(whole) for c in "xyz"]
    along = lambda a: sum((v * k for v, k in zip(d[1:], a[1:], strict=True)), d[0] * a[0])
    o = o.withColumns({"lr": along(left), "ap": along(anterior)})
    o = o.withColumn("side", F.when(F.col("lr") >= 0, "left").otherwise("right"))
    w = Window.partitionBy(by, "jaw", "side").orderBy(F.atan2(F.abs("lr"), F.col("ap")), "id")
    quadrant = F.when(F.col("jaw") == "upper", F.when(F.col("side") == "left", 2).otherwise(1)).otherwise(F.when(F.col("side") == "left", 3).otherwise(4))
    o = o.withColumns({"quadrant": quadrant, "position": F.least(F.row_number().over(w), F.lit(8))})
    return o.withColumn("fdi", F.col("quadrant") * 10 + F.col("position")).drop("lr", "ap", "side")


def split_jaws(objects: DataFrame, by: str = "volume_id", superior=(0.0, 0.0, 1.0)) -> DataFrame:
    """``objects`` with jaw: upper from the upper median along ``superior`` on."""
    s = F.col("x") * superior[0] + F.col("y") * superior[1] + F.col("z") * superior[2]
    o = objects.withColumn("_s", s)
    n = o.where("_s is not null").groupBy(F.col(by).alias("_by"), "_s").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_by")
    n = n.withColumns({"_upto": F.sum("_n").over(w.orderBy("_s")), "_all": F.sum("_n").over(w)})
    mid = n.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy("_by").agg(F.min("_s").alias("_mid"))  # one row a group
    o = o.join(mid, F.col(by).eqNullSafe(F.col("_by")), "left")
    return o.withColumn("jaw", F.when(F.col("_s") >= F.col("_mid"), "upper").otherwise("lower")).drop("_s", "_by", "_mid")


def tooth_names(spark) -> DataFrame:
    rows = [(q * 10 + p, f"{name} {POSITIONS[p - 1]}") for q, name in QUADRANTS.items() for p in range(1, 9)]
    return spark.createDataFrame(rows, "fdi long, fdi_name string")


def review_counts(objects: DataFrame, overrides: DataFrame, *by: str) -> DataFrame:
    """Objects by status, where a reviewer's status goes before the computed one."""
    status = F.coalesce("override", "quality_status", F.lit("accepted"))
    o = objects.join(overrides, "id", "left").withColumn("status", status)
    n = lambda s: F.count_if(F.col("status") == s)
    return o.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), n("accepted").alias("accepted"), n("review").alias("review"), n("rejected").alias("rejected"), F.count_if(F.col("status") != "rejected").alias("visible"))


def live(rows: DataFrame) -> DataFrame:
    """Rows that are not softly deleted: no time of deletion, or 0."""
    return rows.where(F.col("deleted_at").isNull() | (F.col("deleted_at") == 0))


def latest_first(rows: DataFrame) -> DataFrame:
    return live(rows).orderBy(F.desc("updated_at"), "id")


def patched(rows: DataFrame, patch: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """``rows`` with the non-null values of ``patch`` and a new updated_at where a live row is patched."""
    cols = [c for c in patch.columns if c != key]
    p = patch.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in cols), F.lit(True).alias("_hit"))
    o = rows.join(p, key, "left")
    is_live = F.col("deleted_at").isNull() | (F.col("deleted_at") == 0)
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & is_live
    out = {c: F.when(hit, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in cols} | {"updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}
    return o.withColumns(out).select(*rows.columns)


def softly_deleted(rows: DataFrame, gone: DataFrame, now: Column, key: str = "id") -> DataFrame:
    o = rows.join(gone.select(key, F.lit(True).alias("_gone")), key, "left")
    return o.withColumn("deleted_at", F.when(F.col("_gone") & (F.coalesce("deleted_at", F.lit(0)) == 0), now).otherwise(F.col("deleted_at"))).select(*rows.columns)


def undo_stack(log: DataFrame, session: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), cap: int = 24) -> DataFrame:
    """The last ``cap`` edits of every session, newest first as depth 1."""
    w = Window.partitionBy(session).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("depth", F.row_number().over(w)).where(F.col("depth") <= cap)


def slice_gaps(slices: DataFrame, by: str, position: str) -> DataFrame:
    """Distinct positions whose predecessor is not one less."""
    w = Window.partitionBy(by).orderBy(position)
    s = slices.select(by, position).distinct().withColumn("before", F.lag(position).over(w))
    return s.where(F.col("before").isNotNull() & (F.col(position) != F.col("before") + 1))


def median_spacing(slices: DataFrame, by: str, location: str, fallback: list[str] | None = None) -> DataFrame:
    """Upper median of the steps over 1e-6 between sorted locations; where there is none, the first of the columns ``fallback``
    that the first slice has other than 0, or 0; without ``fallback`` null."""
    w = Window.partitionBy(by).orderBy(location)
    step = F.abs(F.col(location) - F.lag(location).over(w))
    s = slices.withColumn("_d", step)
    d = F.array_sort(F.collect_list(F.when(F.col("_d") > 1e-6, F.col("_d"))))
    middle = F.try_element_at("d", (F.floor(F.size("d") / 2) + 1).cast("int"))
    if fallback is None:
        return s.groupBy(by).agg(d.alias("d")).select(by, middle.alias("spacing"))
    first = F.min_by(F.struct(*(F.col(c).cast("double").alias(c) for c in fallback)), location)
    given = F.coalesce(*(F.nullif(F.col(f"f.{c}"), F.lit(0.0)) for c in fallback), F.lit(0.0))
    return s.groupBy(by).agg(d.alias("d"), first.alias("f")).select(by, F.coalesce(middle, given).alias("spacing"))


#: What the slices of a stack must have in common.
SAME = ("rows", "columns", "bits_allocated", "pixel_representation")


def stack_errors(slices: DataFrame, by: str, usable: Column, same: tuple[str, ...] = SAME) -> DataFrame:
    """(by, files, slices, error) of folders of slices: E_DICOM_COUNT for fewer than two files, E_DICOM_UNSUPPORTED for fewer than two
    ``usable`` ones, E_DICOM_MISMATCH where usable ones differ in ``same``; null where they make a stack."""
    shape = F.struct(*same)
    good = F.coalesce(usable, F.lit(False))
    g = slices.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.count_if(good).alias("slices"), F.min(F.when(good, shape)).alias("_a"), F.max(F.when(good, shape)).alias("_b"))
    error = F.when(F.col("files") < 2, "E_DICOM_COUNT").when(F.col("slices") < 2, "E_DICOM_UNSUPPORTED").when(~F.col("_a").eqNullSafe(F.col("_b")), "E_DICOM_MISMATCH")
    return g.select(by, "files", "slices", error.alias("error"))


def pick_series(slices: DataFrame, series: str, position: str, localizer: Column, by: str | None = None) -> DataFrame:
    """Series by rank, within a study or patient where ``by`` names it: no localizer first, then most different positions, then fewest duplicates."""
    keys = [by] if by else []
    s = slices.groupBy(*keys, series).agg(F.max(localizer).alias("localizer"), F.count_distinct(position).alias("slices"), (F.count(F.lit(1)) - F.count_distinct(position)).alias("duplicates"))
    # one row a series: ranking them is small beside the slices
    w = Window.partitionBy(*keys) if by else Window.partitionBy(F.lit(0))
    return s.withColumn("rank", F.row_number().over(w.orderBy("localizer", F.desc("slices"), "duplicates", series)).cast("long"))
