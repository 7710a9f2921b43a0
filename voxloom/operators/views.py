"""What a viewer derives from volumes: previews, colours, bounds, probes, crops, overlays and marks, as columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions.jsnum import clamp, round_half_up
from voxloom.operators.voxels import Grid

#: Control points (place, red, green, blue) of the colour maps (fixed values).
COLORMAPS = {
    "grayscale": [(0.0, 18, 18, 18), (1.0, 255, 255, 255)],
    "bone": [(0.0, 6, 8, 16), (0.5, 92, 104, 124), (1.0, 236, 244, 255)],
    "hot": [(0.0, 8, 0, 0), (0.4, 184, 28, 0), (0.72, 255, 162, 28), (1.0, 255, 255, 224)],
    "viridis": [(0.0, 68, 1, 84), (0.33, 59, 82, 139), (0.66, 33, 145, 140), (1.0, 253, 231, 37)],
}
#: Bounds of the window and level controls, and pixels of a drag over their whole range (fixed values).
WINDOW_BOUNDS, LEVEL_BOUNDS, DRAG_PIXELS = (256, 4095), (-1024, 3071), 300
FALLBACK_COLOR = (56, 189, 248)  # fixed value
SEED_COLORS = {"foreground": (34, 197, 94), "background": (248, 113, 113)}  # fixed values
MOST_EDGE = 512  # longest edge of a preview


def rgba(gray: Column) -> Column:
    return F.array(gray, gray, gray, F.lit(255))


def window_pixel(v: Column, center: Column | float, width: Column | float) -> Column:
    """Display value of a scalar under a centre and width, without a least width; 0 to 255."""
    center, width = (c if isinstance(c, Column) else F.lit(float(c)) for c in (center, width))
    return clamp(round_half_up((v - (center - width / 2)) / F.greatest(F.lit(1.0), width) * 255), 0, 255)


def quantized(v: Column, lo: Column, hi: Column) -> Column:
    return round_half_up(clamp((v - lo) / F.greatest(F.lit(1.0), (hi - lo).cast("double")), 0.0, 1.0) * 255)


def preview(vox: DataFrame, grid: Grid, lo: float, hi: float, most: int = MOST_EDGE) -> tuple[DataFrame, Grid]:
    """Voxels of a preview with at most ``most`` voxels an edge, quantized to 0..255, and its grid.

    An output voxel takes the source voxel at the same share of the way between the first and the last.
    Each source voxel finds the output places that ask for it by a small table an axis.
    """
    dims = (grid.width, grid.height, grid.depth)
    scale = min(1.0, most / max(dims))
    out = [max(1, int(n * scale + 0.5)) for n in dims]
    made = Grid(*out, grid.sx / scale, grid.sy / scale, grid.sz / scale)
    rows = vox.select("volume_id", *(F.col(c).cast("long").alias(c) for c in "xyz"), quantized(F.col("v"), F.lit(lo), F.lit(hi)).alias("v"))
    for c, n, m in zip("xyz", out, dims, strict=True):
        if n == m:
            continue
        o = vox.sparkSession.range(n).select(F.col("id").alias(f"_{c}"))
        pick = F.lit(0) if n == 1 else clamp(round_half_up(F.col(f"_{c}") / (n - 1) * (m - 1)), 0, m - 1)
        places = o.select(f"_{c}", pick.cast("long").alias(c))
        rows = rows.join(F.broadcast(places), c).drop(c).withColumnRenamed(f"_{c}", c)  # at most ``most`` rows
    return rows.select("volume_id", made.index(F.col("x"), F.col("y"), F.col("z")).alias("i"), "x", "y", "z", "v"), made


def color_table(spark: SparkSession, style: str = "grayscale", opacity: float = 1.0) -> DataFrame:
    """(i, r, g, b, a) for i = 0..255: control points joined by straight lines, alpha on a ramp."""
    t = F.col("id") / 255
    stops = COLORMAPS.get(style, COLORMAPS["grayscale"])
    cols = {}
    for k, name in enumerate("rgb", 1):
        value = None
        for a, b in zip(stops, stops[1:], strict=False):
            part = round_half_up(a[k] + (b[k] - a[k]) * clamp((t - a[0]) / ((b[0] - a[0]) or 1.0), 0.0, 1.0))
            value = F.when(t <= b[0], part) if value is None else value.when(t <= b[0], part)
        cols[name] = value.otherwise(F.lit(stops[-1][k])).cast("long")
    alpha = round_half_up((10 + t * 245) * min(1.0, max(0.0, opacity))).cast("long")
    return spark.range(256).select(F.col("id").alias("i"), *(c.alias(n) for n, c in cols.items()), alpha.alias("a"))


def axis_scale(spacing: list[Column]) -> list[Column]:
    """Spacings by the least positive one, at least 0.5."""
    least = F.coalesce(F.array_min(F.filter(F.array(*spacing), lambda s: s > 0)), F.lit(1.0))
    return [F.greatest(F.lit(0.5), s / least) for s in spacing]


def window_bounds(lo: Column, hi: Column, window: Column) -> tuple[Column, Column]:
    return F.lit(WINDOW_BOUNDS[0]), F.greatest(F.lit(WINDOW_BOUNDS[1]), round_half_up(hi - lo), window)


def level_bounds(lo: Column, hi: Column, level: Column) -> tuple[Column, Column]:
    return F.least(F.lit(LEVEL_BOUNDS[0]), F.floor(lo)), F.greatest(F.lit(LEVEL_BOUNDS[1]), F.ceil(hi), level)


def is_sparse_axis(sx: Column, sy: Column, sz: Column) -> Column:
    return sz > F.greatest(sx, sy, F.lit(0.001)) * 3


def dragged(moves: DataFrame, by: str, order: str, start: tuple[float, float], window: tuple[float, float], level: tuple[float, float]) -> DataFrame:
    """(by, window, level) after the moves (dx, dy) of each drag in order.

    Each move is rounded and clamped before the next, so it is a fold over one drag's moves.
    """
    per_w, per_l = (max(1.0, b - a) / DRAG_PIXELS for a, b in (window, level))
    steps = F.array_sort(F.collect_list(F.struct(order, F.col("dx").cast("double").alias("dx"), F.col("dy").cast("double").alias("dy"))))

    def step(acc, m):
        w = clamp(round_half_up(acc["window"] - m["dy"] * per_w).cast("double"), *map(float, window))
        v = clamp(round_half_up(acc["level"] + m["dx"] * per_l).cast("double"), *map(float, level))
        return F.struct(w.alias("window"), v.alias("level"))

    begin = F.struct(F.lit(float(start[0])).alias("window"), F.lit(float(start[1])).alias("level"))
    return moves.groupBy(by).agg(steps.alias("m")).select(by, F.aggregate("m", begin, step).alias("e")).select(by, "e.window", "e.level")


def probe(points: DataFrame, vox: DataFrame, labels: DataFrame, segments: DataFrame) -> DataFrame:
    """``points`` (volume_id, i) with v and the name of the first segment (group, ord, value, name) that has the point's label.

    ``labels`` is (volume_id, group, i, label); groups and segments go in their order.
    """
    named = labels.join(segments.withColumnsRenamed({"value": "label"}), ["group", "label"])
    first = points.select("volume_id", "i").distinct().join(named, ["volume_id", "i"]).groupBy("volume_id", "i").agg(F.min_by("name", F.struct("group", "ord")).alias("segment"))
    return points.join(vox.select("volume_id", "i", "v"), ["volume_id", "i"], "left").join(first, ["volume_id", "i"], "left")


def crop_from_view(axis: str, low: tuple[Column, Column], high: tuple[Column, Column], size: tuple[int, int, int]) -> dict[str, Column]:
    """Bounds (both included) that a rectangle of a slice view sets; heights count from above, z from below."""
    at = lambda r, n: clamp(round_half_up(r * (n - 1)), 0, n - 1)
    w, h, d = size
    if axis == "axial":
        return {"x0": at(low[0], w), "x1": at(high[0], w), "y0": at(low[1], h), "y1": at(high[1], h)}
    side, n = ("x", w) if axis == "coronal" else ("y", h)
    return {f"{side}0": at(low[0], n), f"{side}1": at(high[0], n), "z0": at(1 - high[1], d), "z1": at(1 - low[1], d)}


def full_crop(size: tuple[Column, Column, Column]) -> dict[str, Column]:
    return {f"{c}0": F.lit(0) for c in "xyz"} | {f"{c}1": F.greatest(F.lit(0), n - 1) for c, n in zip("xyz", size, strict=True)}


def annotations_on_slice(notes: DataFrame, axis: str, cursor: int, size: tuple[int, int, int]) -> DataFrame:
    """Visible ``notes`` (x, y, z, visible) on a slice, with their place in the view as shares of its sides."""
    share = lambda c, n: F.col(c) / max(1, n - 1)
    w, h, d = size
    across, up, through = {"axial": (share("x", w), share("y", h), "z"), "coronal": (share("x", w), 1 - share("z", d), "y"), "sagittal": (share("y", h), 1 - share("z", d), "x")}[axis]
    return notes.where(F.col("visible") & (F.col(through) == cursor)).withColumns({"x_ratio": across, "y_ratio": up})


def hex_color(text: Column) -> list[Column]:
    """Red, green and blue of six hexadecimal digits; another text is the fallback colour."""
    s = F.replace(text, F.lit("#"), F.lit(""))
    ok = F.coalesce(s.rlike("^[0-9a-fA-F]{6}$"), F.lit(False))
    return [F.when(ok, F.conv(F.substring(s, 2 * k + 1, 2), 16, 10).cast("long")).otherwise(FALLBACK_COLOR[k]) for k in range(3)]


def label_overlay(gray: DataFrame, labels: DataFrame, segments: DataFrame, layer_opacity: float = 1.0) -> DataFrame:
    """``gray`` (volume_id, i, gray) with r, g, b after visible segments (value, color, opacity, visible) are laid over it."""
    shown = segments.where("visible").select(F.col("value").alias("label"), *(c.alias(f"_{n}") for n, c in zip("rgb", hex_color(F.col("color")), strict=True)), (round_half_up(clamp(F.col("opacity") * layer_opacity, 0.0, 1.0) * 180) / 255).alias("_a"))
    rows = gray.join(labels.select("volume_id", "i", "label"), ["volume_id", "i"], "left").join(shown, "label", "left")
    over = {n: F.when(F.col("_a").isNull(), F.col("gray").cast("double")).otherwise(F.col(f"_{n}") * F.col("_a") + F.col("gray") * (1 - F.col("_a"))) for n in "rgb"}
    return rows.withColumns(over).drop("_r", "_g", "_b", "_a", "label")


def seed_marks(seeds: DataFrame, axis: str, cursor: int, size: tuple[int, int, int], reach: int = 3) -> DataFrame:
    """(px, py, r, g, b) of the crosses of seeds (ord, x, y, z, kind) on a slice view: later seeds over earlier, centres white."""
    w, h, d = size
    across, down, through, wide, high = {
        "axial": (F.col("x"), F.col("y"), "z", w, h),
        "coronal": (F.col("x"), d - 1 - F.col("z"), "y", w, d),
        "sagittal": (F.col("y"), d - 1 - F.col("z"), "x", h, d),
    }[axis]
    arms = [(k, 0) for k in range(-reach, reach + 1)] + [(0, k) for k in range(-reach, reach + 1) if k]
    step = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in arms)))
    s = seeds.where(F.col(through) == cursor).select("ord", "kind", across.alias("sx"), down.alias("sy"), step.alias("d"))
    front = F.col("kind") == "foreground"
    center = (F.col("d.a") == 0) & (F.col("d.b") == 0)
    color = F.array(*(F.when(center, 255).when(front, a).otherwise(b) for a, b in zip(SEED_COLORS["foreground"], SEED_COLORS["background"], strict=True)))
    p = s.select("ord", (F.col("sx") + F.col("d.a")).alias("px"), (F.col("sy") + F.col("d.b")).alias("py"), color.alias("c"))
    p = p.where(F.col("px").between(0, wide - 1) & F.col("py").between(0, high - 1)).groupBy("px", "py").agg(F.max_by("c", "ord").alias("c"))
    return p.select("px", "py", *(F.col("c")[k].cast("long").alias(n) for k, n in enumerate("rgb")))


def mask_of_label(labelmap: DataFrame, value: int) -> DataFrame:
    return labelmap.where(F.col("label") == value).select("volume_id", "i", "x", "y", "z")


def labels_of_mask(mask: DataFrame, value: int) -> DataFrame:
    return mask.select("volume_id", "i", "x", "y", "z", F.lit(value).cast("long").alias("label"))


def next_segment_value(segments: DataFrame) -> DataFrame:
    """(group, value) for a segment to be added: one more than the group's largest."""
    return segments.groupBy("group").agg((F.coalesce(F.max("value"), F.lit(0)) + 1).alias("value"))


def without_segment(labelmap: DataFrame, value: int) -> DataFrame:
    """``labelmap`` with the voxels of a deleted segment set to 0."""
    return labelmap.withColumn("label", F.when(F.col("label") == value, F.lit(0)).otherwise(F.col("label")))
