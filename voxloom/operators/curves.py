"""Arch curves: control points, splines, arc length and curved reformation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions.jsnum import clamp
from voxloom.operators.voxels import Grid, axial_mip

PER_SEGMENT = 32


def catmull_rom(points: DataFrame, per_segment: int = PER_SEGMENT) -> DataFrame:
    """Dense polyline (curve, k, x, y) through control points (curve, ord, x, y), end points doubled."""
    w = Window.partitionBy("curve").orderBy("ord")
    q = points
    for c in ("x", "y"):
        q = q.withColumns({f"{c}0": F.coalesce(F.lag(c).over(w), F.col(c)), f"{c}2": F.lead(c).over(w), f"{c}3": F.coalesce(F.lead(c, 2).over(w), F.lead(c).over(w))})
    q = q.withColumns({"seg": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("curve"))}).where("x2 is not null")
    last = F.when(F.col("seg") == F.col("n") - 2, per_segment).otherwise(per_segment - 1)
    q = q.withColumn("j", F.explode(F.sequence(F.lit(0), last)))
    t = F.col("j") / per_segment
    at = lambda c: 0.5 * (2 * F.col(c) + (F.col(f"{c}2") - F.col(f"{c}0")) * t + (2 * F.col(f"{c}0") - 5 * F.col(c) + 4 * F.col(f"{c}2") - F.col(f"{c}3")) * t * t + (3 * F.col(c) - F.col(f"{c}0") - 3 * F.col(f"{c}2") + F.col(f"{c}3")) * t * t * t)
    return q.select("curve", (F.col("seg") * per_segment + F.col("j")).alias("k"), at("x").alias("x"), at("y").alias("y"))


def arc_length(line: DataFrame) -> DataFrame:
    """``line`` (curve, k, x, y) with cum, the length up to each sample."""
    w = Window.partitionBy("curve").orderBy("k")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return line.withColumn("_s", step).withColumn("cum", F.sum("_s").over(w)).drop("_s")


def resampled(line: DataFrame, step: float) -> DataFrame:
    """Even samples (curve, k, x, y, nx, ny) along a polyline, with unit normals; each finds its bracket by length."""
    a = arc_length(line)
    w = Window.partitionBy("curve").orderBy("k")
    seg = a.withColumns({"nxt": F.lead("cum").over(w), "bx": F.lead("x").over(w), "by": F.lead("y").over(w)}).where("nxt > cum")
    # samples of a bracket are made from the bracket, so nothing is joined by range
    first, last = F.ceil(F.col("cum") / step), F.ceil(F.col("nxt") / step) - 1
    s = seg.where(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    t = (F.col("k") * step - F.col("cum")) / (F.col("nxt") - F.col("cum"))
    length = F.hypot(F.col("bx") - F.col("x"), F.col("by") - F.col("y"))
    return s.select("curve", "k", (F.col("x") + t * (F.col("bx") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("by") - F.col("y"))).alias("y"), (-(F.col("by") - F.col("y")) / length).alias("nx"), ((F.col("bx") - F.col("x")) / length).alias("ny"))


def arch_sums(vox: DataFrame, z0: int, z1: int) -> DataFrame:
    """Weighted sums of the quadratic fit y = a x2 + b x + c to the bright part of the axial maximum."""
    mip = axial_mip(vox, z0, z1)
    r = mip.groupBy("volume_id").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    t = F.col("lo") + 0.55 * (F.col("hi") - F.col("lo"))
    p = mip.join(r, "volume_id").where(F.col("v") >= t).withColumn("w", F.col("v") - t)
    x, y, w = F.col("x").cast("double"), F.col("y").cast("double"), F.col("w")
    sums = {"s0": w, "sx": w * x, "sx2": w * x * x, "sx3": w * x * x * x, "sx4": w * x * x * x * x, "sy": w * y, "sxy": w * x * y, "sx2y": w * x * x * y}
    return p.groupBy("volume_id").agg(*(F.sum(e).alias(k) for k, e in sums.items()), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.count(F.lit(1)).alias("n"))


def arch_fit(vox: DataFrame, grid: Grid, z0: int, z1: int, points: int = 7) -> DataFrame:
    """Control points (volume_id, ord, x, y) along the fitted parabola; a gentle one where the fit fails."""
    s = arch_sums(vox, z0, z1)
    m = [["sx4", "sx3", "sx2"], ["sx3", "sx2", "sx"], ["sx2", "sx", "s0"]]
    rhs = ["sx2y", "sxy", "sy"]

    def det(a):
        c = lambda r, k: F.col(a[r][k])
        return c(0, 0) * (c(1, 1) * c(2, 2) - c(1, 2) * c(2, 1)) - c(0, 1) * (c(1, 0) * c(2, 2) - c(1, 2) * c(2, 0)) + c(0, 2) * (c(1, 0) * c(2, 1) - c(1, 1) * c(2, 0))

    whole = det(m)
    sol = [det([[rhs[r] if k == j else m[r][k] for k in range(3)] for r in range(3)]) / F.nullif(whole, F.lit(0.0)) for j in range(3)]
    s = s.withColumns({"a": sol[0], "b": sol[1], "c": sol[2]}).withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    ok = (F.col("n") >= 32) & F.col("a").isNotNull()
    t = F.col("ord") / (points - 1)
    x = F.when(ok, F.col("x_lo") + F.greatest(F.lit(1), F.col("x_hi") - F.col("x_lo")) * t).otherwise(grid.width * 0.2 + grid.width * 0.6 * t)
    s = s.withColumn("x", x)
    bend = (t - 0.5) * 2
    y = F.when(ok, clamp(F.col("a") * F.col("x") * F.col("x") + F.col("b") * F.col("x") + F.col("c"), 0.0, float(grid.height - 1))).otherwise(grid.height * 0.45 + grid.height * 0.18 * (1 - bend * bend))
    return s.select("volume_id", "ord", "x", y.alias("y"))


def curved_reformation(vox: DataFrame, grid: Grid, samples: DataFrame, z0: int, z1: int, depth_mm: float = 10.0, step_mm: float = 0.5, mean: bool = True) -> DataFrame:
    """(volume_id, row, col, v): for each sample (volume_id, k, x, y, nx, ny in mm) and slice, the mean or maximum
    of bilinear values along the normal; row 0 is the highest slice and offsets outside of the slice are left out."""
    step = max(0.05, step_mm)
    count = max(1, int((2 * depth_mm) // step) + 1)
    s = samples.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    off = F.col("b") * step - depth_mm
    s = s.withColumns({"px": (F.col("x") + F.col("nx") * off) / grid.sx, "py": (F.col("y") + F.col("ny") * off) / grid.sy})
    s = s.where(F.col("px").between(0, grid.width - 1) & F.col("py").between(0, grid.height - 1))
    fx, fy = F.col("px") - F.floor("px"), F.col("py") - F.floor("py")
    corner = [F.struct((F.floor("px") + a).alias("cx"), (F.floor("py") + b).alias("cy"), ((fx if a else 1 - fx) * (fy if b else 1 - fy)).alias("w")) for b in (0, 1) for a in (0, 1)]
    c = s.withColumn("c", F.explode(F.array(*corner))).where("c.w > 0").select("volume_id", "k", "b", F.col("c.cx").alias("x"), F.col("c.cy").alias("y"), "c.w")
    band = vox.where(F.col("z").between(z0, z1)).select("volume_id", F.col("x").cast("long"), F.col("y").cast("long"), "z", "v")
    value = band.join(c, ["volume_id", "x", "y"]).groupBy("volume_id", "k", "z", "b").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return value.groupBy("volume_id", F.col("k").alias("col"), (z1 - F.col("z")).alias("row")).agg((F.avg if mean else F.max)("v").alias("v"))


def _to_segment(p: Column, a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(n, F.lit(0.0)))))
    return F.hypot(p["x"] - (a["x"] + t * dx), p["y"] - (a["y"] + t * dy))


def insert_place(curve: Column, p: Column) -> Column:
    """Place (from 0) at which a point joins the control points of a curve: in its nearest segment, or before or after the nearer end."""
    n = F.size(curve)
    each = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(_to_segment(p, F.element_at(curve, k), F.element_at(curve, k + 1)).alias("d"), k.alias("k")))
    near = F.array_min(each)
    ends = [F.hypot(p["x"] - e["x"], p["y"] - e["y"]) for e in (F.element_at(curve, 1), F.element_at(curve, n))]
    inside = F.when((ends[0] < near["d"]) & (ends[0] <= ends[1]), 0).when(ends[1] < near["d"], n).otherwise(near["k"])
    return F.when(n < 2, n).otherwise(inside)


def with_control_point(curve: Column, p: Column) -> Column:
    at = insert_place(curve, p)
    return F.concat(F.slice(curve, F.lit(1), at), F.array(p), F.slice(curve, at + 1, F.size(curve)))


def without_control_point(curve: Column, at: Column) -> Column:
    """The curve without its point at a place (from 0), if more than two are there."""
    return F.when(F.size(curve) > 2, F.filter(curve, lambda _, k: k != at)).otherwise(curve)
