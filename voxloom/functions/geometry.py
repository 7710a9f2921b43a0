"""Points, matrices and measures as columns and aggregates; small eigenproblems by group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once a row, however often ``f`` uses it: a lambda's argument is."""
    return F.transform(F.array(value), f)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Zero stays zero."""
    each = lambda p: F.transform(p["a"], lambda x: F.when(p["n"] == 0, 0.0).otherwise(x / F.nullif(p["n"], F.lit(0.0))))
    return once(a, lambda v: once(F.struct(v.alias("a"), norm(v).alias("n")), each))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cross(a: Column, b: Column) -> Column:

    def entries(p: Column) -> Column:
        a, b = p["a"], p["b"]
        return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])

    return once(F.struct(a.alias("a"), b.alias("b")), entries)


def distance(a: Column, b: Column, spacing=(1.0, 1.0, 1.0)) -> Column:
    return F.sqrt(sum(((b[k] - a[k]) * s) * ((b[k] - a[k]) * s) for k, s in enumerate(spacing)))


def angle_degrees(a: Column, b: Column, c: Column) -> Column:
    """Angle at ``b``; 0 where an arm has no length."""
    u, v = minus(a, b), minus(c, b)
    n = norm(u) * norm(v)
    return F.when(n == 0, 0.0).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / F.nullif(n, F.lit(0.0)))))))


def ellipse_area(a: Column, b: Column) -> Column:
    return F.pi() * a * b


def ellipse_perimeter(a: Column, b: Column) -> Column:
    """Ramanujan's second approximation."""
    h = F.when(a + b == 0, 0.0).otherwise((a - b) * (a - b) / F.nullif((a + b) * (a + b), F.lit(0.0)))
    return F.pi() * (a + b) * (1 + 3 * h / (10 + F.sqrt(4 - 3 * h)))


def apply_matrix(m: Column, p: Column) -> Column:
    """Row-major 4 x 4 matrix (16 numbers) on a point."""
    return F.array(*(m[4 * r] * p[0] + m[4 * r + 1] * p[1] + m[4 * r + 2] * p[2] + m[4 * r + 3] for r in range(3)))


def multiply_matrices(a: Column, b: Column) -> Column:
    return F.array(*(sum((a[4 * r + k] * b[4 * k + c] for k in range(1, 4)), a[4 * r] * b[c]) for r in range(4) for c in range(4)))


def _det3(m: list) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse_matrix(m: Column) -> Column:
    """Inverse of a row-major 4 x 4 matrix by cofactors; null where there is none."""
    part = lambda r, c: _det3([m[4 * i + j] for i in range(4) if i != r for j in range(4) if j != c]) * (-1) ** (r + c)
    cofactor = {(r, c): part(r, c) for r in range(4) for c in range(4)}
    det = sum((m[c] * cofactor[0, c] for c in range(1, 4)), m[0] * cofactor[0, 0])
    return F.when(det != 0, F.array(*(cofactor[c, r] / F.nullif(det, F.lit(0.0)) for r in range(4) for c in range(4))))


def transposed(m: Column, n: int) -> Column:
    return F.array(*(m[n * c + r] for r in range(n) for c in range(n)))


def product(a: Column, b: Column, n: int) -> Column:
    """Product of two row-major n x n matrices."""
    return F.array(*(sum((a[n * r + k] * b[n * k + c] for k in range(1, n)), a[n * r] * b[c]) for r in range(n) for c in range(n)))


def axis_rotation(axis: Column, angle: Column) -> Column:
    """Row-major 3 x 3 rotation about an axis by an angle in radians."""

    def entries(p: Column) -> Column:
        (x, y, z), c, s = (p["axis"][k] for k in range(3)), p["cos"], p["sin"]
        t = 1 - c
        return F.array(
            x * x * t + c, x * y * t - z * s, x * z * t + y * s,
            y * x * t + z * s, y * y * t + c, y * z * t - x * s,
            z * x * t - y * s, z * y * t + x * s, z * z * t + c,
        )

    return once(F.struct(unit(axis).alias("axis"), F.cos(angle).alias("cos"), F.sin(angle).alias("sin")), entries)


#: Length of the cross product below which two directions count as parallel, and how near to the x axis one may be to be turned about it (fixed values).
PARALLEL, ALONG = 1e-9, 0.9


def rotation_onto(a: Column, b: Column) -> Column:
    """The rotation that turns ``a`` to the direction of ``b``; about any axis across for opposite ones."""

    def turned(p: Column) -> Column:
        u, v, n = p["u"], p["v"], p["n"]
        same = F.array(*(F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)))
        side = F.when(F.abs(u[0]) < ALONG, F.array(*map(F.lit, (1.0, 0.0, 0.0)))).otherwise(F.array(*map(F.lit, (0.0, 1.0, 0.0))))
        parallel = F.when(dot(u, v) > 0, same).otherwise(axis_rotation(cross(u, side), F.pi()))
        return F.when(norm(n) < PARALLEL, parallel).otherwise(axis_rotation(n, F.atan2(norm(n), dot(u, v))))

    units = F.struct(unit(a).alias("u"), unit(b).alias("v"))
    return once(units, lambda p: once(F.struct(p["u"].alias("u"), p["v"].alias("v"), cross(p["u"], p["v"]).alias("n")), turned))


def quaternion_rotation(q: Column) -> Column:
    """Row-major 3 x 3 rotation of a unit quaternion (w, x, y, z)."""
    w, x, y, z = (q[k] for k in range(4))
    return F.array(
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    )


def view_points(points: Column, width: int, height: int, mm_x: float, mm_y: float) -> Column:
    """Points given as shares of a slice view (x, y) in millimetres."""
    return F.transform(points, lambda p: F.array(p[0] * ((width - 1) * mm_x), p[1] * ((height - 1) * mm_y), F.lit(0.0)))


def view_angle(p: Column) -> Column:
    """Angle in degrees at the second of three points; arms without length count as of length 1."""
    u, v = minus(p[0], p[1]), minus(p[2], p[1])
    n = norm(u) * norm(v)
    cos = dot(u, v) / F.when(n == 0, 1.0).otherwise(n)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))


def view_ellipse(p: Column) -> Column:
    """Area of the ellipse in the box of two points."""
    return ellipse_area(F.abs(p[1][0] - p[0][0]) / 2, F.abs(p[1][1] - p[0][1]) / 2)


def flip_point(p: Column) -> Column:
    """Between the two patient frames that differ in the signs of x and y."""
    return F.array(-p[0], -p[1], p[2])


def flip_matrix(m: Column) -> Column:
    sign = (-1, -1, 1, 1)
    return F.array(*(m[4 * r + c] * (sign[r] * sign[c]) for r in range(4) for c in range(4)))


def polygons(points: DataFrame) -> DataFrame:
    """(poly, area, perimeter) of closed polygons from (poly, ord, x, y); too few points give 0."""
    w, whole = Window.partitionBy("poly").orderBy("ord"), Window.partitionBy("poly")
    first = lambda c: F.first(c).over(w)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), first(c))
    e = points.select("poly", "x", "y", nxt("x").alias("nx"), nxt("y").alias("ny"), F.count(F.lit(1)).over(whole).alias("n"))
    area = F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2
    length = F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))
    return e.groupBy("poly", "n").agg(area.alias("a"), length.alias("p")).select("poly", F.when(F.col("n") >= 3, F.col("a")).otherwise(0.0).alias("area"), F.when(F.col("n") >= 2, F.col("p")).otherwise(0.0).alias("perimeter"))


def in_polygon(points: DataFrame, vertices: list[tuple[float, float]]) -> DataFrame:
    """Rows of ``points`` (x, y) inside by the even-odd rule; the edges are literals, so no join."""
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(vertices, vertices[-1:] + vertices[:-1], strict=True):
        if ay == by:
            continue
        crosses = (F.lit(ay) > F.col("y")) != (F.lit(by) > F.col("y"))
        inside = inside != (crosses & (F.col("x") < (bx - ax) * (F.col("y") - ay) / (by - ay) + ax))
    return points.where(inside)


def in_ellipse(x: Column, y: Column, first: tuple, second: tuple) -> Column:
    """Whether (x, y) lies in the ellipse in the box of two corners (pairs of columns or numbers), its border included; never in a box without an area."""
    rx, ry = F.abs(F.lit(second[0]) - F.lit(first[0])) / 2, F.abs(F.lit(second[1]) - F.lit(first[1])) / 2
    u, v = (x - (F.lit(first[0]) + F.lit(second[0])) / 2) / rx, (y - (F.lit(first[1]) + F.lit(second[1])) / 2) / ry
    return F.when((rx > 0) & (ry > 0), u * u + v * v <= 1).otherwise(F.lit(False))


def density_stats(df: DataFrame, value: str, *by: str) -> DataFrame:
    """min, max, mean, count of the finite values; 0 where there are none."""
    v = F.when(~F.isnan(F.col(value).cast("double")) & (F.abs(F.col(value).cast("double")) != float("inf")), F.col(value).cast("double"))
    zero = F.lit(0.0)
    return df.groupBy(*by).agg(F.coalesce(F.min(v), zero).alias("min"), F.coalesce(F.max(v), zero).alias("max"), F.coalesce(F.avg(v), zero).alias("mean"), F.count(v).alias("count"))


def covariances(points: DataFrame, *by: str) -> DataFrame:
    """Population covariance sums of (x, y, z) by group, in one aggregate."""
    pairs = [(a, b) for k, a in enumerate("xyz") for b in "xyz"[k:]]
    return points.groupBy(*by).agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"), *(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs))


def principal_axes(points: DataFrame, by: str) -> DataFrame:
    """(by, axis, variance, ax, ay, az), largest variance first; signs are arbitrary."""
    cov = covariances(points, by)

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                m = np.array([[r["cxx"], r["cxy"], r["cxz"]], [r["cxy"], r["cyy"], r["cyz"]], [r["cxz"], r["cyz"], r["czz"]]])
                w, v = np.linalg.eigh(m)
                for k, j in enumerate(np.argsort(-w, kind="stable")):
                    out.append({by: r[by], "axis": k, "variance": float(w[j]), "ax": float(v[0, j]), "ay": float(v[1, j]), "az": float(v[2, j])})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([b.schema.field(by), ("axis", pa.int64()), *((c, pa.float64()) for c in ("variance", "ax", "ay", "az"))]))

    kind = points.schema[by].dataType.simpleString()
    return cov.mapInArrow(run, f"{by} {kind}, axis long, variance double, ax double, ay double, az double")


def horn_sums(pairs: DataFrame, *by: str) -> DataFrame:
    """Centroids and the nine cross-covariance sums of point pairs (x, y, z) -> (u, v, w)."""
    n = F.count(F.lit(1))
    cross_sum = lambda a, b: F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / n
    return pairs.groupBy(*by).agg(n.alias("n"), *(F.avg(c).alias(f"m{c}") for c in "xyzuvw"), *(cross_sum(a, b).alias(f"s{a}{b}") for a in "xyz" for b in "uvw"))


def rigid_fit(pairs: DataFrame, by: str) -> DataFrame:
    """(by, m, rmse): least-squares rotation and translation by unit quaternions; groups under 3 pairs have none."""
    sums = horn_sums(pairs, by).where("n >= 3")

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                s = np.array([[r[f"s{a}{c}"] for c in "uvw"] for a in "xyz"])
                d = np.array([s[1, 2] - s[2, 1], s[2, 0] - s[0, 2], s[0, 1] - s[1, 0]])
                n = np.empty((4, 4))
                n[0, 0], n[0, 1:], n[1:, 0] = np.trace(s), d, d
                n[1:, 1:] = s + s.T - np.trace(s) * np.eye(3)
                w, x, y, z = np.linalg.eigh(n)[1][:, -1]
                rot = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
                t = np.array([r["mu"], r["mv"], r["mw"]]) - rot @ np.array([r["mx"], r["my"], r["mz"]])
                m = np.eye(4)
                m[:3, :3], m[:3, 3] = rot, t
                out.append({by: r[by], "m": m.ravel().tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([b.schema.field(by), ("m", pa.list_(pa.float64()))]))

    kind = pairs.schema[by].dataType.simpleString()
    fit = sums.mapInArrow(run, f"{by} {kind}, m array<double>")
    moved = apply_matrix(F.col("m"), F.array("x", "y", "z"))
    err = pairs.join(fit, by).select(by, "m", F.pow(distance(moved, F.array("u", "v", "w")), 2).alias("e"))
    return err.groupBy(by, "m").agg(F.sqrt(F.avg("e")).alias("rmse"))
