"""Surfaces of masks: voxel faces, marching tetrahedra, decimation, and binary STL."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.masks import exposed_faces
from voxloom.operators.voxels import Grid


def face_triangles(mask: DataFrame, grid: Grid) -> DataFrame:
    """Two triangles for each exposed face: (volume_id, i, t, nx..nz, ax.., bx.., cx..) in millimetres."""
    f = exposed_faces(mask, grid)
    # the corner of the face nearest the origin, and its two edge directions
    base = [F.col(c) + F.when(F.col(f"d{c}") > 0, 1).otherwise(0) for c in "xyz"]
    u = [F.when(F.col("dx") == 0, F.lit(1) if c == "x" else F.lit(0)).otherwise(F.lit(1) if c == "y" else F.lit(0)) for c in "xyz"]
    v = [F.when(F.col("dz") == 0, F.lit(1) if c == "z" else F.lit(0)).otherwise(F.lit(1) if c == "y" else F.lit(0)) for c in "xyz"]
    s = (grid.sx, grid.sy, grid.sz)
    at = lambda a, b: [(base[k] + u[k] * a + v[k] * b) * s[k] for k in range(3)]
    p00, p10, p11, p01 = at(0, 0), at(1, 0), at(1, 1), at(0, 1)
    # counter-clockwise from outside: u x v points along +z, -y or +x
    straight = (F.col("dx") > 0) | (F.col("dy") < 0) | (F.col("dz") > 0)
    names = [f"{p}{c}" for p in "abc" for c in "xyz"]
    tri = lambda t, p, q, r: F.struct(F.lit(t).cast("long").alias("t"), *(c.cast("double").alias(n) for c, n in zip([*p, *q, *r], names, strict=True)))
    two = F.when(straight, F.array(tri(0, p00, p10, p11), tri(1, p00, p11, p01))).otherwise(F.array(tri(0, p00, p11, p10), tri(1, p00, p01, p11)))
    return f.withColumn("q", F.explode(two)).select("volume_id", "i", "q.t", *(F.col(f"d{c}").cast("double").alias(f"n{c}") for c in "xyz"), *(f"q.{n}" for n in names))


def triangle_normal(prefix: str = "") -> list[Column]:
    """Unit normal columns of (ax..cz); zero for a triangle without area."""
    e = lambda p, c: F.col(f"{prefix}{p}{c}") - F.col(f"{prefix}a{c}")
    n = [e("b", q) * e("c", r) - e("b", r) * e("c", q) for q, r in (("y", "z"), ("z", "x"), ("x", "y"))]
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return [F.when(length == 0, 0.0).otherwise(c / F.nullif(length, F.lit(0.0))) for c in n]


#: Corners of a cube in order (fixed values).
_CORNERS = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
#: The six tetrahedra around the diagonal of a cube, by corner (fixed values).
_TETS = [(0, 5, 1, 6), (0, 1, 2, 6), (0, 2, 3, 6), (0, 3, 7, 6), (0, 7, 4, 6), (0, 4, 5, 6)]


def _cases() -> list[tuple[int, int, list[int]]]:
    """(corner bits, triangle number, its three vertices as corner pairs) of every cube with a surface."""
    out = []
    for bits in range(1, 255):
        n = 0
        for tet in _TETS:
            inner, outer = [c for c in tet if bits >> c & 1], [c for c in tet if not bits >> c & 1]
            if len(inner) == 1:
                found = [[(inner[0], o) for o in outer]]
            elif len(outer) == 1:
                found = [[(outer[0], i) for i in reversed(inner)]]
            elif len(inner) == 2:
                (a, b), (c, d) = inner, outer
                found = [[(a, c), (b, c), (b, d)], [(a, c), (b, d), (a, d)]]
            else:
                continue
            for tri in found:
                out.append((bits, n, [x for p in tri for x in p]))
                n += 1
    return out


def iso_triangles(mask: DataFrame, grid: Grid) -> DataFrame:
    """Triangles between set and unset voxel centres by marching tetrahedra.

    A set voxel marks the eight cubes that it is a corner of; the corner bits of a cube are a sum, and
    the triangles of each of the 254 cases come from a fixed broadcast table.
    """
    spark = mask.sparkSession
    corner = F.explode(F.array(*(F.struct(F.lit(x).alias("ox"), F.lit(y).alias("oy"), F.lit(z).alias("oz"), F.lit(1 << k).alias("bit")) for k, (x, y, z) in enumerate(_CORNERS))))
    cube = mask.select("volume_id", "x", "y", "z", corner.alias("c")).groupBy("volume_id", *((F.col(c) - F.col(f"c.o{c}")).alias(c) for c in "xyz")).agg(F.sum("c.bit").cast("int").alias("bits"))
    cases = spark.createDataFrame(_cases(), "bits int, t int, v array<int>")
    tri = cube.join(F.broadcast(cases), "bits")
    where = {c: F.array(*(F.lit(float(o[k])) for o in _CORNERS)) for k, c in enumerate("xyz")}
    s = {"x": grid.sx, "y": grid.sy, "z": grid.sz}
    # values are 0 and 1 and the surface at one half, so a vertex is the middle of its edge
    mid = lambda c, k: (F.col(c) + (F.element_at(where[c], F.col("v")[2 * k] + 1) + F.element_at(where[c], F.col("v")[2 * k + 1] + 1)) / 2) * s[c]
    out = tri.select("volume_id", "x", "y", "z", F.col("t").cast("long").alias("t"), *(mid(c, k).alias(f"{p}{c}") for k, p in enumerate("abc") for c in "xyz"))
    return out.select("*", *(n.alias(f"n{c}") for n, c in zip(triangle_normal(), "xyz", strict=True)))


def decimated(triangles: DataFrame, ratio: float, order: list[str]) -> DataFrame:
    """Every k-th triangle in order, k the nearest integer to 1 / (1 - ratio)."""
    k = max(1, int(np.floor(1 / (1 - ratio) + 0.5))) if ratio < 1 else 1
    if k == 1:
        return triangles
    return _numbered(triangles, order).where(F.col("n") % k == 0).drop("n")


def label_faces(labels: DataFrame, grid: Grid) -> DataFrame:
    """(volume_id, axis, x, y, z, low, high): every face between two labels of ``labels`` (volume_id, x, y, z, label > 0) once.

    (x, y, z) is the voxel on the face's lower side along ``axis`` (it may lie just outside), ``low`` and ``high`` are the labels
    of the two sides, 0 where there is none. The faces of one label, on either side, are its closed surface, and two labels
    that touch share theirs. One pass: each voxel offers its two faces of each axis, and a face's two sides meet by key.
    """
    sides = F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.lit(k).alias("up")) for c in "xyz" for k in (0, 1))))
    s = labels.select("volume_id", "x", "y", "z", "label", sides.alias("_s"))
    at = [(F.col(c) - F.when((F.col("_s.axis") == c) & (F.col("_s.up") == 0), 1).otherwise(0)).alias(c) for c in "xyz"]
    own = F.col("label").cast("long")
    s = s.select("volume_id", F.col("_s.axis").alias("axis"), *at, F.when(F.col("_s.up") == 1, own).alias("low"), F.when(F.col("_s.up") == 0, own).alias("high"))
    f = s.groupBy("volume_id", "axis", "x", "y", "z").agg(F.coalesce(F.max("low"), F.lit(0)).alias("low"), F.coalesce(F.max("high"), F.lit(0)).alias("high"))
    return f.where("low <> high")


def label_triangles(faces: DataFrame, grid: Grid) -> DataFrame:
    """Two triangles of each face for each label that it belongs to, seen from outside: (volume_id, label, axis, x, y, z, t, nx.., ax.., bx.., cx..)."""
    both = F.explode(F.array(F.struct(F.col("low").alias("label"), F.lit(1).alias("out")), F.struct(F.col("high").alias("label"), F.lit(-1).alias("out"))))
    f = faces.withColumn("_l", both).where("_l.label <> 0").select("volume_id", "axis", "x", "y", "z", F.col("_l.label").alias("label"), F.col("_l.out").alias("out"))
    step = {"x": grid.sx, "y": grid.sy, "z": grid.sz}
    # the face's corner nearest the origin, and its sides u and v, whose product points up the axis
    turn = {"x": ("y", "z"), "y": ("z", "x"), "z": ("x", "y")}

    def corner(c: str, a: int, b: int) -> Column:
        more = F.when(F.col("axis") == c, 1)
        for axis, (u, v) in turn.items():
            if c == u:
                more = more.when(F.col("axis") == axis, a)
            elif c == v:
                more = more.when(F.col("axis") == axis, b)
        return (F.col(c) + more) * step[c]

    p = {n: [corner(c, a, b) for c in "xyz"] for n, (a, b) in {"o": (0, 0), "u": (1, 0), "uv": (1, 1), "v": (0, 1)}.items()}
    names = [f"{q}{c}" for q in "abc" for c in "xyz"]
    tri = lambda t, *at: F.struct(F.lit(t).cast("long").alias("t"), *(e.cast("double").alias(n) for e, n in zip([e for q in at for e in p[q]], names, strict=True)))
    two = F.when(F.col("out") > 0, F.array(tri(0, "o", "u", "uv"), tri(1, "o", "uv", "v"))).otherwise(F.array(tri(0, "o", "uv", "u"), tri(1, "o", "v", "uv")))
    normal = [F.when(F.col("axis") == c, F.col("out")).otherwise(0).cast("double").alias(f"n{c}") for c in "xyz"]
    return f.withColumn("q", F.explode(two)).select("volume_id", "label", "axis", "x", "y", "z", "q.t", *normal, *(f"q.{n}" for n in names))


def face_number() -> Column:
    """The number of a triangle of ``label_triangles``: by place, axis and half (volumes of less than 2**19 voxels a side)."""
    side = 1 << 19
    place = ((F.col("z") + 1) * side + F.col("y") + 1) * side + F.col("x") + 1
    return place * 8 + (F.ascii("axis") - F.lit(ord("x"))) * 2 + F.col("t")


def stl_lines(triangles: DataFrame, number_of: Column, by: str = "label", name: str = "label_") -> DataFrame:
    """(by, block, line, value): ASCII STL of each mesh, to be sorted by all three and written as text; seven lines a triangle.

    ``number_of`` is a number of each triangle, at least 0, so no mesh is gathered to number them; block -1 opens a solid and the last one closes it.
    """
    number = lambda c: F.format_string("%.6f", F.col(c))
    point = lambda p: F.concat(F.lit("      vertex "), F.concat_ws(" ", *(number(f"{p}{c}") for c in "xyz")))
    facet = F.array(F.concat(F.lit("  facet normal "), F.concat_ws(" ", *(number(f"n{c}") for c in "xyz"))), F.lit("    outer loop"), point("a"), point("b"), point("c"), F.lit("    endloop"), F.lit("  endfacet"))
    body = triangles.select(by, number_of.cast("long").alias("block"), F.posexplode(facet).alias("line", "value"))
    solid = F.concat(F.lit(name), F.col(by).cast("string"))
    ends = triangles.select(by).distinct().select(by, F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("block"), F.concat(F.lit("solid "), solid).alias("value")), F.struct(F.lit((1 << 63) - 1).alias("block"), F.concat(F.lit("endsolid "), solid).alias("value")))).alias("e"))
    return body.unionByName(ends.select(by, "e.block", F.lit(0).alias("line"), "e.value"))


def smoothed(triangles: DataFrame, rounds: int, factor: float = 0.35) -> DataFrame:
    """Vertices (5 decimals make one vertex) moved towards the mean of their neighbours, at most 24 rounds;
    vertices of fewer than 3 neighbours stay."""
    from voxloom.operators.staging import written

    key = lambda p: F.struct(*(F.round(f"{p}{c}", 5).alias(c) for c in "xyz"))
    t = triangles.withColumns({f"_{p}": key(p) for p in "abc"})
    edges = t.select("volume_id", F.explode(F.array(*(F.struct(F.col(f"_{p}").alias("u"), F.col(f"_{q}").alias("w")) for p in "abc" for q in "abc" if p != q))).alias("e")).select("volume_id", "e.u", "e.w").distinct()
    edges = written(edges, "mesh-edges")
    place = edges.select("volume_id", "u").distinct().select("volume_id", "u", F.col("u").alias("p"))
    for _ in range(min(rounds, 24)):
        near = edges.join(place.select("volume_id", F.col("u").alias("w"), F.col("p").alias("q")), ["volume_id", "w"]).groupBy("volume_id", "u").agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"q.{c}").alias(f"m{c}") for c in "xyz"))
        moved = F.struct(*(F.when(F.col("n") >= 3, F.col(f"p.{c}") + factor * (F.col(f"m{c}") - F.col(f"p.{c}"))).otherwise(F.col(f"p.{c}")).alias(c) for c in "xyz"))
        place = written(place.join(near, ["volume_id", "u"]).select("volume_id", "u", moved.alias("p")), "mesh-round")
    for p in "abc":
        t = t.join(place.select("volume_id", F.col("u").alias(f"_{p}"), F.col("p").alias(f"_n{p}")), ["volume_id", f"_{p}"])
    out = t.withColumns({f"{p}{c}": F.col(f"_n{p}.{c}") for p in "abc" for c in "xyz"}).select(*triangles.columns)
    return out.withColumns({f"n{c}": n for n, c in zip(triangle_normal(), "xyz", strict=True)})


def stl_files(triangles: DataFrame, by: str = "volume_id") -> DataFrame:
    """(by, content): a binary STL file for each mesh; one task writes one mesh."""
    cols = [f"{p}{c}" for p in "nabc" for c in "xyz"]

    def run(group: pa.Table) -> pa.Table:
        rec = np.zeros(len(group), dtype=np.dtype([("f", "<f4", 12), ("a", "<u2")]))
        rec["f"] = np.stack([group.column(c).to_numpy() for c in cols], axis=1)
        return pa.table({by: [group.column(by)[0].as_py()], "content": pa.array([b"\0" * 80 + struct.pack("<I", len(rec)) + rec.tobytes()], pa.binary())})

    return triangles.select(by, *cols).groupBy(by).applyInArrow(run, f"{by} long, content binary")


def ply_lines(triangles: DataFrame, order: list[str], comment: str = "binary mask surface") -> DataFrame:
    """(volume_id, part, n, value): lines of an ASCII PLY file of each mesh, in order by part and n, to be written as text.

    Triangles are numbered by ranges: each task's base is the count of those before it, so no task sees a whole mesh.
    """
    numbered = _numbered(triangles, order)
    tri = numbered.select("volume_id", "n", *(f"{p}{c}" for p in "abc" for c in "xyz"))
    text = lambda p: F.concat_ws(" ", *(F.col(f"{p}{c}").cast("string") for c in "xyz"))
    vertex = tri.select("volume_id", F.lit(1).alias("part"), F.posexplode(F.array(*(text(p) for p in "abc"))).alias("k", "value"), "n").select("volume_id", "part", (F.col("n") * 3 + F.col("k")).alias("n"), "value")
    face = tri.select("volume_id", F.lit(2).alias("part"), "n", F.concat_ws(" ", F.lit("3"), *((F.col("n") * 3 + k).cast("string") for k in range(3))).alias("value"))
    count = tri.groupBy("volume_id").agg(F.count(F.lit(1)).alias("t"))
    head = ["ply", "format ascii 1.0", f"comment {comment}", None, "property float x", "property float y", "property float z", None, "property list uchar int vertex_indices", "end_header"]
    lines = [F.concat(F.lit("element vertex " if k == 3 else "element face "), (F.col("t") * (3 if k == 3 else 1)).cast("string")) if h is None else F.lit(h) for k, h in enumerate(head)]
    top = count.select("volume_id", F.lit(0).alias("part"), F.posexplode(F.array(*lines)).alias("n", "value")).withColumn("n", F.col("n").cast("long"))
    return top.unionByName(vertex).unionByName(face)


def _numbered(triangles: DataFrame, order: list[str]) -> DataFrame:
    """``triangles`` with n, their place (from 0) in their mesh by ``order``.

    Rows are dealt by ranges and counted by mesh and partition; the counts of the partitions before give each its base.
    """
    from voxloom.operators.staging import written

    rows = triangles.repartitionByRange("volume_id", *order).sortWithinPartitions("volume_id", *order)
    rows = written(rows.withColumn("_part", F.spark_partition_id()), "mesh-order")
    before = Window.partitionBy("volume_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("volume_id", "_part").agg(F.count(F.lit(1)).alias("_c")).withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("volume_id", "_part").orderBy(*order)) - 1
    return rows.join(base.drop("_c"), ["volume_id", "_part"]).withColumn("n", inside + F.col("_base")).drop("_part", "_base")
