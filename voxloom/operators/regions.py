"""Regions of interest found in volumes: a component tree of nested thresholds, peaks that lie apart, and claims of overlapping candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators import masks
from voxloom.operators.masks import BRICK, neighbours, offsets
from voxloom.operators.staging import linked_sets, written
from voxloom.operators.voxels import Grid
from voxloom.operators.watershed import grown
from voxloom.operators.workflows import center_roi, greedy_apart

_NODE = 1 << 40  # nodes of a tree as one number: (volume_id * LEVELS + level) * 2**40 + i
LEVELS = 64  # most thresholds of a tree
_PARTS = (
    "volume_id long, kind string, i long, x long, y long, z long, level int, roots array<long>, root long, parent long, "
    "voxels long, w double, wx double, wy double, wz double, top double, x0 long, y0 long, z0 long, x1 long, y1 long, z1 long"
)
_NAMES = [p.split()[0] for p in _PARTS.split(", ")]

#: The detector by thresholds (fixed values): shares of the depth, the region's lower ends and its upper shares, thresholds,
#: sizes of regions, bounds of centroids, half of the window for the depth, sides by size, and distances.
AUTO = {
    "slab": (0.14, 0.64),
    "region": (45, 0.72, 80, 0.90),
    "thresholds": (1600, 2200, 2800, 3600, 5200),
    "voxels": (28, 6000),
    "sides": (5, 110),
    "centroid": (55, 430, 90, 570),
    "compact": 0.15,
    "window": 20,
    "edges": ((400, 68), (1500, 80), (None, 92)),
    "depth": 136,
    "apart": 28.0,
    "most": 18,
}

#: The detector by distance peaks (fixed values).
HYBRID = {
    "threshold": 1350,
    "slab": (0.10, 0.74),
    "region": (0.07, 0.82, 0.10, 0.92),
    "least": 12,
    "peaks": 16,
    "peak": 1.0,
    "voxels": (900, 150_000),
    "shortest": 8,
    "widest": 130,
    "centroid": ((0.10, 0.76), (0.07, 0.82), (0.10, 0.92)),
    "side": (30, 68, 104),
    "depth": (44, 104, 144),
    "apart": 22.0,
    "most": 32,
}

#: Crops of the sample scan: depth, and name, centre x and y, and side (fixed values).
ARCH_DEPTH = (88, 224)
ARCH = [
    ("upper-left-molar-1", 205, 250, 80),
    ("upper-left-molar-2", 175, 330, 82),
    ("upper-left-premolar", 185, 175, 76),
    ("upper-incisor-left", 275, 108, 70),
    ("upper-incisor-right", 340, 108, 70),
    ("upper-right-premolar", 410, 142, 76),
    ("upper-right-molar-1", 465, 225, 82),
    ("upper-right-molar-2", 475, 310, 82),
    ("lower-right-molar", 500, 390, 84),
]


def arch_rois(volumes: DataFrame, width: str = "width", height: str = "height", depth: str = "depth") -> DataFrame:
    """``volumes`` with a row for each crop of the arch that fits: name, z0, y0, x0, z1, y1, x1, cut off at the volume's ends."""
    one = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), *(F.lit(v).cast("long").alias(c) for c, v in zip(("_x", "_y", "_s"), (x - s // 2, y - s // 2, s), strict=True))) for n, x, y, s in ARCH)))
    v = volumes.withColumn("_r", one)
    low = {"z0": F.lit(ARCH_DEPTH[0]), "y0": F.col("_r._y"), "x0": F.col("_r._x")}
    high = {"z1": (F.lit(ARCH_DEPTH[1]), depth), "y1": (F.col("_r._y") + F.col("_r._s"), height), "x1": (F.col("_r._x") + F.col("_r._s"), width)}
    cols = [*(F.greatest(F.lit(0), e).cast("long").alias(c) for c, e in low.items()), *(F.least(F.col(n), e).cast("long").alias(c) for c, (e, n) in high.items())]
    return v.select(*volumes.columns, F.col("_r.name").alias("name"), *cols)


def _labels(n: int, a: np.ndarray, b: np.ndarray, level: np.ndarray, most: int) -> list[np.ndarray]:
    """For each level from 1 on, every voxel's component among those of that level or a higher one (its least number).

    Levels go down from the highest, and each edge is taken once, at the lower of its two levels: components
    of a higher level come in whole.
    """
    at = np.minimum(level[a], level[b])
    label, out = np.arange(n), [np.zeros(0, dtype=np.int64)] * most
    for k in range(most, 0, -1):
        p, q = a[at == k], b[at == k]
        while True:
            r, s = label[p], label[q]
            open_ = r != s
            if not open_.any():
                break
            np.minimum.at(label, np.maximum(r, s)[open_], np.minimum(r, s)[open_])
            while (label[label] != label).any():
                label = label[label]
        out[k - 1] = label.copy()
    return out


def _local_tree(group: pa.Table, grid: Grid, half, most: int, rim) -> pa.Table:
    """Nodes of one brick's tree, with what lies in them, and the voxels at its faces with their nodes of all levels."""
    i, x, y, z, level = (group.column(c).to_numpy().astype(np.int64) for c in ("i", "x", "y", "z", "level"))
    v = group.column("v").to_numpy(zero_copy_only=False).astype(np.float64)
    order = np.argsort(i)
    i, x, y, z, level, v = (c[order] for c in (i, x, y, z, level, v))
    a, b = [], []
    for dx, dy, dz in half:
        ok = (x + dx >= 0) & (x + dx < grid.width) & (y + dy >= 0) & (y + dy < grid.height) & (z + dz >= 0) & (z + dz < grid.depth)
        target = i + (dz * grid.height + dy) * grid.width + dx
        at = np.minimum(np.searchsorted(i, target), len(i) - 1)
        hit = np.flatnonzero(ok & (i[at] == target))
        a.append(hit)
        b.append(at[hit])
    labels = _labels(len(i), np.concatenate(a), np.concatenate(b), level, most)
    volume, tables = group.column("volume_id")[0].as_py(), []

    def rows(n: int, kind: str, **cols) -> pa.Table:
        cols |= {"volume_id": pa.array(np.full(n, volume)), "kind": pa.array([kind] * n, pa.string())}
        kinds = {"roots": pa.list_(pa.int64()), "level": pa.int32(), **dict.fromkeys(("w", "wx", "wy", "wz", "top"), pa.float64())}
        return pa.table({c: cols.get(c, pa.nulls(n, kinds.get(c, pa.int64()))) for c in _NAMES})

    for k in range(1, most + 1):
        inside = np.flatnonzero(level >= k)
        if not len(inside):
            break
        root, to = np.unique(labels[k - 1][inside], return_inverse=True)
        n = len(root)
        add = lambda w: pa.array(np.bincount(to, w, n))  # noqa: B023, E731
        box = {}
        for c, p in (("x", x), ("y", y), ("z", z)):
            low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            np.minimum.at(low, to, p[inside])
            np.maximum.at(high, to, p[inside])
            box |= {f"{c}0": pa.array(low), f"{c}1": pa.array(high + 1)}
        top = np.full(n, -np.inf)
        np.maximum.at(top, to, v[inside])
        parent = pa.array(i[labels[k - 2][root]]) if k > 1 else pa.nulls(n, pa.int64())
        w = v[inside]
        sums = {"w": add(w), **{f"w{c}": add(w * p[inside]) for c, p in (("x", x), ("y", y), ("z", z))}}
        tables.append(rows(n, "node", level=pa.array(np.full(n, k, dtype=np.int32)), root=pa.array(i[root]), parent=parent, voxels=pa.array(np.bincount(to, minlength=n)), top=pa.array(top), **sums, **box))
    edge = np.flatnonzero(rim(x, y, z))
    own = level[edge]
    flat = i[np.stack([lab[edge] for lab in labels], axis=1)] if len(edge) else np.zeros((0, most), dtype=np.int64)
    roots = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32)), pa.array(flat[np.arange(most)[None, :] < own[:, None]]))
    tables.append(rows(len(edge), "rim", i=pa.array(i[edge]), x=pa.array(x[edge]), y=pa.array(y[edge]), z=pa.array(z[edge]), level=pa.array(own.astype(np.int32)), roots=roots))
    return pa.concat_tables(tables)


def component_tree(rows: DataFrame, grid: Grid, levels: int, connectivity: int = 26, brick: int = BRICK) -> DataFrame:
    """The nodes of the component tree of ``rows`` (volume_id, i, x, y, z, v, level): regions of nested thresholds in one pass.

    A node is a connected region of the voxels of ``level`` k or higher; columns: volume_id, level, root (its least voxel),
    parent (its region's root one level lower, null at level 1), voxels, w and wx, wy, wz (sums of v and of v times the
    place), top (largest v), and bounds, upper ones exclusive. Voxels of level 0 are not given. Bricks make their own trees, and only voxels
    at their faces, with the nodes that they lie in, look across; what they join is solved for all levels as one graph.
    """
    if levels > LEVELS:
        raise ValueError(f"at most {LEVELS} levels")
    half = [d for d in offsets(connectivity) if d > (0, 0, 0)]
    size = {"x": grid.width, "y": grid.height, "z": grid.depth}

    def rim(x, y, z):
        out = np.zeros(len(x), dtype=bool)
        for p, n in ((x, size["x"]), (y, size["y"]), (z, size["z"])):
            if n > brick:
                out |= (p % brick == 0) | (p % brick == brick - 1)
        return out

    cells = [F.floor(F.col(c) / brick).alias(f"_b{c}") for c in "xyz"]
    dealt = rows.select(*(F.col(c).cast("long").alias(c) for c in ("volume_id", "i", "x", "y", "z")), F.col("v").cast("double").alias("v"), F.col("level").cast("int").alias("level"), *cells)
    parts = written(dealt.groupBy("volume_id", "_bx", "_by", "_bz").applyInArrow(lambda g: _local_tree(g.combine_chunks(), grid, half, levels, rim), _PARTS), "tree-bricks")
    edge = parts.where("kind = 'rim'").select("volume_id", "i", "x", "y", "z", "level", "roots")
    far = neighbours(edge, grid, half).where(" or ".join(f"floor(n{c} / {brick}) <> floor({c} / {brick})" for c in "xyz"))
    other = edge.select("volume_id", F.col("i").alias("ni"), F.col("level").alias("_level"), F.col("roots").alias("_roots"))
    met = far.join(other, ["volume_id", "ni"]).select("volume_id", "roots", "_roots", F.explode(F.sequence(F.lit(1), F.least("level", "_level"))).alias("k"))

    def key(level: Column, root: Column) -> Column:
        return (F.col("volume_id") * LEVELS + level - 1) * _NODE + root

    pairs = met.select(*(key(F.col("k"), F.element_at(c, F.col("k"))).alias(n) for c, n in (("roots", "a"), ("_roots", "b")))).distinct()
    sets = written(linked_sets(pairs), "tree-sets")
    nodes = parts.where("kind = 'node'")
    for c, level in (("root", F.col("level")), ("parent", F.col("level") - 1)):
        nodes = nodes.withColumn("node", key(level, F.col(c))).join(sets.withColumnRenamed("root", "_to"), "node", "left").withColumn(c, F.coalesce(F.col("_to") % _NODE, F.col(c))).drop("node", "_to")
    sums = [F.sum(c).alias(c) for c in ("voxels", "w", "wx", "wy", "wz")]
    box = [f(f"{c}{n}").alias(f"{c}{n}") for n, f in ((0, F.min), (1, F.max)) for c in "zyx"]
    return nodes.groupBy("volume_id", "level", "root").agg(F.min("parent").alias("parent"), *sums, F.max("top").alias("top"), *box)


_CROSS = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0)]


def opened_levels(plane: DataFrame, grid: Grid) -> DataFrame:
    """``plane`` (volume_id, i, x, y, z, v, level) with the levels after opening by a cross in x and y: each threshold's mask is opened."""
    near = neighbours(plane.select("volume_id", "i", "x", "y", "z", "level"), grid, _CROSS).groupBy("volume_id", F.col("ni").alias("i")).agg(F.count(F.lit(1)).alias("_n"), F.min("level").alias("_low"))
    thin = plane.join(near, ["volume_id", "i"]).where("_n = 4").withColumn("level", F.least("level", "_low")).select("volume_id", "i", "x", "y", "z", "level")
    thin = written(thin, "thin")
    wide = neighbours(thin, grid, _CROSS).select("volume_id", F.col("ni").alias("i"), "level").unionByName(thin.select("volume_id", "i", "level"))
    wide = wide.groupBy("volume_id", "i").agg(F.max("level").alias("level"))
    return plane.drop("level").join(wide, ["volume_id", "i"]).select("volume_id", "i", "x", "y", "z", "v", "level")


def projected_regions(vox: DataFrame, grid: Grid, auto: dict = AUTO) -> DataFrame:
    """Regions of the largest values along z that may hold an object: (volume_id, level, root, score, cy, cx, voxels, rank), the best first.

    The projection is of a slab, inside a part of the plane; each threshold's mask is opened, and its regions, by faces
    and corners, must fit in size and place. The score is the largest value times the root of the size times the
    filled share of the box. Ties of the score go to the larger centre and size.
    """
    z0, z1 = (int(grid.depth * s) for s in auto["slab"])
    y0, ys, x0, xs = auto["region"]
    inside = (F.col("z") >= max(0, z0)) & (F.col("z") < min(grid.depth, z1)) & (F.col("y") > y0) & (F.col("y") < int(grid.height * ys)) & (F.col("x") > x0) & (F.col("x") < int(grid.width * xs))
    top = vox.where(inside).groupBy("volume_id", "x", "y").agg(F.max("v").alias("v"))
    level = sum((F.when(F.col("v") > t, 1).otherwise(0) for t in auto["thresholds"]), F.lit(0))
    plane = top.select("volume_id", (F.col("y") * grid.width + F.col("x")).alias("i"), "x", "y", F.lit(0).cast("long").alias("z"), "v", level.alias("level")).where("level > 0")
    flat = Grid(grid.width, grid.height, 1)
    tree = component_tree(written(opened_levels(written(plane, "projection"), flat), "opened"), flat, len(auto["thresholds"]), 26)
    h, w, n = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"), F.col("voxels")
    cy, cx = F.col("wy") / F.col("w"), F.col("wx") / F.col("w")
    (least, most), (short, long_), (ya, yb, xa, xb) = auto["voxels"], auto["sides"], auto["centroid"]
    fits = n.between(least, most) & h.between(short, long_) & w.between(short, long_) & cy.between(ya, yb) & cx.between(xa, xb)
    score = F.col("top") * F.sqrt(n.cast("double")) * F.greatest(n / (h * w), F.lit(auto["compact"]))
    found = tree.where(fits).select("volume_id", "level", "root", score.alias("score"), F.bround(cy).cast("long").alias("cy"), F.bround(cx).cast("long").alias("cx"), "voxels")
    best = Window.partitionBy("volume_id").orderBy(F.desc("score"), F.desc("cy"), F.desc("cx"), F.desc("voxels"), "level", "root")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 2 * auto["most"])


def _rois(found: DataFrame, grid: Grid, depth: Column, side: Column, apart: float, most: int, prefix: str) -> DataFrame:
    """Crops (volume_id, name, z0, y0, x0, z1, y1, x1, rank) around centres (cz, cy, cx), the best ones that lie apart."""
    lo, hi = center_roi([F.col("cz"), F.col("cy"), F.col("cx")], [depth, side, side], (grid.depth, grid.height, grid.width))
    boxes = found.select("volume_id", F.concat(F.lit(prefix), F.lpad(F.col("rank").cast("string"), 2, "0")).alias("name"), "rank", *(v.cast("long").alias(f"{c}0") for c, v in zip("zyx", lo, strict=True)), *(v.cast("long").alias(f"{c}1") for c, v in zip("zyx", hi, strict=True)))
    boxes = boxes.withColumns({c: (F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in "yx"})
    kept = greedy_apart(boxes, "volume_id", [("rank", "ascending")], apart)
    return kept.where(F.col("kept") & (F.col("place") <= most)).select("volume_id", "name", "z0", "y0", "x0", "z1", "y1", "x1", "rank")


def auto_rois(vox: DataFrame, grid: Grid, auto: dict = AUTO) -> DataFrame:
    """Crops around the regions of ``projected_regions``, deep where the window around the centre is brightest."""
    z0, z1 = (int(grid.depth * s) for s in auto["slab"])
    found = written(projected_regions(vox, grid, auto), "regions")
    r = auto["window"]
    slab = vox.where((F.col("z") >= max(0, z0)) & (F.col("z") < min(grid.depth, z1)))
    near = (F.abs(F.col("x") - F.col("cx")) <= r) & (F.abs(F.col("y") - F.col("cy")) <= r)
    # at most 2 * most rows a volume
    profile = slab.join(found.select("volume_id", "rank", "cy", "cx"), "volume_id").where(near).groupBy("volume_id", "rank", "z").agg(F.max("v").alias("v"))
    deep = profile.groupBy("volume_id", "rank").agg(F.max_by("z", F.struct("v", -F.col("z"))).alias("cz"))
    side = F.lit(None).cast("int")
    for below, edge in reversed(auto["edges"]):
        side = F.lit(edge) if below is None else F.when(F.col("voxels") < below, edge).otherwise(side)
    return _rois(found.join(deep, ["volume_id", "rank"]), grid, F.lit(auto["depth"]), side, auto["apart"], auto["most"], "auto-tooth-")


def spaced_peaks(rows: DataFrame, value: str, distance: int, least: float | None = None) -> DataFrame:
    """``rows`` (volume_id, i, x, y, z, value) that are peaks, with ``place`` from the highest on.

    A peak is over ``least`` and the largest of all at most ``distance`` steps away along each axis. Of peaks nearer than ``distance``
    along every axis (parts of one plateau, say) the higher stays, of equals the first voxel.
    """
    high = rows if least is None else rows.where(F.col(value) > least)
    tops = written(masks.local_maxima(high, value, distance).select("volume_id", "i", "x", "y", "z", value), "peaks")
    return greedy_apart(tops, "volume_id", [(value, "descending"), ("i", "ascending")], float(distance), axes="xyz", box=True).where("kept").drop("kept")


def peak_basins(vox: DataFrame, mask: DataFrame, grid: Grid, distance: int = HYBRID["peaks"], least: float = HYBRID["peak"]) -> DataFrame:
    """(volume_id, i, x, y, z, dist, label): the mask's voxels by the peak of the distance map (in mm) whose basin they lie in.

    Labels follow the peaks, from the highest on; basins join over faces, and voxels without a way to a peak get 0.
    """
    d = masks.squared_distance(vox, mask, grid, in_mm=True)
    d = written(d.select("volume_id", grid.index(F.col("x"), F.col("y"), F.col("z")).cast("long").alias("i"), "x", "y", "z", F.sqrt("d2").alias("dist")), "peak-distance")
    marks = spaced_peaks(d, "dist", distance, least).select("volume_id", "i", F.col("place").alias("marker"))
    rows = written(d.join(marks, ["volume_id", "i"], "left").withColumn("marker", F.coalesce("marker", F.lit(0))), "peak-markers")
    basins = grown(rows, grid, connectivity=6)
    return basins.join(d.select("volume_id", "i", "dist"), ["volume_id", "i"]).select("volume_id", "i", "x", "y", "z", "dist", F.col("basin").alias("label"))


def basin_candidates(labels: DataFrame, grid: Grid, hybrid: dict = HYBRID) -> DataFrame:
    """Labelled regions (volume_id, x, y, z, dist, label) that fit in size, extent and place: (volume_id, label, score, cz, cy, cx, depth, side, rank).

    The score is the size times the largest distance; ties go to the larger centre and edges.
    """
    box = [f(c).alias(f"{c}{n}") for c in "zyx" for n, f in ((0, F.min), (1, F.max))]
    s = labels.where("label <> 0").groupBy("volume_id", "label").agg(F.count(F.lit(1)).alias("voxels"), F.max("dist").alias("deep"), *(F.avg(c).alias(f"c{c}") for c in "zyx"), *box)
    ez, ey, ex = (F.col(f"{c}1") - F.col(f"{c}0") + 1 for c in "zyx")
    fits = F.col("voxels").between(*hybrid["voxels"]) & (F.least(ez, ey, ex) >= hybrid["shortest"]) & (ey <= hybrid["widest"]) & (ex <= hybrid["widest"])
    for c, n, (lo, hi) in zip("zyx", (grid.depth, grid.height, grid.width), hybrid["centroid"], strict=True):
        fits = fits & F.col(f"c{c}").between(int(n * lo), int(n * hi))
    more, low, high = hybrid["side"]
    side = F.least(F.greatest(F.greatest(ey, ex) + more, F.lit(low)), F.lit(high)).cast("long")
    more, low, high = hybrid["depth"]
    deep = F.least(F.greatest(ez + more, F.lit(low)), F.lit(high)).cast("long")
    found = s.where(fits).select("volume_id", "label", (F.col("voxels") * F.col("deep")).alias("score"), *(F.bround(F.col(f"c{c}")).cast("long").alias(f"c{c}") for c in "zyx"), deep.alias("depth"), side.alias("side"))
    best = Window.partitionBy("volume_id").orderBy(*(F.desc(c) for c in ("score", "cz", "cy", "cx", "depth", "side")), "label")
    return found.withColumn("rank", F.row_number().over(best))


def hybrid_rois(vox: DataFrame, grid: Grid, hybrid: dict = HYBRID) -> DataFrame:
    """Crops around the basins of hard tissue: threshold inside a region, opening, closing, filling, peaks, basins, and the best that lie apart."""
    ya, yb, xa, xb = hybrid["region"]
    za, zb = (int(grid.depth * s) for s in hybrid["slab"])
    inside = (F.col("z") >= za) & (F.col("z") < zb) & (F.col("y") > max(hybrid["least"], int(grid.height * ya))) & (F.col("y") < int(grid.height * yb)) & (F.col("x") > max(hybrid["least"], int(grid.width * xa))) & (F.col("x") < int(grid.width * xb))
    hard = written(masks.mask_rows(vox.where(inside & (F.col("v") > hybrid["threshold"]))), "hard")
    hard = written(masks.opening(hard, grid), "hard-opened")
    hard = written(masks.fill_holes(vox, written(masks.closing(hard, grid), "hard-closed"), grid), "hard-filled")
    found = basin_candidates(peak_basins(vox, hard, grid, hybrid["peaks"], hybrid["peak"]), grid, hybrid)
    return _rois(written(found, "basins"), grid, F.col("depth"), F.col("side"), hybrid["apart"], hybrid["most"], "hybrid-tooth-")


def assigned_instances(candidates: DataFrame, least: int = 1, most: int | None = None, share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Voxels go to the first candidate in order that is accepted: (instances, labels).

    ``candidates`` (volume_id, ord, i) are masks that may overlap; a candidate is accepted if its size lies between ``least`` and
    ``most``, and of its voxels at least ``least`` and a part of ``share`` belong to no earlier accepted one. Instances:
    (volume_id, ord, positive, assigned, ratio, accepted, label), labels 1, 2, ... by order, 0 if not accepted; labels:
    (volume_id, i, label). Repeated voxels of a candidate count once.

    Candidates depend on the earlier ones that share a voxel with them. A round decides those that come first at each of
    their voxels, and drops those that have too few voxels left already; so rounds follow the longest chain of
    overlaps, no pairs of candidates are made, and no volume is gathered in one task. Each round is written, and
    voxels are joined with voxels by shuffles, however small their files are.
    """
    rows = written(candidates.select("volume_id", "ord", "i").distinct(), "claims")
    size = rows.groupBy("volume_id", "ord").agg(F.count(F.lit(1)).alias("positive"))
    fits = F.col("positive") >= least if most is None else F.col("positive").between(least, most)
    by, at = ["volume_id", "ord"], ["volume_id", "i"]
    left = written(rows.join(size.where(fits).select(*by), by, "left_semi").withColumn("taken", F.lit(False)), "claims-left")
    won = None
    while left.take(1):
        seen = left.withColumn("first", F.col("ord") == F.min("ord").over(Window.partitionBy(*at)))
        count = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("first").cast("long")).alias("first"), F.sum((~F.col("taken")).cast("long")).alias("free"))
        enough = (F.col("free") >= least) & (F.col("free") / F.col("n") >= share)
        done = written(count.where((F.col("n") == F.col("first")) | ~enough).select(*by, enough.alias("accepted")), "claims-done")
        new = written(left.where(~F.col("taken")).join(done.where("accepted").select(*by), by, "left_semi").select(*at, "ord"), "claims-won")
        won = new if won is None else won.unionByName(new)
        rest = left.join(done.select(*by), by, "left_anti")
        left = written(rest.join(new.select(*at, F.lit(True).alias("_new")).hint("merge"), at, "left").select(*by, "i", (F.col("taken") | F.col("_new").isNotNull()).alias("taken")), "claims-left")
    if won is None:
        won = rows.limit(0).select(*at, "ord")
    owner = won.withColumnRenamed("ord", "owner")
    free = F.sum((F.col("owner").isNull() | (F.col("owner") >= F.col("ord"))).cast("long"))
    counts = rows.join(owner.hint("merge"), at, "left").groupBy(*by).agg(F.count(F.lit(1)).alias("positive"), free.alias("assigned"), F.max(F.coalesce(F.col("owner") == F.col("ord"), F.lit(False))).alias("accepted"))
    nth = F.row_number().over(Window.partitionBy("volume_id", "accepted").orderBy("ord"))
    instances = counts.select(*by, "positive", "assigned", (F.col("assigned") / F.col("positive")).alias("ratio"), "accepted", F.when(F.col("accepted"), nth).otherwise(0).cast("long").alias("label"))
    instances = written(instances, "instances")
    return instances, won.join(instances.where("accepted").select(*by, "label"), by).select(*at, "label")
