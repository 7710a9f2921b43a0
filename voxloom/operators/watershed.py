"""Separation of touching objects: cores of the smoothed distance map grow over the mask, the deepest voxels first.

Every voxel joins the core to which it has the path with the highest lowest distance: a maximum spanning forest
rooted in the cores, whose edges join neighbours. Edges go by their lower distance, then by their higher one, then by the
voxels' places. A flood voxel by voxel finds the same heights; where basins meet it gives a voxel to the basin that
reaches it first, the forest to the neighbour with the higher distance. Bricks contract their own part of the forest; what is left is solved as a graph, by rounds of a best edge by key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.operators.masks import _SHIFT, box, component_roots, offsets, smooth, squared_distance, with_rims
from voxloom.operators.staging import linked_sets, written
from voxloom.operators.voxels import Grid

CORE = 7.0
BRICK = 64
SMALL = 500_000  # edges left of all volumes, up to which one task for each volume ends the forest; beyond, rounds on Spark
_PARTS = "volume_id long, kind string, i long, x long, y long, z long, node long, marker long, other long, lo double, hi double, p long, q long"


def _order(lo: np.ndarray, hi: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Ranks of edges, the best highest."""
    rank = np.empty(len(lo), dtype=np.int64)
    rank[np.lexsort((-q, -p, hi, lo))] = np.arange(len(lo))
    return rank


def _contracted(i, x, y, z, dist, marker, own, grid: Grid, connectivity: int):
    """Of one brick and the voxels around it: the node of each own voxel, and the best edge between each two nodes.

    Every voxel without a marker points to its best neighbour; those inside the brick are followed to their end, which
    is a marked voxel, the better end of a mutual pair, or a voxel that points out of the brick.
    """
    place, steps = box(z, y, x)
    there = np.full(int(place.max()) + sum(steps) + 1, -1)
    there[place] = np.arange(len(i))
    ps, qs = [], []
    for dx, dy, dz in (d for d in offsets(connectivity) if d > (0, 0, 0)):
        at = there[place + dz * steps[0] + dy * steps[1] + dx]
        hit = np.flatnonzero((at >= 0) & (own | own[at]))
        ps.append(hit)
        qs.append(at[hit])
    p, q = np.concatenate(ps), np.concatenate(qs)
    lo, hi = np.minimum(dist[p], dist[q]), np.maximum(dist[p], dist[q])
    a, b = np.minimum(i[p], i[q]), np.maximum(i[p], i[q])
    _, height = np.unique(dist, return_inverse=True)
    _, nth = np.unique(i, return_inverse=True)
    n = len(i)
    rank = np.empty(len(p), dtype=np.int64)
    rank[np.lexsort((-(np.minimum(nth[p], nth[q]) * n + np.maximum(nth[p], nth[q])), np.minimum(height[p], height[q]) * n + np.maximum(height[p], height[q])))] = np.arange(len(p))
    best = np.full(len(i), -1)
    np.maximum.at(best, p, rank)
    np.maximum.at(best, q, rank)
    edge = np.empty(len(rank), dtype=np.int64)
    edge[rank] = np.arange(len(rank))
    to = np.arange(len(i))
    goes = np.flatnonzero(own & (marker == 0) & (best >= 0))
    e = edge[best[goes]]
    to[goes] = np.where(p[e] == goes, q[e], p[e])
    to[~own[to]] = np.flatnonzero(~own[to])  # the best neighbour is in another brick: stays an end
    pair = (to[to] == np.arange(len(i))) & (to > np.arange(len(i)))
    to[pair] = np.flatnonzero(pair)
    while (to[to] != to).any():
        to = to[to]
    # edges between nodes; a voxel of another brick stands for its node
    u, v = np.where(own[p], to[p], -1), np.where(own[q], to[q], -1)
    keep = u != v
    p, q, u, v, lo, hi, a, b, rank = (c[keep] for c in (p, q, u, v, lo, hi, a, b, rank))
    flip = u < 0
    p, q, u, v = np.where(flip, q, p), np.where(flip, p, q), np.where(flip, v, u), np.where(flip, u, v)
    far = np.where(v >= 0, i[np.maximum(v, 0)], i[q])
    node = i[u]
    swap = (v >= 0) & (node > far)
    node, far = np.where(swap, far, node), np.where(swap, node, far)
    by = np.lexsort((-rank, v < 0, far, node))
    first = np.ones(len(by), dtype=bool)
    first[1:] = (node[by][1:] != node[by][:-1]) | (far[by][1:] != far[by][:-1]) | ((v < 0)[by][1:] != (v < 0)[by][:-1])
    by = by[first]
    return to, (node[by], far[by], (v < 0)[by], lo[by], hi[by], a[by], b[by])


def _grown(node: np.ndarray, marker: np.ndarray, u: np.ndarray, v: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Markers of all nodes: edges from the best on join trees, but never two that have a marker."""
    up = list(range(len(node)))
    mark = marker.tolist()

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    places = np.argsort(node)
    ends = [places[np.searchsorted(node[places], c)].tolist() for c in (u, v)]
    for e in np.argsort(-rank).tolist():
        a, b = root(ends[0][e]), root(ends[1][e])
        if a != b and not (mark[a] and mark[b]):
            up[b] = a
            mark[a] = mark[a] or mark[b]
    return np.array([mark[root(k)] for k in range(len(node))], dtype=np.int64)


_EDGE = ["lo", "hi", "p", "q"]


def _best(*cols: str):
    """The best edge of a group, with ``cols``."""
    return F.max(F.struct("lo", "hi", (-F.col("p")).alias("p"), (-F.col("q")).alias("q"), *cols)).alias("b")


def _ended(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(volume_id, node, marker) of all nodes; one task for each volume."""
    rows = nodes.select("volume_id", "node", "marker", *(F.lit(None).cast("long").alias(c) for c in ("other", "p", "q")), *(F.lit(None).cast("double").alias(c) for c in ("lo", "hi")))
    rows = rows.unionByName(edges.select("volume_id", F.col("u").alias("node"), F.lit(None).cast("long").alias("marker"), F.col("v").alias("other"), *_EDGE))

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        is_edge = np.asarray(group.column("other").is_valid())
        n, e = group.filter(pa.array(~is_edge)), group.filter(pa.array(is_edge))
        col = lambda t, c: t.column(c).to_numpy(zero_copy_only=False)
        rank = _order(*(col(e, c) for c in _EDGE))
        got = _grown(col(n, "node"), col(n, "marker").astype(np.int64), col(e, "node"), col(e, "other").astype(np.int64), rank)
        return pa.table({"volume_id": n.column("volume_id"), "node": n.column("node"), "marker": pa.array(got)})

    return rows.groupBy("volume_id").applyInArrow(run, "volume_id long, node long, marker long")


def _by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(volume_id, node, marker) of all nodes: each tree without a marker joins along its best edge, in rounds."""
    tree = written(nodes.withColumn("tree", F.col("node")), "ws-trees")
    while True:
        of = tree.groupBy("volume_id", "tree").agg(F.max("marker").alias("marker"))
        both = edges.unionByName(edges.select("volume_id", F.col("v").alias("u"), F.col("u").alias("v"), *_EDGE))
        free = of.where("marker = 0").select("volume_id", F.col("tree").alias("u"))
        picks = both.join(free, ["volume_id", "u"]).groupBy("volume_id", "u").agg(_best("v")).select("volume_id", "u", F.col("b.v").alias("v"))
        picks = written(picks, "ws-picks")
        if not picks.take(1):
            break
        key = lambda c: F.col("volume_id") * _SHIFT + F.col(c)
        sets = written(linked_sets(picks.select(key("u").alias("a"), key("v").alias("b"))), "ws-sets")
        sets = sets.select(F.floor(F.col("node") / _SHIFT).alias("volume_id"), (F.col("node") % _SHIFT).alias("tree"), (F.col("root") % _SHIFT).alias("_to"))
        tree = written(tree.join(sets, ["volume_id", "tree"], "left").select("volume_id", "node", "marker", F.coalesce("_to", "tree").alias("tree")), "ws-trees")
        for c in ("u", "v"):
            edges = edges.join(sets.withColumnRenamed("tree", c), ["volume_id", c], "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        edges = edges.where("u <> v").groupBy("volume_id", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(_best())
        edges = written(edges.select("volume_id", "u", "v", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), (-F.col("b.p")).alias("p"), (-F.col("b.q")).alias("q")), "ws-edges")
    of = tree.groupBy("volume_id", "tree").agg(F.max("marker").alias("marker"))
    return tree.drop("marker").join(of, ["volume_id", "tree"]).select("volume_id", "node", "marker")


def grown(rows: DataFrame, grid: Grid, brick: int = BRICK, small: int = SMALL, connectivity: int = 26) -> DataFrame:
    """``rows`` (volume_id, i, x, y, z, dist, marker: 0 for none) with ``basin``, the marker that each voxel joins; 0 where none is connected."""
    cols = ["volume_id", "i", "x", "y", "z"]
    rows = rows.select(*(F.col(c).cast("long").alias(c) for c in cols), F.col("dist").cast("double").alias("dist"), F.col("marker").cast("long").alias("marker"))
    dealt = with_rims(rows.select(*cols, "dist", "marker"), grid, brick).withColumnsRenamed({"_own": "own", "_bx": "bx", "_by": "by", "_bz": "bz"})

    def contract(group: pa.Table) -> pa.Table:
        c = {n: group.column(n).to_numpy(zero_copy_only=False) for n in ("i", "x", "y", "z", "dist", "marker", "own")}
        volume = group.column("volume_id")[0].as_py()
        to, (node, far, out, lo, hi, p, q) = _contracted(*(c[n] for n in ("i", "x", "y", "z", "dist", "marker")), c["own"].astype(bool), grid, connectivity)
        mine = np.flatnonzero(c["own"])
        n, m = len(mine), len(node)
        none = lambda k, t: pa.nulls(k, t)
        voxels = [pa.array(np.full(n, volume)), pa.array(["voxel"] * n, pa.string()), *(pa.array(c[k][mine]) for k in "ixyz"), pa.array(c["i"][to[mine]]), pa.array(c["marker"][to[mine]]), none(n, pa.int64()), none(n, pa.float64()), none(n, pa.float64()), none(n, pa.int64()), none(n, pa.int64())]
        edges = [pa.array(np.full(m, volume)), pa.array(np.where(out, "out", "edge").tolist(), pa.string()), *(none(m, pa.int64()) for _ in range(4)), pa.array(node), none(m, pa.int64()), pa.array(far), pa.array(lo), pa.array(hi), pa.array(p), pa.array(q)]
        names = [x.split()[0] for x in _PARTS.split(", ")]
        return pa.concat_tables([pa.table(dict(zip(names, t, strict=True))) for t in (voxels, edges)])

    parts = written(dealt.groupBy("volume_id", "bx", "by", "bz").applyInArrow(contract, _PARTS), "ws-bricks")
    voxels = parts.where("kind = 'voxel'").select(*cols, "node", "marker")
    nodes = voxels.groupBy("volume_id", "node").agg(F.max("marker").alias("marker"))
    inner = parts.where("kind = 'edge'").select("volume_id", F.col("node").alias("u"), F.col("other").alias("v"), *_EDGE)
    outer = parts.where("kind = 'out'").select("volume_id", F.col("node").alias("u"), F.col("other").alias("i"), *_EDGE)
    outer = outer.join(voxels.select("volume_id", "i", F.col("node").alias("v")), ["volume_id", "i"]).select("volume_id", "u", "v", *_EDGE)
    edges = written(inner.unionByName(outer), "ws-graph")
    solved = _ended(nodes, edges) if edges.count() <= small else _by_rounds(nodes, edges)
    solved = written(solved.withColumnRenamed("marker", "basin"), "ws-nodes")
    return voxels.drop("marker").join(solved, ["volume_id", "node"]).select(*cols, "basin")


def watershed(vox: DataFrame, mask: DataFrame, grid: Grid, core: float = CORE) -> DataFrame:
    """(volume_id, i, x, y, z, label): basins of the mask, numbered by the first voxel of their markers.

    A marker is a 26-connected part of the smoothed distance map from ``core`` on, or, of an object that
    nowhere reaches it, its deepest voxel.
    """
    d = squared_distance(vox, mask, grid).select("volume_id", "x", "y", "z", F.sqrt("d2").cast("float").cast("double").alias("v"))
    d = written(d.withColumn("i", grid.index(F.col("x"), F.col("y"), F.col("z"))), "ws-distance")
    s = smooth(d, grid).select("volume_id", "i", "x", "y", "z", F.col("smooth").cast("float").cast("double").alias("dist"))
    comp = written(component_roots(s, grid, 26), "ws-components")
    top = comp.groupBy("volume_id", "root").agg(F.max("dist").alias("most"), F.max_by("i", F.struct("dist", -F.col("i"))).alias("peak"))
    seed = comp.join(top, ["volume_id", "root"]).where((F.col("dist") >= core) | ((F.col("most") < core) & (F.col("i") == F.col("peak"))))
    marker = component_roots(seed.select("volume_id", "i", "x", "y", "z"), grid, 26).select("volume_id", "i", F.col("root").alias("marker"))
    rows = comp.join(marker, ["volume_id", "i"], "left").select("volume_id", "i", "x", "y", "z", "dist", F.coalesce(F.col("marker") + 1, F.lit(0)).alias("marker"))
    basins = written(grown(rows, grid), "ws-basins")
    names = basins.select("volume_id", "basin").distinct()
    names = names.withColumn("label", F.row_number().over(Window.partitionBy("volume_id").orderBy("basin")).cast("long"))
    return basins.join(names, ["volume_id", "basin"]).select("volume_id", "i", "x", "y", "z", "label")
