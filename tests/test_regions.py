"""Component trees, spaced peaks, basins, crops and claims against plain versions."""

import numpy as np
import pyarrow as pa
import pytest

from tests.test_volumes import _vox
from voxloom.operators import regions, workflows
from voxloom.operators.voxels import Grid


def _flood(inside, steps):
    """Components of a boolean array, numbered by their least index."""
    out = np.full(inside.shape, -1)
    for p in zip(*np.nonzero(inside), strict=True):
        if out[p] >= 0:
            continue
        root, stack = np.ravel_multi_index(p, inside.shape), [p]
        out[p] = root
        while stack:
            a = stack.pop()
            for d in steps:
                q = tuple(x + y for x, y in zip(a, d, strict=True))
                if all(0 <= x < n for x, n in zip(q, inside.shape, strict=True)) and inside[q] and out[q] < 0:
                    out[q] = root
                    stack.append(q)
    return out


ALL26 = [(a - 1, b - 1, c - 1) for a, b, c in np.ndindex(3, 3, 3) if (a, b, c) != (1, 1, 1)]
FACES = [d for d in ALL26 if sum(map(abs, d)) == 1]


@pytest.mark.parametrize(("connectivity", "brick"), [(26, 64), (26, 4), (6, 3)])
def test_component_tree_is_a_labelling_for_each_level(spark, connectivity, brick):
    r = np.random.default_rng(connectivity + brick)
    shape = (5, 9, 11)
    level = np.minimum(4, r.geometric(0.45, shape) - 1)
    value = r.integers(1, 100, shape)
    z, y, x = np.nonzero(level)
    i = np.ravel_multi_index((z, y, x), shape)
    both = [{"volume_id": np.full(len(i), v), "i": i, "x": x, "y": y, "z": z, "v": value[z, y, x], "level": level[z, y, x]} for v in (0, 3)]
    rows = spark.createDataFrame(pa.concat_tables([pa.table(b) for b in both]))
    got = regions.component_tree(rows, Grid(11, 9, 5), 4, connectivity, brick).collect()
    want, below = {}, None
    for k in range(1, 5):
        roots = _flood(level >= k, ALL26 if connectivity == 26 else FACES)
        for root in np.unique(roots[roots >= 0]):
            at = np.argwhere(roots == root)
            v = value[roots == root]
            parent = None if below is None else below[np.unravel_index(root, shape)]
            want[k, root] = (parent, len(at), v.sum(), *(v @ at)[::-1], v.max(), *at.min(axis=0), *(at.max(axis=0) + 1))
        below = roots
    assert len(got) == 2 * len(want)
    for n in got:
        assert tuple(n[c] for c in ("parent", "voxels", "w", "wx", "wy", "wz", "top", "z0", "y0", "x0", "z1", "y1", "x1")) == want[n["level"], n["root"]]


def _apart(peaks, distance):
    """(value, index, place) from the highest on, none nearer than the distance along every axis."""
    kept = []
    for v, i, p in sorted(peaks, key=lambda q: (-q[0], q[1])):
        if all(max(abs(a - b) for a, b in zip(p, q, strict=True)) >= distance for _, _, q in kept):
            kept.append((v, i, p))
    return kept


def _peaks(value, distance, least):
    out = []
    for p in zip(*np.nonzero(value > least), strict=True):
        box = tuple(slice(max(0, c - distance), c + distance + 1) for c in p)
        if value[p] == value[box].max():
            out.append((value[p], int(np.ravel_multi_index(p, value.shape)), p))
    return _apart(out, distance)


@pytest.mark.parametrize("distance", [1, 2, 5])
def test_spaced_peaks_with_plateaus(spark, distance):
    value = np.random.default_rng(distance).integers(0, 6, (7, 12, 13))
    value[2:5, 3:9, 2:11] = 9
    got = regions.spaced_peaks(_vox(spark, value), "v", distance, 1).collect()
    assert [p["i"] for p in sorted(got, key=lambda p: p["place"])] == [i for _, i, _ in _peaks(value, distance, 1)]
    assert regions.spaced_peaks(_vox(spark, value), "v", distance, 99).collect() == []


def test_separate_in_space_with_straight_distances(spark):
    r = np.random.default_rng(8)
    p = r.random((300, 3)) * 9
    df = spark.createDataFrame([(0, k, *p[k].tolist()) for k in range(300)], "g long, id long, x double, y double, z double")
    got = {x["id"] for x in workflows.greedy_apart(df, "g", [("id", "ascending")], 2.0, axes="xyz").where("kept").collect()}
    kept = []
    for k in range(300):
        if all(np.linalg.norm(p[k] - p[q]) >= 2.0 for q in kept):
            kept.append(k)
    assert got == set(kept)


def _shift(mask, d):
    out = np.zeros_like(mask)
    src = tuple(slice(max(0, -s), n - max(0, s)) for s, n in zip(d, mask.shape, strict=True))
    dst = tuple(slice(max(0, s), n - max(0, -s)) for s, n in zip(d, mask.shape, strict=True))
    out[dst] = mask[src]
    return out


def _erode(m):
    return np.logical_and.reduce([m, *(_shift(m, d) for d in FACES)])


def _dilate(m):
    return np.logical_or.reduce([m, *(_shift(m, d) for d in FACES)])


def _basins(dist, marker):
    """Edges over faces from the best on join trees, never two with a marker."""
    ids = [tuple(p) for p in np.argwhere(dist > 0).tolist()]
    flat = {p: int(np.ravel_multi_index(p, dist.shape)) for p in ids}
    edges = []
    for p in ids:
        for d in FACES:
            q = tuple(a + b for a, b in zip(p, d, strict=True))
            if q in flat and p < q:
                edges.append((-min(dist[p], dist[q]), -max(dist[p], dist[q]), flat[p], flat[q], p, q))
    up, mark = {p: p for p in ids}, {p: marker[p] for p in ids}

    def root(p):
        while up[p] != p:
            p = up[p]
        return p

    for *_, p, q in sorted(edges):
        a, b = root(p), root(q)
        if a != b and not (mark[a] and mark[b]):
            up[b], mark[a] = a, mark[a] or mark[b]
    return {p: mark[root(p)] for p in ids}


def test_crops_from_distance_peaks(spark):
    shape, spacing = (22, 24, 26), (0.5, 1.0, 1.5)
    zz, yy, xx = np.indices(shape)
    v = np.zeros(shape, dtype=int)
    for z, y, x, r in ((8, 8, 8, 4.2), (8, 14, 8, 4.2), (12, 10, 17, 5.1), (4, 20, 22, 1.5)):
        v[(zz - z) ** 2 + (yy - y) ** 2 + (xx - x) ** 2 <= r * r] = 2000
    v[8, 8, 8] = v[12, 10, 17] = 0  # holes
    v[1] = 2000  # outside of the slab
    hybrid = regions.HYBRID | {"least": 1, "peaks": 3, "voxels": (40, 5000), "shortest": 3, "widest": 20, "side": (4, 6, 14), "depth": (4, 6, 12), "apart": 3.0}
    grid = Grid(26, 24, 22, spacing[2], spacing[1], spacing[0])
    slab = (zz >= 2) & (zz < 16) & (yy > 1) & (yy < 19) & (xx > 2) & (xx < 23)
    hard = (v > 1350) & slab
    hard = _dilate(_erode(hard))
    hard = _erode(_dilate(hard))
    air = _flood(~hard, FACES)
    rim = np.unique(np.concatenate([air[c] for c in (np.s_[0], np.s_[-1], np.s_[:, 0], np.s_[:, -1], np.s_[:, :, 0], np.s_[:, :, -1])], axis=None))
    hard |= (air >= 0) & ~np.isin(air, rim)
    out = np.argwhere(~hard) * spacing
    dist = np.zeros(shape)
    for p in np.argwhere(hard):
        dist[tuple(p)] = np.sqrt((((p * spacing) - out) ** 2).sum(axis=1).min())
    marker = np.zeros(shape, dtype=int)
    for k, (_, _, p) in enumerate(_peaks(dist, 3, 1.0), 1):
        marker[p] = k
    want = _basins(dist, marker)
    vox = _vox(spark, v)
    mask = vox.join(spark.createDataFrame(pa.table({"i": np.flatnonzero(hard)})), "i", "left_semi").select("volume_id", "i", "x", "y", "z")
    got = regions.peak_basins(vox, mask, grid, 3).collect()
    assert {(r["z"], r["y"], r["x"]): r["label"] for r in got} == want and marker.max() >= 3
    found = []
    for k in range(1, marker.max() + 1):
        at = np.array([p for p, m in want.items() if m == k])
        ext, c = at.max(axis=0) - at.min(axis=0) + 1, at.mean(axis=0)
        if 40 <= len(at) <= 5000 and ext.min() >= 3 and max(ext[1:]) <= 20 and all(int(n * lo) <= a <= int(n * hi) for a, n, (lo, hi) in zip(c, shape, hybrid["centroid"], strict=True)):
            deep = max(dist[p] for p, m in want.items() if m == k)
            found.append((len(at) * deep, *(int(round(a)) for a in c), int(np.clip(ext[0] + 4, 6, 12)), int(np.clip(max(ext[1:]) + 4, 6, 14))))
    found.sort(reverse=True)
    boxes, centers = [], []
    for rank, (_, cz, cy, cx, depth, side) in enumerate(found, 1):
        box = []
        for c, e, n in ((cz, depth, 22), (cy, side, 24), (cx, side, 26)):
            hi = min(n, max(0, c - e // 2) + e)
            box.append((max(0, hi - e), hi))
        mid = (sum(box[1]) / 2, sum(box[2]) / 2)
        if all(np.hypot(mid[0] - a, mid[1] - b) >= 3.0 for a, b in centers):
            centers.append(mid)
            boxes.append((f"hybrid-tooth-{rank:02d}", *(b[0] for b in box), *(b[1] for b in box)))
    rows = regions.hybrid_rois(vox, grid, hybrid).orderBy("rank").collect()
    assert len(boxes) >= 3 and [tuple(r[c] for c in ("name", "z0", "y0", "x0", "z1", "y1", "x1")) for r in rows] == boxes


def _loop(cands, least, most, share):
    owner, out, nth = {}, {}, 0
    for c in sorted(cands):
        mine = cands[c]
        new = [i for i in mine if i not in owner]
        ok = least <= len(mine) <= (most or len(mine)) and len(new) >= least and len(new) / len(mine) >= share
        nth += ok
        out[c] = (len(mine), len(new), ok, nth if ok else 0)
        if ok:
            owner |= dict.fromkeys(new, nth)
    return out, owner


@pytest.mark.parametrize(("least", "most", "share"), [(1, None, 0.0), (4, 12, 0.45), (3, None, 0.8), (99, None, 0.0)])
def test_claims_against_the_loop(spark, least, most, share):
    r = np.random.default_rng(least)
    rows, want = [], {}
    for volume in (0, 1):
        cands = {}
        for c in range(40):
            lo = int(r.integers(0, 150))
            cands[c] = set(range(lo, lo + int(r.integers(1, 16)))) | ({7} if c % 5 == 0 else set())
        rows += [(volume, c, i) for c, v in cands.items() for i in v] * (1 + volume)
        want[volume] = _loop(cands, least, most, share)
    inst, labels = regions.assigned_instances(spark.createDataFrame(rows, "volume_id long, ord long, i long").repartition(3), least, most, share)
    got = {(x["volume_id"], x["ord"]): (x["positive"], x["assigned"], x["accepted"], x["label"]) for x in inst.collect()}
    assert got == {(v, c): x for v, (out, _) in want.items() for c, x in out.items()}
    assert {(x["volume_id"], x["i"]): x["label"] for x in labels.collect()} == {(v, i): n for v, (_, owner) in want.items() for i, n in owner.items()}


def test_no_candidates(spark):
    inst, labels = regions.assigned_instances(spark.createDataFrame([], "volume_id long, ord long, i long"))
    assert inst.collect() == labels.collect() == []
