"""Queries over scalar volumes and masks, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxloom.functions.jsnum import clamp_int16, wrap_int16
from voxloom.operators import masks as M
from voxloom.operators import mesh, voxels
from voxloom.operators.inference import segment_argmax, segment_mean
from voxloom.operators.masks import PRESETS as RANGES
from voxloom.operators.voxels import Grid
from voxloom.operators.watershed import watershed
from voxloom.plans.tables import VOX, grid, vox

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_GRAY = "CAST(floor(least(greatest((v - (500 - 2600 / 2.0)) / 2600.0, 0), 1) * 255 + 0.5) AS BIGINT)"
_VALUES = ", ".join(f"('{n}', {a}, {b})" for n, a, b in RANGES)


@query(f"WITH {VOX}, r(preset, lo, hi) AS (VALUES {_VALUES}) SELECT preset, count(*) AS voxels FROM vox JOIN r ON v BETWEEN lo AND hi GROUP BY preset")
def threshold_presets(spark, d):
    return M.preset_counts(vox(spark, d))


@query(f"WITH {VOX} SELECT {_GRAY} AS gray, count(*) AS n FROM vox GROUP BY 1")
def window_gray_hist(spark, d):
    return voxels.windowed(vox(spark, d), 2600, 500).groupBy("gray").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VOX} SELECT i, ((v * 37 + 32768) % 65536 + 65536) % 65536 - 32768 AS wrapped FROM vox")
def int16_wrap(spark, d):
    return vox(spark, d).select("i", wrap_int16(F.col("v") * 37).alias("wrapped"))


@query(f"WITH {VOX} SELECT i, least(greatest(v * 37, -32768), 32767) AS clamped FROM vox")
def int16_clamp(spark, d):
    return vox(spark, d).select("i", clamp_int16(F.col("v") * 37).alias("clamped"))


_HIST = """r AS (SELECT min(v) AS lo, max(v) AS hi FROM vox),
h AS (SELECT CAST(least(greatest(floor((v - lo) / CAST(greatest(1, hi - lo) AS DOUBLE) * 4095 + 0.5), 0), 4095) AS BIGINT) AS bin, lo, hi, count(*) AS n FROM vox, r GROUP BY 1, 2, 3),
c AS (SELECT bin, lo, hi, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total FROM h)"""


def _value(p: float) -> str:
    return f"(SELECT lo + min(bin) / 4095.0::DOUBLE * (hi - lo) FROM c WHERE cum > greatest(0, least(total - 1, floor(total * {p}))) GROUP BY lo, hi)"


@query(f"WITH {VOX}, {_HIST} SELECT bin, n FROM h")
def scalar_hist4096(spark, d):
    return voxels.histogram(vox(spark, d)).select(F.col("bin").cast("long"), "n")


@query(f"WITH {VOX}, {_HIST} SELECT CAST(greatest(1, floor({_value(0.999)} - {_value(0.05)} + 0.5)) AS BIGINT) AS wl_window, CAST(floor(({_value(0.999)} + {_value(0.05)}) / 2 + 0.5) AS BIGINT) AS wl_level")
def hist_window_level(spark, d):
    return voxels.auto_window_level(vox(spark, d)).select(F.col("wl_window").cast("long"), F.col("wl_level").cast("long"))


@query(f"WITH {VOX}, {_HIST} SELECT CAST(least(greatest(floor(greatest(500, {_value(0.95)} * 0.45 + {_value(0.99)} * 0.55) + 0.5), (SELECT lo FROM r)), (SELECT hi FROM r)) AS BIGINT) AS threshold")
def preview_threshold(spark, d):
    return voxels.preview_threshold(vox(spark, d), 500).select(F.col("threshold").cast("long"))


@query(f"WITH {VOX} SELECT i, round((least(greatest(CAST(v AS DOUBLE), -208.0::DOUBLE), 3070.0::DOUBLE) - 1178.26::DOUBLE) / 611.71::DOUBLE, 6) AS norm FROM vox")
def ct_normalize(spark, d):
    return voxels.ct_normalize(vox(spark, d), -208, 3070, 1178.26, 611.71).select("i", F.round("norm", 6).alias("norm"))


@query(f"WITH {VOX}, s AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM vox) SELECT i, round((v - m) / coalesce(nullif(s, 0), 1), 6) AS norm FROM vox, s")
def zscore(spark, d):
    return voxels.zscore(vox(spark, d)).select("i", F.round("norm", 6).alias("norm"))


@query(
    f"""WITH {VOX}, r AS (SELECT min(v) AS lo, max(v) AS hi FROM vox),
h AS (SELECT CAST(floor((v - lo) * (4095.0::DOUBLE / (hi - lo)) + 0.5) AS BIGINT) AS bin, count(*) AS n FROM vox, r GROUP BY 1),
c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS total FROM h),
q AS (SELECT lo + (SELECT min(bin) FROM c WHERE cum >= total * 0.5 / 100) / (4095.0::DOUBLE / (hi - lo)) AS a, lo + (SELECT min(bin) FROM c WHERE cum >= total * 99.5 / 100) / (4095.0::DOUBLE / (hi - lo)) AS b FROM r)
SELECT i, round(least(greatest((v - a) / (b - a), 0), 1), 6) AS norm FROM vox, q"""
)
def percentile_norm(spark, d):
    return voxels.percentile_normalize(vox(spark, d)).select("i", F.round("norm", 6).alias("norm"))


@query(f"WITH {VOX} SELECT y AS row, x AS col, v, {_GRAY} AS gray FROM vox WHERE z = 1")
def slice_axial(spark, d):
    return voxels.windowed(voxels.axial_slice(vox(spark, d), 1), 2600, 500).select("row", "col", "v", "gray")


@query(f"WITH {VOX} SELECT (SELECT max(z) FROM vox) - z AS row, x AS col, v FROM vox WHERE y = 12")
def slice_coronal(spark, d):
    return voxels.coronal_slice(vox(spark, d), 12, grid(spark, d)).select("row", "col", "v")


@query(f"WITH {VOX} SELECT (SELECT max(z) FROM vox) - z AS row, y AS col, v FROM vox WHERE x = 12")
def slice_sagittal(spark, d):
    return voxels.sagittal_slice(vox(spark, d), 12, grid(spark, d)).select("row", "col", "v")


@query(f"WITH {VOX} SELECT x, y, max(v) AS v FROM vox WHERE z BETWEEN 0 AND 5 GROUP BY x, y")
def mip_axial_band(spark, d):
    return voxels.axial_mip(vox(spark, d), 0, 5).select("x", "y", "v")


@query(f"WITH {VOX} SELECT (z * 8 + (y - 5)) * 10 + (x - 3) AS i, v FROM vox WHERE x >= 3 AND x < 13 AND y >= 5 AND y < 13 AND z >= 0 AND z < 2")
def roi_crop(spark, d):
    return voxels.crop(vox(spark, d), (3, 5, 0), (13, 13, 2)).select("i", "v")


@query(
    f"""WITH {VOX}, n AS (SELECT max(z) + 1 AS d, CAST(greatest(1, floor((max(z) + 1) / 2.0 + 0.5)) AS BIGINT) AS h FROM vox),
o AS (SELECT x, y, z, d, h FROM n, range(0, 13) AS a(x), range(0, 13) AS b(y), range(0, 100000) AS c(z) WHERE z < h),
s AS (SELECT x, y, z, CAST(least(greatest(floor((x + 0.5) * (25.0::DOUBLE / 13) - 0.5 + 0.5), 0), 24) AS BIGINT) AS ix, CAST(least(greatest(floor((y + 0.5) * (25.0::DOUBLE / 13) - 0.5 + 0.5), 0), 24) AS BIGINT) AS iy,
 CAST(least(greatest(floor((z + 0.5) * (d::DOUBLE / h) - 0.5 + 0.5), 0), d - 1) AS BIGINT) AS iz FROM o)
SELECT s.x, s.y, s.z, coalesce(v.label, 0) AS label FROM s LEFT JOIN vox v ON v.x = ix AND v.y = iy AND v.z = iz"""
)
def resample_nearest_half(spark, d):
    g = grid(spark, d)
    out = Grid(13, 13, max(1, int(g.depth / 2 + 0.5)))
    return voxels.resample_nearest(vox(spark, d), g, out, "label").select(*(F.col(c).cast("long").alias(c) for c in ("x", "y", "z", "label")))


def _axis(c: str, n: str) -> str:
    return f"least(greatest(({c} + 0.5) / 2 - 0.5, 0), {n} - 1)::DOUBLE"


@query(
    f"""WITH {VOX}, n AS (SELECT max(z) + 1 AS d FROM vox),
o AS (SELECT x, y, z, d, {_axis("x", "25")} AS fx, {_axis("y", "25")} AS fy, {_axis("z", "d")} AS fz FROM n, range(0, 50) AS a(x), range(0, 50) AS b(y), range(0, 100000) AS c(z) WHERE z < 2 * d),
k AS (SELECT x, y, z, least(floor(fx) + a, 24) AS ix, least(floor(fy) + b, 24) AS iy, least(floor(fz) + c, d - 1) AS iz,
 (CASE WHEN a = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE WHEN b = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) * (CASE WHEN c = 1 THEN fz - floor(fz) ELSE 1 - (fz - floor(fz)) END) AS w
 FROM o, range(0, 2) AS p(a), range(0, 2) AS q(b), range(0, 2) AS r(c))
SELECT k.x, k.y, k.z, round(sum(w * coalesce(v.v, 0)), 4) AS v FROM k LEFT JOIN vox v ON v.x = ix AND v.y = iy AND v.z = iz WHERE w > 0 GROUP BY ALL"""
)
def resample_trilinear_x2(spark, d):
    g = grid(spark, d)
    got = voxels.resample_linear(vox(spark, d), g, Grid(50, 50, 2 * g.depth, 0.5, 0.5, 0.5))
    return got.select(*(F.col(c).cast("long").alias(c) for c in "xyz"), F.round("v", 4).alias("v"))


@query(f"WITH {VOX}, c(value) AS (VALUES (1), (2), (3), (4), (5), (6), (7)) SELECT CAST(value AS BIGINT) AS value, count(label) AS voxels, round(count(label) * 0.064::DOUBLE, 6) AS volume_mm3 FROM c LEFT JOIN vox ON label = value GROUP BY value")
def class_stats(spark, d):
    classes = spark.createDataFrame([(k,) for k in range(1, 8)], "value long")
    got = voxels.class_stats(vox(spark, d).where("label <> 0"), classes, Grid(25, 25, 1, 0.4, 0.4, 0.4))
    return got.select("value", "voxels", F.round("volume_mm3", 6).alias("volume_mm3"))


_FACES = "dirs AS (SELECT dx, dy, dz FROM range(-1, 2) AS a(dx), range(-1, 2) AS b(dy), range(-1, 2) AS c(dz) WHERE abs(dx) + abs(dy) + abs(dz) = 1)"
_DIRS = {6: "abs(dx) + abs(dy) + abs(dz) = 1", 26: "NOT (dx = 0 AND dy = 0 AND dz = 0)"}


def _closure(where: str, n: int, same: str = "", src: str = "vox") -> str:
    return f"""fg AS (SELECT i, x, y, z, v, label FROM {src} WHERE {where}),
dirs AS (SELECT dx, dy, dz FROM range(-1, 2) AS a(dx), range(-1, 2) AS b(dy), range(-1, 2) AS c(dz) WHERE {_DIRS[n]}),
e AS MATERIALIZED (SELECT a.i AS p, b.i AS q FROM fg a, dirs, fg b WHERE b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz {same}),
r AS (SELECT i AS node, i AS root FROM fg UNION SELECT e.q, r.root FROM r JOIN e ON r.node = e.p),
roots AS (SELECT node AS i, min(root) AS root FROM r GROUP BY node),
rooted AS (SELECT fg.*, root FROM fg JOIN roots USING (i))"""


_STATS = """SELECT row_number() OVER (ORDER BY root) AS comp, count(*) AS voxels, min(z) AS z0, min(y) AS y0, min(x) AS x0, max(z) + 1 AS z1, max(y) + 1 AS y1, max(x) + 1 AS x1,
round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx FROM rooted GROUP BY root"""


def _stats(rooted):
    s = M.component_stats(rooted)
    return s.select("comp", "voxels", "z0", "y0", "x0", "z1", "y1", "x1", *(F.round(f"c{c}", 6).alias(f"c{c}") for c in "zyx"))


@query(f"WITH RECURSIVE {VOX}, {_closure('v > 3000', 6)} {_STATS}")
def cc6_stats(spark, d):
    return _stats(M.component_roots(M.threshold(vox(spark, d), 3001, 1e9), grid(spark, d), 6))


@query(f"WITH RECURSIVE {VOX}, {_closure('v > 3600', 26)} {_STATS}")
def cc26_stats(spark, d):
    return _stats(M.component_roots(M.threshold(vox(spark, d), 3601, 1e9), grid(spark, d), 26))


@query(f"WITH RECURSIVE {VOX}, {_closure('v > 3000', 6)} SELECT i FROM rooted WHERE root = (SELECT root FROM rooted GROUP BY root ORDER BY count(*) DESC, root LIMIT 1)")
def keep_largest(spark, d):
    return M.keep_largest(M.component_roots(M.threshold(vox(spark, d), 3001, 1e9), grid(spark, d), 6)).select("i")


@query(f"WITH RECURSIVE {VOX}, {_closure('v > 3000', 6)} SELECT root, count(*) AS voxels, row_number() OVER (ORDER BY count(*) DESC, root) AS rank FROM rooted GROUP BY root ORDER BY count(*) DESC, root LIMIT 24")
def split_top24(spark, d):
    got = M.largest(M.component_roots(M.threshold(vox(spark, d), 3001, 1e9), grid(spark, d), 6), 24)
    return got.select("root", "voxels", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH RECURSIVE {VOX}, fg AS (SELECT * FROM vox WHERE v >= 1500), {_FACES},
e AS MATERIALIZED (SELECT a.i AS p, b.i AS q FROM fg a, dirs, fg b WHERE b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz),
r AS (SELECT min(i) AS i FROM fg UNION SELECT q FROM r JOIN e ON r.i = p) SELECT i FROM r"""
)
def region_grow(spark, d):
    v, g = vox(spark, d), grid(spark, d)
    s = v.where("v >= 1500").agg(F.min("i")).head()[0] or 0
    return M.region_grow(v, g, (s % 25, s // 25 % 25, s // 625), 1500, 100000, 6).select("i")


@query(
    f"""WITH RECURSIVE {VOX}, {_closure('v < 0', 6)}, n AS (SELECT max(z) AS d FROM vox),
ok AS (SELECT root FROM rooted, n GROUP BY root HAVING count(*) <= 20 AND NOT bool_or(x = 0 OR y = 0 OR z = 0 OR x = 24 OR y = 24 OR z = d))
SELECT i FROM vox WHERE v >= 0 UNION ALL SELECT i FROM rooted JOIN ok USING (root)"""
)
def fill_holes(spark, d):
    v = vox(spark, d)
    return M.fill_holes(v, M.threshold(v, 0, 1e9), grid(spark, d), 20).select("i")


@query(f"WITH RECURSIVE {VOX}, {_closure('v > 3000', 6)} SELECT i FROM rooted WHERE root IN (SELECT root FROM rooted GROUP BY root HAVING count(*) >= 3)")
def remove_small(spark, d):
    g = grid(spark, d, 0.5, 0.5, 0.5)
    return M.remove_small(M.component_roots(M.threshold(vox(spark, d), 3001, 1e9), g, 6), 0.3, g).select("i")


@query(f"WITH RECURSIVE {VOX}, {_closure('label <> 0', 6, 'AND b.label = a.label')} SELECT i, label FROM rooted WHERE label = 3 OR root IN (SELECT root FROM rooted GROUP BY root HAVING count(*) >= 4)")
def remove_small_per_label(spark, d):
    g = grid(spark, d)
    rooted = M.component_roots(vox(spark, d).where("label <> 0").select("volume_id", "i", "x", "y", "z", "label"), g, 6, by="label")
    return M.remove_small(rooted, 4, g).unionByName(rooted.where("label = 3")).distinct().select("i", "label")




@query(
    f"""WITH {VOX}, {_FACES}, fg AS (SELECT * FROM vox WHERE v > 1500),
f AS (SELECT a.i, dx, dy, dz FROM fg a, dirs WHERE NOT EXISTS (SELECT 1 FROM fg b WHERE b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz))
SELECT 2 * count(*) AS triangles, round(sum(CASE WHEN dx <> 0 THEN 0.5 * 0.7 WHEN dy <> 0 THEN 0.4 * 0.7 ELSE 0.4 * 0.5 END), 4)::DOUBLE AS area_mm2 FROM f"""
)
def surface_estimates(spark, d):
    got = M.surface_estimates(M.threshold(vox(spark, d), 1501, 1e9), grid(spark, d, 0.4, 0.5, 0.7))
    return got.select("triangles", F.round("area_mm2", 4).alias("area_mm2"))


@query(
    f"""WITH {VOX}, {_FACES}, fg AS (SELECT * FROM vox WHERE v > 1500)
SELECT a.i, CAST(dx AS DOUBLE) AS nx, CAST(dy AS DOUBLE) AS ny, CAST(dz AS DOUBLE) AS nz, count(*) * 2 AS triangles FROM fg a, dirs
WHERE NOT EXISTS (SELECT 1 FROM fg b WHERE b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz) GROUP BY ALL"""
)
def exposed_faces(spark, d):
    t = mesh.face_triangles(M.threshold(vox(spark, d), 1501, 1e9), grid(spark, d))
    return t.groupBy("i", "nx", "ny", "nz").agg(F.count(F.lit(1)).alias("triangles"))


_NEAR6 = f"{_FACES}, fg AS (SELECT * FROM vox WHERE v > 500)"


@query(f"WITH {VOX}, {_NEAR6} SELECT b.i FROM fg a, dirs JOIN fg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY b.i HAVING count(*) = 6")
def erode6(spark, d):
    return M.erode(M.threshold(vox(spark, d), 501, 1e9), grid(spark, d)).select("i")


@query(f"WITH {VOX}, {_FACES}, fg AS (SELECT * FROM vox WHERE v > 3500), n AS (SELECT max(z) AS d FROM vox) SELECT i FROM fg UNION SELECT ((a.z + dz) * 25 + a.y + dy) * 25 + a.x + dx FROM fg a, dirs, n WHERE a.x + dx BETWEEN 0 AND 24 AND a.y + dy BETWEEN 0 AND 24 AND a.z + dz BETWEEN 0 AND d")
def dilate6(spark, d):
    return M.dilate(M.threshold(vox(spark, d), 3501, 1e9), grid(spark, d)).select("i")


@query(
    f"""WITH {VOX}, {_NEAR6}, m AS (SELECT max(z) AS d FROM vox), s AS (SELECT b.i, sum(a.v) AS s FROM fg a, dirs JOIN fg b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY b.i)
SELECT fg.i, round((v + coalesce(s, 0)) / (7.0::DOUBLE - (x = 0)::INT - (y = 0)::INT - (z = 0)::INT - (x = 24)::INT - (y = 24)::INT - (z = d)::INT), 4) AS smooth FROM m, fg LEFT JOIN s ON s.i = fg.i"""
)
def smooth6(spark, d):
    got = M.smooth(vox(spark, d).where("v > 500"), grid(spark, d))
    return got.select("i", F.round("smooth", 4).alias("smooth"))


@query(f"WITH {VOX} SELECT DISTINCT x // 3 AS x, y // 3 AS y, z // 3 AS z FROM vox WHERE v > 3500")
def downsample_any(spark, d):
    return M.downsample_any(M.threshold(vox(spark, d), 3501, 1e9), 3).select("x", "y", "z")


@query(f"WITH {VOX} SELECT a.i, CAST(min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS DOUBLE) AS d2 FROM vox a, vox b WHERE a.v > -700 AND b.v <= -700 GROUP BY a.i")
def distance_squared(spark, d):
    v, g = vox(spark, d), grid(spark, d)
    got = M.squared_distance(v, M.threshold(v, -699, 1e9), g)
    return got.select(g.index(F.col("x"), F.col("y"), F.col("z")).alias("i"), "d2")


@query(
    f"""WITH {VOX}, g AS (SELECT i, label, v, {_GRAY}::DOUBLE AS gray FROM vox),
a AS (SELECT i, v, CASE WHEN label = 1 THEN 255 * (81 / 255.0::DOUBLE) + gray * (1 - 81 / 255.0::DOUBLE) ELSE gray END AS r, CASE WHEN label = 1 THEN 64 * (81 / 255.0::DOUBLE) + gray * (1 - 81 / 255.0::DOUBLE) ELSE gray END AS gr FROM g)
SELECT i, round(CASE WHEN v > 2000 THEN 10 * (108 / 255.0::DOUBLE) + r * (1 - 108 / 255.0::DOUBLE) ELSE r END, 4) AS r, round(CASE WHEN v > 2000 THEN 200 * (108 / 255.0::DOUBLE) + gr * (1 - 108 / 255.0::DOUBLE) ELSE gr END, 4) AS g FROM a"""
)
def overlay_over(spark, d):
    w = voxels.windowed(vox(spark, d), 2600, 500)
    r, g, _ = M.overlay(F.col("gray"), [(F.col("label") == 1, (255, 64, 0), 0.45), (F.col("v") > 2000, (10, 200, 0), 0.6)])
    return w.select("i", F.round(r, 4).alias("r"), F.round(g, 4).alias("g"))


@query(f"WITH {VOX} SELECT i, CASE WHEN z = 1 AND abs(x - 12) <= 6 AND abs(y - 11) <= 5 AND sqrt(((x - 12) * 0.5) ** 2 + ((y - 11) * 0.6) ** 2) <= 3.0 AND (label = 3 OR label <> 2) THEN 3 ELSE label END AS label FROM vox")
def brush_disc(spark, d):
    v = vox(spark, d)
    return M.brush(v, Grid(25, 25, 1, 0.5, 0.6, 1.0), (12, 11, 1), 6.0, 3, locked=(2,)).select("i", F.col("label").cast("long").alias("label"))


@query(f"WITH {VOX}, l AS (SELECT i, 1 AS ord, 10 AS label FROM vox WHERE v > 0 UNION ALL SELECT i, 2, 20 FROM vox WHERE v > 1000 AND x > 5 UNION ALL SELECT i, 3, 30 FROM vox WHERE label = 4) SELECT i, CAST(arg_max(label, ord) AS BIGINT) AS label FROM l GROUP BY i")
def labelmap_merge(spark, d):
    v = vox(spark, d)
    layer = lambda w, o, k: v.where(w).select("volume_id", "i", F.lit(o).alias("ord"), F.lit(k).cast("long").alias("label"))
    return M.merge_labels(layer("v > 0", 1, 10).unionByName(layer("v > 1000 and x > 5", 2, 20)).unionByName(layer("label = 4", 3, 30))).select("i", "label")


@query(f"WITH {VOX} SELECT i FROM vox WHERE (v > 3000 OR label = 1) AND NOT v > 3800")
def mask_set_operations(spark, d):
    v = vox(spark, d)
    m = lambda w: v.where(w).select("volume_id", "i")
    return m("v > 3000").union(m("label = 1")).distinct().join(m("v > 3800"), ["volume_id", "i"], "left_anti").select("i")


@query(f"WITH {VOX} SELECT label, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max, round(avg(v), 6) AS mean, count(v) AS count FROM vox GROUP BY label")
def density_by_label(spark, d):
    from voxloom.functions.geometry import density_stats

    return density_stats(vox(spark, d), "v", "label").select("label", "min", "max", F.round("mean", 6).alias("mean"), "count")


_A = "(sin(v * 0.01))"
_B = "(cos(v * 0.02))"


def _two_logits(patch, window):
    return np.stack([np.sin(patch.astype(np.float64) * 0.01), np.cos(patch.astype(np.float64) * 0.02)])


@query(f"WITH {VOX} SELECT i, CAST(CASE WHEN {_B} > {_A} THEN 1 ELSE 0 END AS BIGINT) AS label, round(1 / (1 + exp(-abs({_A} - {_B}))), 4) AS prob FROM vox")
def model_argmax_merge(spark, d):
    got = segment_argmax(vox(spark, d), grid(spark, d), _two_logits, (16, 16, 16), 0.5)
    return got.select("i", "label", F.round("prob", 4).alias("prob"))


@query(f"WITH {VOX} SELECT i, round(1 / (1 + exp({_A} - {_B})), 6) AS prob FROM vox WHERE 1 / (1 + exp({_A} - {_B})) > 0.5")
def model_mean_probability(spark, d):
    got = segment_mean(vox(spark, d), grid(spark, d), _two_logits, (16, 16, 16), 0.25)
    return got.select("i", F.round("prob", 6).alias("prob"))


@query()
def watershed_basins(spark, d):
    v = vox(spark, d)
    got = watershed(v, M.threshold(v, -500, 1e9), grid(spark, d), 2.0)
    return got.groupBy("label").agg(F.count(F.lit(1)).alias("voxels"), F.min("i").alias("first"))


@query()
def iso_surface(spark, d):
    t = mesh.iso_triangles(M.threshold(vox(spark, d), 3001, 1e9), grid(spark, d))
    return t.select("x", "y", "z", "t", *(F.round(f"{p}{c}", 6).alias(f"{p}{c}") for p in "nabc" for c in "xyz"))
