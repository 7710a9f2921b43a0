"""Queries over regions of interest, peaks and claims, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import geometry
from voxloom.operators import masks as M
from voxloom.operators import objects as O
from voxloom.operators import pipelines as P
from voxloom.operators import regions as R
from voxloom.plans.tables import VOX, grid, table, vox
from voxloom.plans.volume_queries import _closure

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Suppliers as boxes of voxels over a threshold, in order of their keys. 2**20 voxels are enough for the tables given.
_LEAST, _MOST, _SHARE = 12, 400, 0.45
_CLAIMS = f"""{VOX}, n AS (SELECT max(z) + 1 AS d FROM vox),
s AS (SELECT s_suppkey AS ord, s_suppkey % 25 AS cx, (s_suppkey * 3) % 25 AS cy, (s_suppkey * 7) % d AS cz, s_suppkey % 4 + 1 AS r FROM supplier, n),
claims AS (SELECT ord, i FROM s JOIN vox ON abs(x - cx) <= r AND abs(y - cy) <= r AND abs(z - cz) <= r AND v > 0),
m AS (SELECT ord, row_number() OVER (ORDER BY ord) AS n, count(*) AS positive, bitstring_agg(CAST(i AS INTEGER), 0, 1048575) AS bits FROM claims GROUP BY ord),
f AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS ord, CAST(0 AS BIGINT) AS positive, CAST(0 AS BIGINT) AS assigned, false AS accepted, CAST(repeat('0', 1048576) AS BIT) AS got, CAST(repeat('0', 1048576) AS BIT) AS owned
 UNION ALL SELECT n, ord, positive, assigned, accepted, got, CASE WHEN accepted THEN owned | got ELSE owned END FROM (
  SELECT *, positive BETWEEN {_LEAST} AND {_MOST} AND assigned >= {_LEAST} AND assigned / positive >= {_SHARE} AS accepted FROM (
   SELECT m.n, CAST(m.ord AS BIGINT) AS ord, CAST(m.positive AS BIGINT) AS positive, CAST(bit_count(m.bits & ~f.owned) AS BIGINT) AS assigned, m.bits & ~f.owned AS got, f.owned FROM f JOIN m ON m.n = f.n + 1))),
inst AS (SELECT ord, positive, assigned, accepted, CASE WHEN accepted THEN row_number() OVER (PARTITION BY accepted ORDER BY ord) ELSE 0 END AS label, got FROM f WHERE n > 0)"""


def _claims(spark, d):
    g, k = grid(spark, d), F.col("s_suppkey")
    v = vox(spark, d).where("v > 0")
    s = table(spark, d, "supplier").select(k.cast("long").alias("ord"), (k % 25).alias("cx"), (k * 3 % 25).alias("cy"), (k * 7 % g.depth).alias("cz"), (k % 4 + 1).alias("r"))
    s = s.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ord")  # boxes are made by many tasks
    around = lambda c: F.explode(F.sequence(F.col(f"c{c}") - F.col("r"), F.col(f"c{c}") + F.col("r")))
    box = s.withColumn("x", around("x")).withColumn("y", around("y")).withColumn("z", around("z"))
    # boxes are estimated at the size of their suppliers, but have hundreds of rows each: never broadcast
    claims = box.hint("merge").join(v, ["x", "y", "z"]).select("volume_id", "ord", "i")
    return R.assigned_instances(claims, _LEAST, _MOST, _SHARE)


@query(f"WITH RECURSIVE {_CLAIMS} SELECT ord, positive, assigned, accepted, label FROM inst")
def instance_assignment(spark, d):
    return _claims(spark, d)[0].select("ord", "positive", "assigned", "accepted", "label")


@query(f"WITH RECURSIVE {_CLAIMS} SELECT c.i, inst.label FROM inst JOIN claims c USING (ord) WHERE accepted AND get_bit(got, CAST(c.i AS INTEGER)) = 1")
def instance_labels(spark, d):
    return _claims(spark, d)[1].select("i", "label")


_AUTO = R.AUTO | {"region": (1, 0.96, 0, 1.0), "thresholds": (500, 900, 1300, 1800, 2200, 2500, 2800, 3100, 3400), "voxels": (2, 400), "sides": (1, 24), "centroid": (0, 24, 0, 24), "window": 2, "edges": ((20, 5), (60, 7), (None, 9)), "depth": 8, "apart": 6.0, "most": 9}
_REGIONS = f"""{VOX}, n AS (SELECT max(z) + 1 AS d FROM vox),
slab AS (SELECT x, y, z, v FROM vox, n WHERE z >= CAST(floor(d * 0.14) AS BIGINT) AND z < CAST(floor(d * 0.64) AS BIGINT)),
mip AS (SELECT x, y, max(v) AS v FROM slab WHERE y > 1 AND y < 24 AND x > 0 AND x < 25 GROUP BY x, y),
t(k, lo) AS (VALUES {", ".join(f"({k}, {v})" for k, v in enumerate(_AUTO["thresholds"], 1))}),
raw AS (SELECT k, x, y, v FROM mip JOIN t ON v > lo),
cross4(dx, dy) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)),
thin AS (SELECT a.k, a.x, a.y FROM raw a, cross4 JOIN raw b ON b.k = a.k AND b.x = a.x + dx AND b.y = a.y + dy GROUP BY a.k, a.x, a.y HAVING count(*) = 4),
opened AS MATERIALIZED (SELECT DISTINCT k, x, y FROM (SELECT k, x, y FROM thin UNION ALL SELECT k, x + dx, y + dy FROM thin, cross4)),
px AS MATERIALIZED (SELECT o.k, o.x, o.y, o.y * 25 + o.x AS i, m.v FROM opened o JOIN mip m USING (x, y)),
near AS MATERIALIZED (SELECT a.k, a.i AS p, b.i AS q FROM px a JOIN px b ON a.k = b.k AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
reach AS (SELECT k, i, i AS r FROM px UNION SELECT reach.k, q, r FROM reach JOIN near ON near.k = reach.k AND near.p = reach.i WHERE r <= q),
rooted AS (SELECT k, i, min(r) AS root FROM reach GROUP BY k, i),
s AS (SELECT k AS level, root, count(*) AS voxels, max(v) AS top, sum(v * y) / sum(v) AS fy, sum(v * x) / sum(v) AS fx, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w FROM rooted JOIN px USING (k, i) GROUP BY k, root),
found AS (SELECT level, root, top * sqrt(voxels::DOUBLE) * greatest(voxels / (h * w), 0.15) AS score, CAST(round_even(fy, 0) AS BIGINT) AS cy, CAST(round_even(fx, 0) AS BIGINT) AS cx, voxels FROM s
 WHERE voxels BETWEEN 2 AND 400 AND h BETWEEN 1 AND 24 AND w BETWEEN 1 AND 24 AND fy BETWEEN 0 AND 24 AND fx BETWEEN 0 AND 24),
best AS (SELECT *, row_number() OVER (ORDER BY score DESC, cy DESC, cx DESC, voxels DESC, level, root) AS rank FROM found),
top18 AS (SELECT * FROM best WHERE rank <= 18)"""


@query(f"WITH RECURSIVE {_REGIONS} SELECT CAST(level AS BIGINT) AS level, root, round(score, 6) AS score, cy, cx, voxels, rank FROM top18")
def projected_regions(spark, d):
    got = R.projected_regions(vox(spark, d), grid(spark, d), _AUTO)
    return got.select(F.col("level").cast("long"), "root", F.round("score", 6).alias("score"), "cy", "cx", "voxels", F.col("rank").cast("long"))


@query(
    f"""WITH RECURSIVE {_REGIONS},
profile AS (SELECT rank, z, max(v) AS v FROM top18 JOIN slab ON abs(x - cx) <= 2 AND abs(y - cy) <= 2 GROUP BY rank, z),
deep AS (SELECT rank, arg_max(z, (v, -z)) AS cz FROM profile GROUP BY rank),
sized AS (SELECT rank, cz, cy, cx, d, CASE WHEN voxels < 20 THEN 5 WHEN voxels < 60 THEN 7 ELSE 9 END AS side FROM top18 JOIN deep USING (rank), n),
ends AS (SELECT rank, side, least(d, greatest(0, cz - 4) + 8) AS z1, least(25, greatest(0, cy - side // 2) + side) AS y1, least(25, greatest(0, cx - side // 2) + side) AS x1 FROM sized),
boxes AS (SELECT rank, greatest(0, z1 - 8) AS z0, greatest(0, y1 - side) AS y0, greatest(0, x1 - side) AS x0, z1, y1, x1, row_number() OVER (ORDER BY rank) AS nth FROM ends),
f AS (SELECT CAST(0 AS BIGINT) AS nth, CAST([] AS STRUCT(rank BIGINT, y DOUBLE, x DOUBLE)[]) AS kept
 UNION ALL SELECT b.nth, CASE WHEN len(list_filter(f.kept, lambda k: sqrt((k.y - (b.y0 + b.y1) / 2) ** 2 + (k.x - (b.x0 + b.x1) / 2) ** 2) < 6)) = 0 THEN list_append(f.kept, {{'rank': b.rank, 'y': (b.y0 + b.y1) / 2, 'x': (b.x0 + b.x1) / 2}}) ELSE f.kept END FROM f JOIN boxes b ON b.nth = f.nth + 1)
SELECT 'auto-tooth-' || lpad(CAST(rank AS VARCHAR), 2, '0') AS name, z0, y0, x0, z1, y1, x1 FROM boxes WHERE list_contains(list_transform((SELECT arg_max(kept, nth) FROM f)[:9], lambda k: k.rank), rank)"""
)
def auto_rois(spark, d):
    return R.auto_rois(vox(spark, d), grid(spark, d), _AUTO).select("name", "z0", "y0", "x0", "z1", "y1", "x1")


@query(
    f"""WITH RECURSIVE {VOX},
line AS (SELECT i, x, y, z, v, max(v) OVER (PARTITION BY y, z ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM vox),
plane AS (SELECT *, max(a) OVER (PARTITION BY x, z ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS b FROM line),
cube AS (SELECT *, max(b) OVER (PARTITION BY x, y ORDER BY z RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS c FROM plane),
o AS MATERIALIZED (SELECT i, x, y, z, v, row_number() OVER (ORDER BY v DESC, i) AS n FROM cube WHERE v = c AND v > 200),
f AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(i BIGINT, x BIGINT, y BIGINT, z BIGINT)[]) AS kept
 UNION ALL SELECT o.n, CASE WHEN len(list_filter(f.kept, lambda k: greatest(abs(k.x - o.x), abs(k.y - o.y), abs(k.z - o.z)) < 2)) = 0 THEN list_append(f.kept, {{'i': o.i, 'x': o.x, 'y': o.y, 'z': o.z}}) ELSE f.kept END FROM f JOIN o ON o.n = f.n + 1)
SELECT o.i, o.v, CAST(list_position(ids, o.i) AS BIGINT) AS place FROM o, (SELECT list_transform(arg_max(kept, n), lambda k: k.i) AS ids FROM f) WHERE list_contains(ids, o.i)"""
)
def spaced_peaks(spark, d):
    return R.spaced_peaks(vox(spark, d).select("volume_id", "i", "x", "y", "z", "v"), "v", 2, 200).select("i", "v", "place")


_HYBRID = R.HYBRID | {"voxels": (100, 2600), "shortest": 3, "widest": 25}


@query(
    f"""WITH {VOX}, n AS (SELECT max(z) + 1 AS d FROM vox),
s AS (SELECT label, count(*) AS voxels, max(v) AS deep, avg(z) AS fz, avg(y) AS fy, avg(x) AS fx, max(z) - min(z) + 1 AS ez, max(y) - min(y) + 1 AS ey, max(x) - min(x) + 1 AS ex FROM vox WHERE label <> 0 GROUP BY label),
c AS (SELECT label, voxels * deep AS score, CAST(round_even(fz, 0) AS BIGINT) AS cz, CAST(round_even(fy, 0) AS BIGINT) AS cy, CAST(round_even(fx, 0) AS BIGINT) AS cx,
 least(greatest(ez + 44, 104), 144) AS depth, least(greatest(greatest(ey, ex) + 30, 68), 104) AS side FROM s, n
 WHERE voxels BETWEEN 100 AND 2600 AND least(ez, ey, ex) >= 3 AND ey <= 25 AND ex <= 25 AND fz BETWEEN floor(d * 0.10) AND floor(d * 0.76) AND fy BETWEEN 1 AND 20 AND fx BETWEEN 2 AND 23)
SELECT label, score, cz, cy, cx, depth, side, row_number() OVER (ORDER BY score DESC, cz DESC, cy DESC, cx DESC, depth DESC, side DESC, label) AS rank FROM c"""
)
def basin_candidates(spark, d):
    got = R.basin_candidates(vox(spark, d).withColumn("dist", F.col("v")), grid(spark, d), _HYBRID)
    return got.select("label", "score", "cz", "cy", "cx", "depth", "side", F.col("rank").cast("long"))


_ARCH = ", ".join(f"('{n}', {x - s // 2}, {y - s // 2}, {s})" for n, x, y, s in R.ARCH)


@query(
    f"""WITH v AS (SELECT c_custkey AS id, 300 + c_custkey % 300 AS width, 250 + c_custkey % 250 AS height, 100 + c_custkey % 200 AS depth FROM customer), a(name, x, y, s) AS (VALUES {_ARCH})
SELECT id, name, 88::BIGINT AS z0, greatest(0, y) AS y0, greatest(0, x) AS x0, least(depth, 224) AS z1, least(height, y + s) AS y1, least(width, x + s) AS x1 FROM v, a"""
)
def arch_rois(spark, d):
    k = F.col("c_custkey")
    v = table(spark, d, "customer").select(k.alias("id"), (k % 300 + 300).alias("width"), (k % 250 + 250).alias("height"), (k % 200 + 100).alias("depth"))
    return R.arch_rois(v).drop("width", "height", "depth")


@query(
    f"""WITH {VOX}, l AS (SELECT x, y, z, label FROM vox WHERE label <> 0 AND v > 1500),
p AS (SELECT 'x' AS axis, x, y, z FROM l UNION SELECT 'x', x - 1, y, z FROM l UNION SELECT 'y', x, y, z FROM l UNION SELECT 'y', x, y - 1, z FROM l UNION SELECT 'z', x, y, z FROM l UNION SELECT 'z', x, y, z - 1 FROM l)
SELECT p.axis, p.x, p.y, p.z, coalesce(a.label, 0) AS low, coalesce(b.label, 0) AS high FROM p LEFT JOIN l a ON a.x = p.x AND a.y = p.y AND a.z = p.z
LEFT JOIN l b ON b.x = p.x + CAST(p.axis = 'x' AS BIGINT) AND b.y = p.y + CAST(p.axis = 'y' AS BIGINT) AND b.z = p.z + CAST(p.axis = 'z' AS BIGINT) WHERE coalesce(a.label, 0) <> coalesce(b.label, 0)"""
)
def label_faces(spark, d):
    from voxloom.operators import mesh

    return mesh.label_faces(vox(spark, d).where("label <> 0 and v > 1500"), grid(spark, d)).select("axis", "x", "y", "z", "low", "high")


@query(
    f"""WITH RECURSIVE {VOX}, {_closure('label <> 0 AND v > 2000', 6, 'AND b.label = a.label')},
n AS (SELECT label, root, count(*) AS n FROM rooted GROUP BY label, root), k AS (SELECT *, count(*) OVER (PARTITION BY label) AS c, row_number() OVER (PARTITION BY label ORDER BY n DESC, root) AS nth FROM n)
SELECT label, root, CASE WHEN c = 1 OR label IN (2, 4) THEN 0 ELSE nth END AS part, n AS voxels FROM k WHERE c = 1 OR label IN (2, 4) OR nth <= 24"""
)
def split_unlocked(spark, d):
    rooted = M.component_roots(vox(spark, d).where("label <> 0 and v > 2000").select("volume_id", "i", "x", "y", "z", "label"), grid(spark, d), 6, by="label")
    return M.split_labels(rooted, (2, 4)).groupBy("label", "root", "part").agg(F.count(F.lit(1)).alias("voxels"))


@query(
    f"""WITH {VOX}, r AS (SELECT s_suppkey AS id, s_suppkey % 24 AS z, (s_suppkey * 3 % 20) * 1.0::DOUBLE AS x0, (s_suppkey * 5 % 18) * 1.0::DOUBLE AS y0, (s_suppkey % 9) * 1.5::DOUBLE AS w, (s_suppkey % 7) * 1.25::DOUBLE AS h FROM supplier)
SELECT id, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, round(avg(v::DOUBLE), 6) AS mean, count(*) AS voxels FROM r JOIN vox ON vox.z = r.z
WHERE w > 0 AND h > 0 AND ((x - (x0 + w / 2)) / (w / 2)) ** 2 + ((y - (y0 + h / 2)) / (h / 2)) ** 2 <= 1 GROUP BY id"""
)
def ellipse_density(spark, d):
    k = F.col("s_suppkey")
    r = table(spark, d, "supplier").select(k.alias("id"), (k % 24).alias("z"), (k * 3 % 20).cast("double").alias("x0"), (k * 5 % 18).cast("double").alias("y0"), ((k % 9) * 1.5).alias("w"), ((k % 7) * 1.25).alias("h"))
    corners = ((F.col("x0"), F.col("y0")), (F.col("x0") + F.col("w"), F.col("y0") + F.col("h")))
    inside = vox(spark, d).join(r, "z").where(geometry.in_ellipse(F.col("x"), F.col("y"), *corners))
    return geometry.density_stats(inside, "v", "id").select("id", F.col("min").alias("lo"), F.col("max").alias("hi"), F.round("mean", 6).alias("mean"), F.col("count").alias("voxels"))


@query(
    """WITH s AS (SELECT o_custkey AS series, CASE WHEN o_custkey % 3 = 0 THEN 1.0::DOUBLE ELSE (o_orderkey % 97) * 0.5::DOUBLE END AS loc, o_orderkey, (o_custkey % 2) * 1.25::DOUBLE AS between_, (o_custkey % 5) * 0.75::DOUBLE AS thick FROM orders),
d AS (SELECT *, abs(loc - lag(loc) OVER (PARTITION BY series ORDER BY loc)) AS d FROM s), g AS (SELECT series, list_sort(list(d) FILTER (d > 1e-6)) AS d, max(between_) AS b, max(thick) AS t FROM d GROUP BY series)
SELECT series, round(coalesce(d[len(d) // 2 + 1], nullif(b, 0), nullif(t, 0), 0), 6) AS spacing FROM g"""
)
def spacing_fallback(spark, d):
    k = F.col("o_custkey")
    s = table(spark, d, "orders").select(k.alias("series"), F.when(k % 3 == 0, 1.0).otherwise((F.col("o_orderkey") % 97) * 0.5).alias("loc"), ((k % 2) * 1.25).alias("between"), ((k % 5) * 0.75).alias("thick"))
    return O.median_spacing(s, "series", "loc", ["between", "thick"]).select("series", F.round("spacing", 6).alias("spacing"))


@query(
    """WITH s AS (SELECT c_nationkey * 40 + c_custkey % 40 AS folder, 256 + (c_custkey % 11 // 10) AS nrows, 16 AS bits, c_custkey % 3 > 0 AS ok FROM customer)
SELECT folder, count(*) AS files, count(*) FILTER (ok) AS slices, CASE WHEN count(*) < 2 THEN 'E_DICOM_COUNT' WHEN count(*) FILTER (ok) < 2 THEN 'E_DICOM_UNSUPPORTED'
 WHEN min(nrows) FILTER (ok) <> max(nrows) FILTER (ok) THEN 'E_DICOM_MISMATCH' END AS error FROM s GROUP BY folder"""
)
def stack_errors(spark, d):
    k = F.col("c_custkey")
    s = table(spark, d, "customer").select((F.col("c_nationkey") * 40 + k % 40).alias("folder"), (F.floor(k % 11 / 10) + 256).alias("rows"), F.lit(16).alias("bits"), (k % 3 > 0).alias("ok"))
    return O.stack_errors(s, "folder", F.col("ok"), ("rows", "bits"))


@query(
    f"""WITH {VOX}, c(value, name, color) AS (VALUES {", ".join(f"({v}, '{n}', '{c}')" for v, _, n, c in P.ANATOMY_LABELS)}), n AS (SELECT label AS value, count(*) AS n FROM vox WHERE label <> 3 GROUP BY label)
SELECT 'Full anatomy' AS name, CAST(min(value) AS BIGINT) AS active_value, string_agg(value || ' ' || name || ' ' || color || ' ' || coalesce(n, 0), ', ' ORDER BY value) AS segments, round(sum(coalesce(n, 0)) * 0.75::DOUBLE, 6) AS volume_mm3 FROM c LEFT JOIN n USING (value)"""
)
def segment_groups(spark, d):
    got = P.segment_groups(vox(spark, d).where("label <> 3"), grid(spark, d, 0.5, 1.0, 1.5))
    text = F.array_join(F.transform("segments", lambda s: F.concat_ws(" ", s["value"].cast("string"), s["name"], s["color"], s["voxels"].cast("string"))), ", ")
    return got.select("name", "active_value", text.alias("segments"), F.round(F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["volume_mm3"]), 6).alias("volume_mm3"))


@query(
    f"""WITH RECURSIVE {VOX}, {_closure('v > 3000', 6)}, n AS (SELECT root, count(*) AS n FROM rooted GROUP BY root)
SELECT count(*) FILTER (n >= 2) AS candidates, count(*) FILTER (n >= 4) AS kept FROM n"""
)
def candidate_counts(spark, d):
    s = M.component_stats(M.component_roots(M.threshold(vox(spark, d), 3001, 1e9), grid(spark, d), 6))
    return s.agg(F.count_if(F.col("voxels") >= 2).alias("candidates"), F.count_if(F.col("voxels") >= 4).alias("kept"))
