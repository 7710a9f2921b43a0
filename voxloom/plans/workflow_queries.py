"""Queries over workflows, each with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.operators import masks as M
from voxloom.operators import workflows as K
from voxloom.operators.voxels import Grid
from voxloom.plans.tables import PTS, VOX, grid, points, table, vox
from voxloom.plans.volume_queries import _FACES, _closure

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _clamp_sql(e: str, n: int) -> str:
    return f"CAST(least(greatest(floor({e} + 0.5), 0), {n}) AS BIGINT)"


_SIZE = (60, 50, 40)


@query(
    f"WITH {PTS} SELECT id, "
    + ", ".join(f"{_clamp_sql(f'{c} - 24', n)} AS {c}0, greatest({_clamp_sql(f'{c} - 24', n)} + 1, {_clamp_sql(f'{c} + 24', n)}) AS {c}1" for c, n in zip("xyz", _SIZE, strict=True))
    + " FROM pts"
)
def live_roi(spark, d):
    a, b = K.cube_roi([F.col(c) for c in "xyz"], 48, _SIZE)
    return points(spark, d).select("id", *(v.cast("long").alias(f"{c}0") for c, v in zip("xyz", a, strict=True)), *(v.cast("long").alias(f"{c}1") for c, v in zip("xyz", b, strict=True)))


@query("WITH r AS (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS a, (user_id % 53) / 52.0::DOUBLE AS b FROM events) SELECT event_id, CAST(floor(a * 24 + 0.5) AS BIGINT) AS x, CAST(floor((1 - b) * 23 + 0.5) AS BIGINT) AS z FROM r")
def view_cursor(spark, d):
    a, b = (F.col("event_id") % 101) / 100.0, (F.col("user_id") % 53) / 52.0
    p = K.ratio_to_voxel("coronal", a, b, [F.lit(0), F.lit(1), F.lit(2)], (25, 25, 24))
    return table(spark, d, "events").select("event_id", p[0].cast("long").alias("x"), p[2].cast("long").alias("z"))


@query(
    """WITH s AS (SELECT p_partkey AS stroke, p_partkey % 25 AS ax, p_partkey % 23 AS ay, 1 AS az, CAST(p_size % 25 AS BIGINT) AS bx, (p_partkey + p_size) % 25 AS b_y, 3 AS bz FROM part),
n AS (SELECT *, greatest(abs(bx - ax), abs(b_y - ay), abs(bz - az), 1) AS n FROM s), t AS (SELECT *, unnest(range(0, n + 1)) AS step FROM n)
SELECT stroke, step, CAST(floor(ax + (bx - ax) * (step / n) + 0.5) AS BIGINT) AS x, CAST(floor(ay + (b_y - ay) * (step / n) + 0.5) AS BIGINT) AS y, CAST(floor(az + (bz - az) * (step / n) + 0.5) AS BIGINT) AS z FROM t"""
)
def brush_stroke(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    rows = table(spark, d, "part").select(k.alias("stroke"), (k % 25).alias("ax"), (k % 23).alias("ay"), F.lit(1).alias("az"), (s % 25).alias("bx"), ((k + s) % 25).alias("by"), F.lit(3).alias("bz"))
    return K.stroke_points(rows).select("stroke", "step", *(F.col(c).cast("long").alias(c) for c in "xyz"))


@query(
    f"""WITH RECURSIVE {VOX}, {_closure('v BETWEEN 3001 AND 100000', 6)}, s AS (SELECT i, i AS ord, i % 3 <> 0 AS sets FROM rooted WHERE i % 5 = 0),
l AS (SELECT root, arg_max(sets, ord) AS sets FROM rooted JOIN s USING (i) GROUP BY root)
SELECT i FROM vox LEFT JOIN (SELECT i, sets FROM rooted JOIN l USING (root)) h USING (i) WHERE CASE WHEN h.sets IS NULL THEN v > 2000 ELSE h.sets END"""
)
def seeded_edit(spark, d):
    v, g = vox(spark, d), grid(spark, d)
    seeds = v.where("v >= 3001 and i % 5 = 0").select("i", F.col("i").alias("ord"), (F.col("i") % 3 != 0).alias("sets"))
    return K.seeded_edit(v, M.threshold(v, 2001, 1e9), g, seeds, 3001, 100000).select("i")


@query(f"WITH {VOX}, n AS (SELECT z, x, count(*) AS n FROM vox WHERE v > 1500 GROUP BY z, x) SELECT z, x, round(0.45::DOUBLE + 0.55::DOUBLE * least(1, n / 12.5::DOUBLE), 6) AS intensity FROM n")
def projection_preview(spark, d):
    return K.projection_preview(M.threshold(vox(spark, d), 1501, 1e9), 25).select("z", "x", F.round("intensity", 6).alias("intensity"))


@query(
    """WITH f AS (SELECT p_partkey AS ord, regexp_replace(p_brand, '[^A-Za-z0-9_\\-]+', '_', 'g') AS stem FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY ord) AS n FROM f)
SELECT ord, 'masks/' || CASE WHEN n = 1 THEN stem ELSE stem || '_' || n END || '.bin' AS path FROM n"""
)
def archive_paths(spark, d):
    f = table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("name"))
    return K.archive_paths(f, "masks", "name", "bin", plain=True).select("ord", "path")


@query(
    f"""WITH RECURSIVE {VOX}, {_closure('label <> 0 AND v > 2000', 6, 'AND b.label = a.label')},
c AS (SELECT label, root, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM rooted GROUP BY label, root),
o AS (SELECT label, sum(n) AS voxels, count(*) AS components, max(n) AS largest, max(x1) - min(x0) + 1 AS ex, max(y1) - min(y0) + 1 AS ey, max(z1) - min(z0) + 1 AS ez FROM c GROUP BY label)
SELECT label, CAST(voxels AS BIGINT) AS voxels, components, array_to_string(list_filter([CASE WHEN voxels < 850 THEN 'low-volume' END, CASE WHEN least(ex, ey, ez) < 25 THEN 'flat-or-clipped' END,
 CASE WHEN components > 3 AND largest / greatest(voxels, 1) < 0.985 THEN 'fragmented' END, CASE WHEN greatest(ex, ey, ez) / greatest(least(ex, ey, ez), 1) > 7 THEN 'extreme-aspect' END], lambda r: r IS NOT NULL), ';') AS reasons FROM o"""
)
def shape_audit(spark, d):
    rooted = M.component_roots(vox(spark, d).where("label <> 0 and v > 2000").select("volume_id", "i", "x", "y", "z", "label"), grid(spark, d), 6, by="label")
    return K.shape_audit(rooted, 850, 25, 3).select("label", "voxels", "components", F.array_join("reasons", ";").alias("reasons"))


@query(
    f"""WITH RECURSIVE {PTS}, o AS (SELECT volume_id, id, x, y, row_number() OVER (PARTITION BY volume_id ORDER BY id) AS n FROM pts),
f AS (SELECT DISTINCT volume_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[]) AS kept FROM o
 UNION ALL SELECT f.volume_id, o.n, CASE WHEN len(list_filter(f.kept, lambda k: sqrt((k.x - o.x) ** 2 + (k.y - o.y) ** 2) < 3)) = 0 THEN list_append(f.kept, {{'id': CAST(o.id AS BIGINT), 'x': o.x, 'y': o.y}}) ELSE f.kept END FROM f JOIN o ON o.volume_id = f.volume_id AND o.n = f.n + 1),
l AS (SELECT volume_id, list_transform(arg_max(kept, n), lambda k: k.id) AS ids FROM f GROUP BY volume_id)
SELECT o.volume_id, o.id, list_contains(ids, o.id) AS kept, CAST(coalesce(list_position(ids, o.id), 0) AS BIGINT) AS place FROM o JOIN l USING (volume_id)"""
)
def greedy_separation(spark, d):
    p = points(spark, d)
    return K.greedy_apart(p.select("volume_id", "id", "x", "y"), "volume_id", [("id", "ascending")], 3.0).select("volume_id", "id", "kept", "place")


@query()
def object_library(spark, d):
    v = vox(spark, d)
    got = K.tooth_library(v, M.threshold(v, -500, 1e9), grid(spark, d), 2.0, 5, 20)
    return got.select("label", "voxels", "quality_status", "quality_score")


@query(
    f"""WITH RECURSIVE {VOX}, n AS (SELECT max(z) + 1 AS d, CAST(greatest(1, floor((max(z) + 1) / 2.0 + 0.5)) AS BIGINT) AS h FROM vox),
o AS (SELECT x, y, z, d, h FROM n, range(0, 13) AS a(x), range(0, 13) AS b(y), range(0, 100000) AS c(z) WHERE z < h),
s AS (SELECT (z * 13 + y) * 13 + x AS i, x, y, z, CAST(least(greatest(floor((x + 0.5) * (25.0::DOUBLE / 13) - 0.5 + 0.5), 0), 24) AS BIGINT) AS ix, CAST(least(greatest(floor((y + 0.5) * (25.0::DOUBLE / 13) - 0.5 + 0.5), 0), 24) AS BIGINT) AS iy,
 CAST(least(greatest(floor((z + 0.5) * (d::DOUBLE / h) - 0.5 + 0.5), 0), d - 1) AS BIGINT) AS iz, h FROM o),
small AS MATERIALIZED (SELECT s.i, s.x, s.y, s.z, coalesce(v.v, 0) AS v, 0 AS label, h FROM s LEFT JOIN vox v ON v.x = ix AND v.y = iy AND v.z = iz),
{_FACES.replace('dirs AS', 'six AS')}, all26 AS (SELECT dx, dy, dz FROM range(-1, 2) AS a(dx), range(-1, 2) AS b(dy), range(-1, 2) AS c(dz)),
e AS MATERIALIZED (SELECT a.i AS p, b.i AS q FROM small a, all26, small b WHERE b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND a.v >= -400 AND b.v >= -400),
body AS (SELECT min(i) AS i FROM small WHERE v >= -400 UNION SELECT q FROM body JOIN e ON body.i = p),
bg AS MATERIALIZED (SELECT * FROM small WHERE i NOT IN (SELECT i FROM body)),
eb AS MATERIALIZED (SELECT a.i AS p, b.i AS q FROM bg a, six, bg b WHERE b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz),
outer_air AS (SELECT i FROM bg WHERE x = 0 OR y = 0 OR z = 0 OR x = 12 OR y = 12 OR z = h - 1 UNION SELECT q FROM outer_air JOIN eb ON outer_air.i = p)
SELECT i FROM small WHERE i NOT IN (SELECT i FROM outer_air)"""
)
def skin_mask(spark, d):
    g = grid(spark, d)
    return K.skin_mask(vox(spark, d), g, Grid(13, 13, max(1, int(g.depth / 2 + 0.5)))).select("i")


@query("""WITH c AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'attachment; filename="scan ' || page_id || '.zip"' WHEN page_id % 3 = 1 THEN 'attachment; filename*=UTF-8''''a%20b' || page_id || '.nii' END AS h, url FROM pages)
SELECT page_id, coalesce(CASE page_id % 3 WHEN 0 THEN 'scan ' || page_id || '.zip' WHEN 1 THEN 'a b' || page_id || '.nii' END, nullif(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/]*', ''), '([^/]*)/*$', 1), ''), 'remote-' || page_id) AS name FROM c""")
def remote_name(spark, d):
    k = F.col("page_id")
    h = F.when(k % 3 == 0, F.concat(F.lit('attachment; filename="scan '), k, F.lit('.zip"'))).when(k % 3 == 1, F.concat(F.lit("attachment; filename*=UTF-8''a%20b"), k, F.lit(".nii")))
    return table(spark, d, "pages").select("page_id", F.coalesce(X.disposition_filename(h), X.url_filename(F.col("url")), F.concat(F.lit("remote-"), k)).alias("name"))
