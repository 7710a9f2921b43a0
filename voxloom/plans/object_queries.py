"""Queries over objects, points, curves, catalogues, logs and names, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.functions import text as X
from voxloom.functions.jsnum import reflect_index as mirrored
from voxloom.operators import curves as C
from voxloom.operators import objects as O
from voxloom.operators.inference import window_starts as starts_of
from voxloom.operators.voxels import Grid
from voxloom.plans.tables import OBJECTS, PRESETS, PTS, STUDIES, VOX, grid, objects, points, presets, studies, table, vox

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_REASONS = """list_filter([CASE WHEN voxels < 10000 THEN 'low-volume' END, CASE WHEN voxels > 140000 THEN 'high-volume' END, CASE WHEN least(ez, ey, ex) < 18 THEN 'flat-or-clipped' END,
 CASE WHEN ez > 115 OR ey > 95 OR ex > 100 THEN 'oversized' END, CASE WHEN cz < 55 OR cz > 260 THEN 'off-arch-z' END, CASE WHEN cy < 55 OR cy > 380 THEN 'off-arch-y' END, CASE WHEN cx < 95 OR cx > 520 THEN 'off-arch-x' END], lambda r: r IS NOT NULL)"""


@query(
    f"""WITH {OBJECTS}, r AS (SELECT *, {_REASONS} AS reasons FROM objects)
SELECT id, array_to_string(reasons, ';') AS reasons, CASE WHEN len(reasons) = 0 THEN 'accepted' ELSE 'review' END AS status,
 floor(greatest(0::DOUBLE, least(1::DOUBLE, 1.0::DOUBLE - 0.18::DOUBLE * len(reasons) + CASE WHEN voxels BETWEEN 18000 AND 120000 THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN ez BETWEEN 22 AND 105 AND ey BETWEEN 22 AND 90 AND ex BETWEEN 22 AND 95 THEN 0.12::DOUBLE ELSE 0 END)) * 1000 + 0.5) / 1000 AS score FROM r"""
)
def quality_rules(spark, d):
    q = O.quality(objects(spark, d))
    return q.select("id", F.array_join("quality_reasons", ";").alias("reasons"), F.col("quality_status").alias("status"), F.col("quality_score").alias("score"))


@query(
    f"""WITH {OBJECTS}, r AS (SELECT id, CASE WHEN len({_REASONS}) = 0 THEN 'accepted' ELSE 'review' END AS computed FROM objects),
s AS (SELECT coalesce(CASE s_suppkey % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted' WHEN 2 THEN 'review' END, computed) AS status FROM r LEFT JOIN supplier ON id = s_suppkey * 7)
SELECT count(*) AS total, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status <> 'rejected') AS visible FROM s"""
)
def review_counts(spark, d):
    k = F.col("s_suppkey") % 4
    over = table(spark, d, "supplier").select((F.col("s_suppkey") * 7).alias("id"), F.when(k == 0, "rejected").when(k == 1, "accepted").when(k == 2, "review").alias("override"))
    return O.review_counts(O.quality(objects(spark, d)), over)


_FDI = """p AS (SELECT *, x - avg(x) OVER w AS px, -(y - avg(y) OVER w) AS py FROM j WINDOW w AS (PARTITION BY volume_id, jaw)),
s AS (SELECT *, CASE WHEN px >= 0 THEN 'left' ELSE 'right' END AS side FROM p),
n AS (SELECT volume_id, id, CASE WHEN jaw = 'upper' THEN CASE side WHEN 'left' THEN 2 ELSE 1 END ELSE CASE side WHEN 'left' THEN 3 ELSE 4 END END AS q,
 least(row_number() OVER (PARTITION BY volume_id, jaw, side ORDER BY atan2(abs(px), py), id), 8) AS pos FROM s)
SELECT volume_id, id, CAST(q AS BIGINT) AS quadrant, CAST(q * 10 + pos AS BIGINT) AS fdi FROM n"""


@query(f"WITH {PTS}, j AS (SELECT *, 'upper' AS jaw FROM pts), {_FDI}")
def fdi_number(spark, d):
    return O.number_arch(points(spark, d), F.lit("upper")).select("volume_id", "id", F.col("quadrant").cast("long"), F.col("fdi").cast("long"))


@query(f"WITH {PTS}, m AS (SELECT volume_id, list_sort(list(z))[len(list(z)) // 2 + 1] AS mid FROM pts GROUP BY volume_id), j AS (SELECT pts.*, CASE WHEN z >= mid THEN 'upper' ELSE 'lower' END AS jaw FROM pts JOIN m USING (volume_id)), {_FDI}")
def fdi_both_jaws(spark, d):
    j = O.split_jaws(points(spark, d))
    return O.number_arch(j.drop("jaw").join(j.select("id", "jaw"), "id"), F.col("jaw")).select("volume_id", "id", F.col("quadrant").cast("long"), F.col("fdi").cast("long"))


@query(f"WITH {STUDIES} SELECT id, name, source, updated_at FROM studies WHERE coalesce(deleted_at, 0) = 0")
def studies_list(spark, d):
    return O.latest_first(studies(spark, d)).select("id", "name", "source", "updated_at")


@query(f"WITH {PRESETS} SELECT study_id, id, row_number() OVER (PARTITION BY study_id ORDER BY updated_at DESC, id) AS place FROM presets WHERE coalesce(deleted_at, 0) = 0")
def presets_by_study(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("study_id").orderBy(F.desc("updated_at"), "id")
    return O.live(presets(spark, d)).select("study_id", "id", F.row_number().over(w).cast("long").alias("place"))


@query(
    f"""WITH {STUDIES}, p AS (SELECT s_suppkey * 3 AS id, s_name AS name FROM supplier)
SELECT s.id, CASE WHEN p.id IS NOT NULL AND coalesce(deleted_at, 0) = 0 THEN p.name ELSE s.name END AS name, CASE WHEN p.id IS NOT NULL AND coalesce(deleted_at, 0) = 0 THEN 99999 ELSE updated_at END AS updated_at FROM studies s LEFT JOIN p ON s.id = p.id"""
)
def study_update(spark, d):
    patch = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("id"), F.col("s_name").alias("name"))
    return O.patched(studies(spark, d), patch, F.lit(99999).cast("long")).select("id", "name", "updated_at")


@query(f"WITH {STUDIES} SELECT s.id, CASE WHEN g.id IS NOT NULL AND coalesce(deleted_at, 0) = 0 THEN 777 ELSE deleted_at END AS deleted_at FROM studies s LEFT JOIN (SELECT s_suppkey * 2 AS id FROM supplier) g ON s.id = g.id")
def study_soft_delete(spark, d):
    gone = table(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("id"))
    return O.softly_deleted(studies(spark, d), gone, F.lit(777).cast("long")).select("id", "deleted_at")


@query("SELECT user_id, event_id, depth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS depth FROM events) WHERE depth <= 24")
def undo_cap24(spark, d):
    return O.undo_stack(table(spark, d, "events")).select("user_id", "event_id", F.col("depth").cast("long").alias("depth"))


@query("WITH s AS (SELECT DISTINCT l_suppkey AS series, l_partkey AS position FROM lineitem) SELECT series, position FROM (SELECT *, lag(position) OVER (PARTITION BY series ORDER BY position) AS b FROM s) WHERE b IS NOT NULL AND position <> b + 1")
def slice_gap(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("series"), F.col("l_partkey").alias("position"))
    return O.slice_gaps(s, "series", "position").select("series", "position")


@query(
    """WITH s AS (SELECT DISTINCT l_suppkey AS series, l_partkey * 0.5::DOUBLE AS loc FROM lineitem), d AS (SELECT series, abs(loc - lag(loc) OVER (PARTITION BY series ORDER BY loc)) AS step FROM s),
m AS (SELECT series, list_sort(list(step) FILTER (step > 1e-6)) AS l FROM d GROUP BY series) SELECT series, l[len(l) // 2 + 1] AS spacing FROM m"""
)
def upper_median_spacing(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("series"), (F.col("l_partkey") * F.lit(0.5)).alias("loc")).distinct()
    return O.median_spacing(s, "series", "loc")


@query(
    """WITH s AS (SELECT l_suppkey AS series, l_suppkey % 10 = 0 AS localizer, count(DISTINCT l_partkey) AS slices, count(*) - count(DISTINCT l_partkey) AS duplicates FROM lineitem GROUP BY ALL)
SELECT series, slices, duplicates, row_number() OVER (ORDER BY localizer, slices DESC, duplicates, series) AS rank FROM s"""
)
def series_pick(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("series"), F.col("l_partkey").alias("position"))
    return O.pick_series(s, "series", "position", F.col("series") % 10 == 0).select("series", "slices", "duplicates", "rank")


_PAIR = f"{PTS}, q AS (SELECT a.volume_id, a.id, a.x, a.y, a.z, b.x AS u, b.y AS v, b.z AS w FROM pts a JOIN pts b ON b.id = a.id + 250)"


def _pairs(spark, d):
    p = points(spark, d)
    return p.join(p.select((F.col("id") - 250).alias("id"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("z").alias("w")), "id")


@query(f"WITH {_PAIR} SELECT volume_id, count(*) AS n, " + ", ".join(f"round(avg({c}), 4) AS m{c}" for c in "xyzuvw") + ", " + ", ".join(f"round(sum({a} * {b}) - sum({a}) * sum({b}) / count(*), 2) AS s{a}{b}" for a in "xyz" for b in "uvw") + " FROM q GROUP BY volume_id")
def horn_sums(spark, d):
    s = G.horn_sums(_pairs(spark, d), "volume_id")
    return s.select("volume_id", "n", *(F.round(f"m{c}", 4).alias(f"m{c}") for c in "xyzuvw"), *(F.round(f"s{a}{b}", 2).alias(f"s{a}{b}") for a in "xyz" for b in "uvw"))


@query(f"WITH {PTS} SELECT volume_id, " + ", ".join(f"round(covar_pop({a}, {b}), 4) AS c{a}{b}" for k, a in enumerate("xyz") for b in "xyz"[k:]) + " FROM pts GROUP BY volume_id")
def pca_covariance(spark, d):
    c = G.covariances(points(spark, d), "volume_id")
    return c.select("volume_id", *(F.round(f"c{a}{b}", 4).alias(f"c{a}{b}") for k, a in enumerate("xyz") for b in "xyz"[k:]))


@query(f"WITH {_PAIR} SELECT volume_id, round(avg(sqrt((x - u) ** 2 + (y - v) ** 2 + (z - w) ** 2)), 6) AS mean_distance FROM q GROUP BY volume_id")
def mean_point_distance(spark, d):
    g = G.distance(F.array("x", "y", "z"), F.array("u", "v", "w"))
    return _pairs(spark, d).groupBy("volume_id").agg(F.round(F.avg(g), 6).alias("mean_distance"))


_M = [0.0, -1.0, 0.0, 5.0, 1.0, 0.0, 0.0, -3.0, 0.0, 0.0, 1.0, 2.0, 0.0, 0.0, 0.0, 1.0]


@query(f"WITH {PTS} SELECT id, round(-y + 5, 6) AS x, round(x - 3, 6) AS y, round(z + 2, 6) AS z FROM pts")
def mat4_apply(spark, d):
    q = points(spark, d).select("id", G.apply_matrix(F.array(*(F.lit(v) for v in _M)), F.array("x", "y", "z")).alias("q"))
    return q.select("id", *(F.round(F.col("q")[k], 6).alias(c) for k, c in enumerate("xyz")))


@query(f"WITH {PTS} SELECT id, -x AS x, -y AS y, z FROM pts")
def frame_flip(spark, d):
    q = points(spark, d).select("id", G.flip_point(F.array("x", "y", "z")).alias("q"))
    return q.select("id", *(F.col("q")[k].alias(c) for k, c in enumerate("xyz")))


@query(f"WITH {_PAIR} SELECT id, round(sqrt(((u - x) * 0.4) ** 2 + ((v - y) * 0.5) ** 2 + ((w - z) * 0.7) ** 2), 6) AS mm, round(degrees(acos(greatest(-1, least(1, (x * u + y * v + z * w) / (sqrt(x * x + y * y + z * z) * sqrt(u * u + v * v + w * w)))))), 4) AS angle FROM q")
def distance_angle(spark, d):
    a, b, o = F.array("x", "y", "z"), F.array("u", "v", "w"), F.array(*(F.lit(0.0),) * 3)
    return _pairs(spark, d).select("id", F.round(G.distance(a, b, (0.4, 0.5, 0.7)), 6).alias("mm"), F.round(G.angle_degrees(a, o, b), 4).alias("angle"))


@query(f"WITH {OBJECTS} SELECT id, round(pi() * ex * ey, 4) AS area, round(pi() * (ex + ey) * (1 + 3 * h / (10 + sqrt(4 - 3 * h))), 4) AS perimeter FROM (SELECT *, (ex - ey) * (ex - ey) / CAST((ex + ey) * (ex + ey) AS DOUBLE) AS h FROM objects)")
def ellipse(spark, d):
    a, b = F.col("ex").cast("double"), F.col("ey").cast("double")
    return objects(spark, d).select("id", F.round(G.ellipse_area(a, b), 4).alias("area"), F.round(G.ellipse_perimeter(a, b), 4).alias("perimeter"))


@query(
    f"""WITH {PTS}, e AS (SELECT volume_id, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS nx, coalesce(lead(y) OVER w, first(y) OVER w) AS ny FROM pts WINDOW w AS (PARTITION BY volume_id ORDER BY id))
SELECT volume_id AS poly, round(abs(sum(x * ny - nx * y)) / 2, 3) AS area, round(sum(sqrt((nx - x) ** 2 + (ny - y) ** 2)), 3) AS perimeter FROM e GROUP BY volume_id"""
)
def polygon_area(spark, d):
    p = G.polygons(points(spark, d).select(F.col("volume_id").alias("poly"), F.col("id").alias("ord"), "x", "y"))
    return p.select("poly", F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"))


_POLY = [(2.5, 3.5), (20.5, 5.5), (17.5, 21.5), (11.5, 9.5), (4.5, 18.5)]


def _inside_sql() -> str:
    parts = [f"(CASE WHEN ({ay} > y) <> ({by} > y) AND x < ({bx} - {ax})::DOUBLE * (y - {ay}) / ({by} - {ay}) + {ax} THEN 1 ELSE 0 END)" for (ax, ay), (bx, by) in zip(_POLY, _POLY[-1:] + _POLY[:-1], strict=True)]
    return f"({' + '.join(parts)}) % 2 = 1"


@query(f"WITH {VOX} SELECT i FROM vox WHERE {_inside_sql()}")
def point_in_polygon(spark, d):
    return G.in_polygon(vox(spark, d), _POLY).select("i")


_LINE = f"""{PTS}, c AS (SELECT volume_id AS curve, x, y, coalesce(lag(x) OVER w, x) AS x0, coalesce(lag(y) OVER w, y) AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2, coalesce(lead(x, 2) OVER w, lead(x) OVER w) AS x3, coalesce(lead(y, 2) OVER w, lead(y) OVER w) AS y3,
 row_number() OVER w - 1 AS seg, count(*) OVER (PARTITION BY volume_id) AS n FROM pts WINDOW w AS (PARTITION BY volume_id ORDER BY id)),
t AS (SELECT *, j / 32.0::DOUBLE AS t FROM c, range(0, 33) AS r(j) WHERE x2 IS NOT NULL AND (j < 32 OR seg = n - 2)),
line AS (SELECT curve, seg * 32 + j AS k, 0.5 * (2 * x + (x2 - x0) * t + (2 * x0 - 5 * x + 4 * x2 - x3) * t * t + (3 * x - x0 - 3 * x2 + x3) * t * t * t) AS x, 0.5 * (2 * y + (y2 - y0) * t + (2 * y0 - 5 * y + 4 * y2 - y3) * t * t + (3 * y - y0 - 3 * y2 + y3) * t * t * t) AS y FROM t)"""


@query(f"WITH {_LINE}, s AS (SELECT curve, k, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS s FROM line WINDOW w AS (PARTITION BY curve ORDER BY k)) SELECT curve, k, round(sum(s) OVER (PARTITION BY curve ORDER BY k), 4) AS cum FROM s")
def spline_arc_length(spark, d):
    line = C.catmull_rom(points(spark, d).select(F.col("volume_id").alias("curve"), F.col("id").alias("ord"), "x", "y"))
    return C.arc_length(line).select("curve", F.col("k").cast("long").alias("k"), F.round("cum", 4).alias("cum"))


_SUMS = f"""{VOX}, mip AS (SELECT x, y, max(v) AS v FROM vox WHERE z BETWEEN 0 AND 1 GROUP BY x, y), r AS (SELECT min(v) + 0.55::DOUBLE * (max(v) - min(v)) AS t FROM mip),
p AS (SELECT x::DOUBLE AS x, y::DOUBLE AS y, v - t AS w FROM mip, r WHERE v >= t)"""


@query(f"WITH {_SUMS} SELECT round(sum(w), 2) AS s0, round(sum(w * x), 2) AS sx, round(sum(w * x * x), 2) AS sx2, round(sum(w * x * x * y), 2) AS sx2y, min(x)::BIGINT AS x_lo, max(x)::BIGINT AS x_hi, count(*) AS n FROM p")
def arch_fit_sums(spark, d):
    s = C.arch_sums(vox(spark, d), 0, 1)
    return s.select(*(F.round(c, 2).alias(c) for c in ("s0", "sx", "sx2", "sx2y")), "x_lo", "x_hi", "n")


def _det(a: list) -> str:
    c = lambda r, k: a[r][k]
    return f"({c(0, 0)} * ({c(1, 1)} * {c(2, 2)} - {c(1, 2)} * {c(2, 1)}) - {c(0, 1)} * ({c(1, 0)} * {c(2, 2)} - {c(1, 2)} * {c(2, 0)}) + {c(0, 2)} * ({c(1, 0)} * {c(2, 1)} - {c(1, 1)} * {c(2, 0)}))"


_FIT = [["sx4", "sx3", "sx2"], ["sx3", "sx2", "sx"], ["sx2", "sx", "s0"]]
_PARABOLA = ", ".join(f"{_det([[('sx2y', 'sxy', 'sy')[r] if k == j else _FIT[r][k] for k in range(3)] for r in range(3)])} / nullif({_det(_FIT)}, 0) AS {n}" for j, n in enumerate("abc"))


@query(
    f"""WITH {_SUMS}, s AS (SELECT sum(w) AS s0, sum(w * x) AS sx, sum(w * x * x) AS sx2, sum(w * x * x * x) AS sx3, sum(w * x * x * x * x) AS sx4, sum(w * y) AS sy, sum(w * x * y) AS sxy, sum(w * x * x * y) AS sx2y, min(x) AS x_lo, max(x) AS x_hi, count(*) AS n FROM p),
f AS (SELECT {_PARABOLA}, x_lo, x_hi, n FROM s), o AS (SELECT *, ord / 6.0::DOUBLE AS t FROM f, range(0, 7) AS r(ord)),
q AS (SELECT *, n >= 32 AND a IS NOT NULL AS ok, CASE WHEN n >= 32 AND a IS NOT NULL THEN x_lo + greatest(1, x_hi - x_lo) * t ELSE 5.0::DOUBLE + 15.0::DOUBLE * t END AS px FROM o)
SELECT CAST(ord AS INTEGER) AS ord, round(px, 4) AS x, round(CASE WHEN ok THEN least(24, greatest(0, a * px * px + b * px + c)) ELSE 11.25::DOUBLE + 4.5::DOUBLE * (1 - (t - 0.5) * 2 * (t - 0.5) * 2) END, 4) AS y FROM q"""
)
def arch_control_points(spark, d):
    return C.arch_fit(vox(spark, d), grid(spark, d), 0, 1).select("ord", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query(
    f"""WITH {VOX}, s AS (SELECT k, 2 + k * 0.5::DOUBLE AS x, 12 + (k % 7) * 0.25::DOUBLE AS y FROM range(0, 41) AS r(k)), o AS (SELECT k, b, x AS px, y + (b * 1.0 - 3) AS py FROM s, range(0, 7) AS q(b)),
c AS (SELECT k, b, floor(px) + a AS cx, floor(py) + e AS cy, (CASE WHEN a = 1 THEN px - floor(px) ELSE 1 - (px - floor(px)) END) * (CASE WHEN e = 1 THEN py - floor(py) ELSE 1 - (py - floor(py)) END) AS w FROM o, range(0, 2) AS f(a), range(0, 2) AS g(e) WHERE px BETWEEN 0 AND 24 AND py BETWEEN 0 AND 24),
n AS (SELECT max(z) AS top FROM vox), t AS (SELECT k, z, b, top, sum(v * w) AS v FROM c JOIN vox ON x = cx AND y = cy, n WHERE w > 0 GROUP BY ALL) SELECT k AS col, top - z AS row, round(avg(v), 4) AS v FROM t GROUP BY k, z, top"""
)
def curved_reformation(spark, d):
    v, g = vox(spark, d), grid(spark, d)
    k = F.col("id")
    s = spark.range(0, 41).select(F.lit(0).cast("long").alias("volume_id"), k.alias("k"), (2 + k * 0.5).alias("x"), (12 + (k % 7) * 0.25).alias("y"), F.lit(0.0).alias("nx"), F.lit(1.0).alias("ny"))
    got = C.curved_reformation(v, g, s, 0, g.depth - 1, 3.0, 1.0)
    return got.select("col", "row", F.round("v", 4).alias("v"))


@query("SELECT p_partkey AS id, CAST(s AS BIGINT) AS start FROM (SELECT p_partkey, unnest(CASE WHEN p_size <= 16 THEN [0] ELSE list_transform(range(0, CAST(ceil((p_size - 16) / 8.0) AS BIGINT) + 1), lambda k: least(k * 8, p_size - 16)) END) AS s FROM part)")
def window_starts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(starts_of(F.col("p_size"), 16, 0.5)).alias("start")).withColumn("start", F.col("start").cast("long"))


@query("SELECT o_orderkey AS i, CASE WHEN m < 17 THEN m ELSE 32 - m END AS j FROM (SELECT o_orderkey, (((o_orderkey - 7000) % 32) + 32) % 32 AS m FROM orders)")
def reflect_index(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), mirrored(F.col("o_orderkey") - 7000, 17).cast("long").alias("j"))


_ENDS = ["a.dcm", "b.NII.GZ", "c.nrrd", "d.seg.nrrd", "e.stl", "f", "g.txt"]
_CASE = "CASE p_partkey % 7 " + " ".join(f"WHEN {k} THEN '{e}'" for k, e in enumerate(_ENDS)) + " END"
_MEDIA = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.MEDIA_TYPES.items()) + " ELSE 'application/octet-stream' END"


@query(f"WITH p AS (SELECT p_partkey AS id, lower(p_brand || '/' || {_CASE}) AS f FROM part), e AS (SELECT id, CASE WHEN f LIKE '%.nii.gz' THEN '.nii.gz' ELSE regexp_extract(f, '(\\.[^.]*)$', 1) END AS ext FROM p) SELECT id, ext, {_MEDIA} AS media FROM e")
def extension_media(spark, d):
    k = F.col("p_partkey") % 7
    end = F.element_at(F.array(*(F.lit(e) for e in _ENDS)), (k + 1).cast("int"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit("/"), end).alias("f"))
    return p.select("id", X.extension(F.col("f")).alias("ext"), X.media_type(F.col("f")).alias("media"))


@query(r"""SELECT p_partkey AS id, regexp_replace(trim(regexp_replace(regexp_replace(p_name || ' <' || p_type || '>: a/b?', '[<>:"/\\|?*]+', ' ', 'g'), '\s+', ' ', 'g')), '[^A-Za-z0-9_\-]+', '_', 'g') AS segment FROM part""")
def path_segment(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.path_segment(F.concat("p_name", F.lit(" <"), "p_type", F.lit(">: a/b?")), plain=True).alias("segment"))


@query(r"SELECT page_id, nullif(regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*', ''), '([^/]*)/*$', 1), '') AS name FROM pages")
def url_filename(spark, d):
    return table(spark, d, "pages").select("page_id", X.url_filename(F.col("url")).alias("name"))


@query("SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.escape_html(F.col("html"))).alias("escaped"))


@query("""SELECT conv_id, turn, md5('"' || replace(text, '"', '''') || '"') AS cell FROM conversations""")
def csv_cell(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.csv_text(F.col("text"))).alias("cell"))


@query(f"WITH {OBJECTS} SELECT id, CASE WHEN voxels >= 1000 THEN printf('%.2f', voxels / 1000.0::DOUBLE) || ' cm³' ELSE CAST(voxels AS VARCHAR) || ' mm³' END AS volume FROM objects")
def volume_text(spark, d):
    return objects(spark, d).select("id", X.volume_text(F.col("voxels").cast("double")).alias("volume"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def manifest_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _eigen(m: dict, p: str = "") -> str:
    """Columns e1 >= e2 >= e3: eigenvalues of a symmetric 3 x 3 matrix in closed form, over a query with its entries."""
    return f"""q{p} AS (SELECT *, ({m['xx']} + {m['yy']} + {m['zz']}) / 3 AS mid FROM m{p}),
d{p} AS (SELECT *, sqrt((({m['xx']} - mid) ** 2 + ({m['yy']} - mid) ** 2 + ({m['zz']} - mid) ** 2 + 2 * ({m['xy']} ** 2 + {m['xz']} ** 2 + {m['yz']} ** 2)) / 6) AS dev FROM q{p}),
r{p} AS (SELECT *, acos(greatest(-1, least(1, CASE WHEN dev = 0 THEN 1 ELSE {_det([[f"(({m['xx']} - mid) / dev)", f"({m['xy']} / dev)", f"({m['xz']} / dev)"], [f"({m['xy']} / dev)", f"(({m['yy']} - mid) / dev)", f"({m['yz']} / dev)"], [f"({m['xz']} / dev)", f"({m['yz']} / dev)", f"(({m['zz']} - mid) / dev)"]])} / 2 END))) / 3 AS phi FROM d{p}),
e{p} AS (SELECT *, mid + 2 * dev * cos(phi) AS e1, mid + 2 * dev * cos(phi + 2 * pi() / 3) AS e3, 3 * mid - (mid + 2 * dev * cos(phi)) - (mid + 2 * dev * cos(phi + 2 * pi() / 3)) AS e2 FROM r{p})"""


_CROSS = ", ".join(f"sum(({a} - m{a}) * ({b} - m{b})) AS s{a}{b}" for a in "xyz" for b in "uvw")
_GRAM = ", ".join(f"{' + '.join(f's{a}{p} * s{a}{q}' for a in 'xyz')} AS g{'xyz'['uvw'.index(p)]}{'xyz'['uvw'.index(q)]}" for k, p in enumerate("uvw") for q in "uvw"[k:])
_MEANS = ", ".join(f"avg({c}) OVER w AS m{c}" for c in "xyzuvw")


@query(
    f"""WITH {_PAIR}, g AS (SELECT id % 5 AS g, x, y, z, u, v, w FROM q), c AS (SELECT *, {_MEANS} FROM g WINDOW w AS (PARTITION BY g)),
s AS (SELECT g, count(*) AS n, {_CROSS}, sum({' + '.join(f'({c} - m{c}) ** 2' for c in 'xyzuvw')}) AS total FROM c GROUP BY g HAVING count(*) >= 3),
ms AS (SELECT *, {_GRAM} FROM s), {_eigen({k: f'g{k}' for k in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz')}, 's')}
SELECT g AS volume_id, round(sqrt(greatest(0, (total - 2 * (sqrt(greatest(0, e1)) + sqrt(greatest(0, e2)) + sign({_det([[f's{a}{b}' for b in 'uvw'] for a in 'xyz'])}) * sqrt(greatest(0, e3)))) / n)), 4) AS rmse FROM es"""
)
def rigid_alignment(spark, d):
    f = G.rigid_fit(_pairs(spark, d).drop("volume_id").withColumn("volume_id", F.col("id") % 5), "volume_id")
    return f.select("volume_id", F.round("rmse", 4).alias("rmse"))


_COV = ", ".join(f"covar_pop({a}, {b}) AS c{a}{b}" for k, a in enumerate("xyz") for b in "xyz"[k:])


@query(
    f"""WITH {PTS}, mp AS (SELECT volume_id, {_COV} FROM pts GROUP BY volume_id), {_eigen({k: f'c{k}' for k in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz')}, 'p')}
SELECT volume_id, CAST(k AS BIGINT) AS axis, round([e1, e2, e3][k + 1], 4) AS variance FROM ep, range(0, 3) AS r(k)"""
)
def principal_axes(spark, d):
    return G.principal_axes(points(spark, d), "volume_id").select("volume_id", "axis", F.round("variance", 4).alias("variance"))
