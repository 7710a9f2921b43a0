"""Queries over views, catalogue rows, names and small geometry, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.functions import text as X
from voxloom.operators import catalogue as C
from voxloom.operators import curves as V
from voxloom.operators import masks as M
from voxloom.operators import objects as O
from voxloom.operators import views as S
from voxloom.operators import workflows as K
from voxloom.plans.tables import OBJECTS, PTS, STUDIES, VOX, grid, objects, points, studies, table, vox
from voxloom.sources import dicom as D

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(e: str) -> str:
    return f"CAST(floor({e} + 0.5) AS BIGINT)"


# views


@query(f"WITH {VOX} SELECT i, CAST(least(255, greatest(0, floor((v - (40 - 400 / 2.0::DOUBLE)) / 400.0::DOUBLE * 255 + 0.5))) AS BIGINT) AS gray, 255 AS alpha FROM vox")
def window_pixels(spark, d):
    g = S.window_pixel(F.col("v"), 40, 400).cast("long")
    p = S.rgba(g)
    return vox(spark, d).select("i", p[2].cast("long").alias("gray"), p[3].alias("alpha"))


@query(
    f"""WITH {VOX}, n AS (SELECT max(i) // 625 + 1 AS d FROM vox), s AS (SELECT d, 12.0::DOUBLE / greatest(25, d) AS k FROM n),
o AS (SELECT d, greatest(1, {_round('25 * k')}) AS w, greatest(1, {_round('d * k')}) AS h FROM s),
p AS (SELECT a AS x, b AS y, c AS z, w, d, {_round('a / (w - 1.0::DOUBLE) * 24')} AS sx, {_round('b / (w - 1.0::DOUBLE) * 24')} AS sy, CASE WHEN h = 1 THEN 0 ELSE {_round('c / (h - 1.0::DOUBLE) * (d - 1)')} END AS sz FROM o, range(0, 12) AS r(a), range(0, 12) AS s(b), range(0, 12) AS t(c) WHERE a < w AND b < w AND c < h)
SELECT CAST((p.z * w + p.y) * w + p.x AS BIGINT) AS i, {_round('least(1, greatest(0, (v + 1000) / 6000.0::DOUBLE)) * 255')} AS v FROM p JOIN vox q ON q.x = sx AND q.y = sy AND q.z = sz"""
)
def volume_preview(spark, d):
    rows, _ = S.preview(vox(spark, d), grid(spark, d), -1000, 5000, most=12)
    return rows.select(F.col("i").cast("long"), F.col("v").cast("long"))


def _ramp(stops: list, k: int) -> str:
    out = "CASE"
    for a, b in zip(stops, stops[1:], strict=False):
        out += f" WHEN t <= {b[0]} THEN {_round(f'{a[k]} + ({b[k] - a[k]}) * least(1, greatest(0, (t - {a[0]}::DOUBLE) / ({b[0]}::DOUBLE - {a[0]}::DOUBLE)))')}"
    return out + f" ELSE {stops[-1][k]} END"


_MAPS = " UNION ALL ".join(f"SELECT '{n}' AS style, i, {_ramp(s, 1)} AS r, {_ramp(s, 2)} AS g, {_ramp(s, 3)} AS b, {_round('(10 + t * 245) * 0.5::DOUBLE')} AS a FROM t" for n, s in S.COLORMAPS.items())


@query(f"WITH t AS (SELECT i, i / 255.0::DOUBLE AS t FROM range(0, 256) AS r(i)) {_MAPS}")
def colormaps(spark, d):
    out = None
    for n in S.COLORMAPS:
        t = S.color_table(spark, n, 0.5).select(F.lit(n).alias("style"), "*")
        out = t if out is None else out.unionByName(t)
    return out


@query(
    f"""WITH {PTS}, s AS (SELECT id, x / 50 AS sx, y / 50 AS sy, z / 50 AS sz FROM pts),
m AS (SELECT *, coalesce(list_min(list_filter([sx, sy, sz], lambda q: q > 0)), 1.0) AS least FROM s)
SELECT id, round(greatest(0.5, sx / least), 9) AS kx, round(greatest(0.5, sy / least), 9) AS ky, round(greatest(0.5, sz / least), 9) AS kz, sz > greatest(sx, sy, 0.001) * 3 AS sparse FROM m"""
)
def axis_scales(spark, d):
    s = [F.col(c) / 50 for c in "xyz"]
    k = S.axis_scale(s)
    return points(spark, d).select("id", *(F.round(v, 9).alias(f"k{c}") for c, v in zip("xyz", k, strict=True)), S.is_sparse_axis(*s).alias("sparse"))


@query(
    f"""WITH {VOX}, r AS (SELECT label, min(v) AS lo, max(v) AS hi FROM vox GROUP BY label)
SELECT label, 256 AS w0, greatest(4095, hi - lo, 5000) AS w1, least(-1024, lo) AS l0, greatest(3071, hi, 100) AS l1 FROM r"""
)
def control_bounds(spark, d):
    r = vox(spark, d).groupBy("label").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    w, v = S.window_bounds(F.col("lo"), F.col("hi"), F.lit(5000)), S.level_bounds(F.col("lo"), F.col("hi"), F.lit(100))
    return r.select("label", w[0].alias("w0"), w[1].cast("long").alias("w1"), v[0].cast("long").alias("l0"), v[1].cast("long").alias("l1"))


@query(
    f"""WITH RECURSIVE m AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id % 41 - 20 AS dx, event_id % 37 - 18 AS dy FROM events),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 1500.0::DOUBLE AS w, 400.0::DOUBLE AS l FROM (SELECT DISTINCT user_id FROM m) u
 UNION ALL SELECT f.user_id, m.n, least(4095, greatest(256, floor(f.w - m.dy * (3839 / 300.0::DOUBLE) + 0.5))), least(3071, greatest(-1024, floor(f.l + m.dx * (4095 / 300.0::DOUBLE) + 0.5))) FROM f JOIN m ON m.user_id = f.user_id AND m.n = f.n + 1)
SELECT user_id, arg_max(w, n) AS "window", arg_max(l, n) AS level FROM f GROUP BY user_id"""
)
def window_drags(spark, d):
    k = F.col("event_id")
    moves = table(spark, d, "events").select("user_id", "event_id", (k % 41 - 20).alias("dx"), (k % 37 - 18).alias("dy"))
    return S.dragged(moves, "user_id", "event_id", (1500, 400), S.WINDOW_BOUNDS, S.LEVEL_BOUNDS)


@query(
    f"""WITH {VOX}, p AS (SELECT p_partkey AS id, p_partkey * 7 AS i FROM part), l AS (SELECT i, 1 AS g, label AS value FROM vox UNION ALL SELECT i, 2, label + 10 FROM vox WHERE i % 2 = 0),
s AS (SELECT 1 AS g, 0 AS ord, 2 AS value, 'two' AS name UNION ALL SELECT 1, 1, 2, 'again' UNION ALL SELECT 2, 0, 13, 'three' UNION ALL SELECT 2, 1, 12, 'late')
SELECT p.id, v.v, (SELECT arg_min(name, g * 100 + ord) FROM l JOIN s USING (g, value) WHERE l.i = p.i) AS segment FROM p LEFT JOIN vox v ON v.i = p.i"""
)
def probes(spark, d):
    v = vox(spark, d)
    p = table(spark, d, "part").select(F.lit(0).cast("long").alias("volume_id"), F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7).alias("i"))
    row = lambda g, c: v.select("volume_id", F.lit(g).alias("group"), "i", c.alias("label"))
    labels = row(1, F.col("label")).unionByName(row(2, F.col("label") + 10).where("i % 2 = 0"))
    segments = spark.createDataFrame([(1, 0, 2, "two"), (1, 1, 2, "again"), (2, 0, 13, "three"), (2, 1, 12, "late")], "group int, ord int, value long, name string")
    return S.probe(p, v, labels, segments).select("id", "v", "segment")


def _at(e: str, n: int) -> str:
    return f"CAST(least({n - 1}, greatest(0, floor({e} * {n - 1} + 0.5))) AS BIGINT)"


@query(
    f"""WITH r AS (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS a, (user_id % 53) / 52.0::DOUBLE AS b FROM events), q AS (SELECT *, a * 0.5::DOUBLE AS c, b * 0.5::DOUBLE AS e FROM r)
SELECT event_id, {_at('c', 30)} AS x0, {_at('a', 30)} AS x1, {_at('(1 - b)', 20)} AS z0, {_at('(1 - e)', 20)} AS z1, {_at('c', 25)} AS y0, {_at('a', 25)} AS y1 FROM q"""
)
def crop_rectangles(spark, d):
    a, b = (F.col("event_id") % 101) / 100.0, (F.col("user_id") % 53) / 52.0
    side, other = (S.crop_from_view(x, (a * 0.5, b * 0.5), (a, b), (30, 25, 20)) for x in ("coronal", "sagittal"))
    cols = side | {k: other[k] for k in ("y0", "y1")}
    return table(spark, d, "events").select("event_id", *(c.cast("long").alias(k) for k, c in cols.items()))


@query(
    """WITH n AS (SELECT p_partkey AS id, p_partkey % 25 AS x, p_partkey % 20 AS y, p_partkey % 7 AS z, p_size % 3 <> 0 AS visible FROM part)
SELECT id, x / 24.0::DOUBLE AS xr, 1 - z / 6.0::DOUBLE AS yr FROM n WHERE visible AND y = 5"""
)
def slice_annotations(spark, d):
    k = F.col("p_partkey")
    n = table(spark, d, "part").select(k.alias("id"), (k % 25).alias("x"), (k % 20).alias("y"), (k % 7).alias("z"), (F.col("p_size") % 3 != 0).alias("visible"))
    return S.annotations_on_slice(n, "coronal", 5, (25, 20, 7)).select("id", F.col("x_ratio").alias("xr"), F.col("y_ratio").alias("yr"))


_HEX = "CASE WHEN regexp_full_match(replace(c, '#', ''), '[0-9a-fA-F]{6}') THEN CAST(('0x' || substr(replace(c, '#', ''), %d, 2)) AS BIGINT) ELSE %d END"


@query(f"WITH c AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '#0aF' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') WHEN 1 THEN 'e8a87c' WHEN 2 THEN 'red' END AS c FROM pages) SELECT page_id, {_HEX % (1, 56)} AS r, {_HEX % (3, 189)} AS g, {_HEX % (5, 248)} AS b FROM c")
def hex_colors(spark, d):
    k = F.col("page_id")
    c = F.when(k % 4 == 0, F.concat(F.lit("#0aF"), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 4 == 1, "e8a87c").when(k % 4 == 2, "red")
    return table(spark, d, "pages").select("page_id", *(v.alias(n) for n, v in zip("rgb", S.hex_color(c), strict=True)))


@query(
    f"""WITH {VOX}, s AS (SELECT 1 AS label, 216 AS r, 195 AS g, 165 AS b, floor(0.5::DOUBLE * 0.6::DOUBLE * 180 + 0.5) / 255 AS a UNION ALL SELECT 2, 56, 189, 248, floor(0.6::DOUBLE * 180 + 0.5) / 255),
g AS (SELECT i, label, CAST(i % 256 AS DOUBLE) AS gray FROM vox)
SELECT i, round(coalesce(r * a + gray * (1 - a), gray), 6) AS r, round(coalesce(g * a + gray * (1 - a), gray), 6) AS g, round(coalesce(b * a + gray * (1 - a), gray), 6) AS b FROM g LEFT JOIN s USING (label)"""
)
def label_overlays(spark, d):
    v = vox(spark, d)
    segments = spark.createDataFrame([(1, "#d8c3a5", 0.5, True), (2, "none", 2.0, True), (3, "#ffffff", 1.0, False)], "value long, color string, opacity double, visible boolean")
    # the second segment's opacity is cut to 1 after the layer's 0.6
    got = S.label_overlay(v.select("volume_id", "i", (F.col("i") % 256).alias("gray")), v.select("volume_id", "i", "label"), segments.withColumn("opacity", F.least("opacity", F.lit(1.0))), 0.6)
    return got.select("i", *(F.round(c, 6).alias(c) for c in "rgb"))


@query(
    """WITH s AS (SELECT p_partkey AS ord, p_partkey % 25 AS x, p_partkey % 20 AS y, CASE WHEN p_size % 2 = 0 THEN 'foreground' ELSE 'background' END AS kind FROM part WHERE p_partkey % 7 = 3),
a AS (SELECT k AS da, 0 AS db FROM range(-3, 4) AS r(k) UNION SELECT 0, k FROM range(-3, 4) AS r(k)),
p AS (SELECT ord, x + da AS px, y + db AS py, CASE WHEN da = 0 AND db = 0 THEN 0 WHEN kind = 'foreground' THEN 1 ELSE 2 END AS c FROM s, a),
m AS (SELECT px, py, arg_max(c, ord) AS c FROM p WHERE px BETWEEN 0 AND 24 AND py BETWEEN 0 AND 19 GROUP BY px, py)
SELECT px, py, [255, 34, 248][c + 1] AS r, [255, 197, 113][c + 1] AS g, [255, 94, 113][c + 1] AS b FROM m"""
)
def seed_marks(spark, d):
    k = F.col("p_partkey")
    s = table(spark, d, "part").select(k.alias("ord"), (k % 25).alias("x"), (k % 20).alias("y"), (k % 7).alias("z"), F.when(F.col("p_size") % 2 == 0, "foreground").otherwise("background").alias("kind"))
    return S.seed_marks(s, "axial", 3, (25, 20, 7))


@query(f"WITH {VOX} SELECT label AS \"group\", max(i % 9) + 1 AS value, count(*) FILTER (i % 9 = 4) AS gone FROM vox GROUP BY label")
def segment_edits(spark, d):
    v = vox(spark, d).select("volume_id", "i", "x", "y", "z", F.col("label").alias("group"), (F.col("i") % 9).alias("label"))
    cleared = S.without_segment(v, 4).groupBy("group").agg(F.count_if((F.col("label") == 0) & (F.col("i") % 9 == 4)).alias("gone"))
    return S.next_segment_value(v.select("group", F.col("label").alias("value"))).join(cleared, "group")


@query(f"WITH {VOX} SELECT i, CAST(9 AS BIGINT) AS label FROM vox WHERE label = 3")
def label_to_mask(spark, d):
    return S.labels_of_mask(S.mask_of_label(vox(spark, d), 3), 9).select("i", "label")


@query(f"WITH {VOX} SELECT label, CAST(0 AS BIGINT) AS x0, greatest(0, max(x) - 1) AS x1, greatest(0, max(i % 3) - 1) AS z1 FROM vox GROUP BY label")
def crop_bounds(spark, d):
    n = vox(spark, d).groupBy("label").agg(F.max("x").alias("a"), F.max(F.col("i") % 3).alias("b"))
    c = S.full_crop((F.col("a"), F.col("a"), F.col("b")))
    return n.select("label", *(c[k].cast("long").alias(k) for k in ("x0", "x1", "z1")))


# catalogue


@query(f"WITH {STUDIES} SELECT id, name FROM studies WHERE id = 42 AND coalesce(deleted_at, 0) = 0")
def study_by_id(spark, d):
    return C.by_id(studies(spark, d), 42).select("id", "name")


@query("SELECT 'study_' || s_suppkey AS id, s_name AS name, 'indexed' AS status, CAST(77 AS BIGINT) AS created_at, CAST(77 AS BIGINT) AS updated_at FROM supplier")
def study_create(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return C.created(s, F.lit(77).cast("long"), F.concat(F.lit("study_"), "k"), "indexed").select("id", "name", "status", "created_at", "updated_at")


@query(f"WITH {STUDIES} SELECT id, row_number() OVER (ORDER BY updated_at DESC, id) AS place FROM studies WHERE deleted_at IS NULL AND source = 'BUILDING'")
def studies_of_owner(spark, d):
    from pyspark.sql import Window

    s = studies(spark, d).withColumns({"owner_id": F.col("source"), "created_at": F.col("updated_at")})
    got = C.listed(s, "BUILDING")
    return got.select("id", F.row_number().over(Window.partitionBy("owner_id").orderBy(F.desc("created_at"), "id")).cast("long").alias("place"))


@query(f"WITH {STUDIES}, n AS (SELECT id * 2 AS id, name || '!' AS name FROM studies) SELECT coalesce(n.id, s.id) AS id, coalesce(n.name, s.name) AS name, CASE WHEN s.id IS NULL THEN 99 ELSE s.updated_at END AS created_at, CASE WHEN n.id IS NULL THEN s.updated_at ELSE 99 END AS updated_at FROM studies s FULL JOIN n USING (id)")
def project_upsert(spark, d):
    s = studies(spark, d).select("id", "name", F.col("updated_at").alias("created_at"), "updated_at")
    return C.upserted(s, s.select((F.col("id") * 2).alias("id"), F.concat("name", F.lit("!")).alias("name")), F.lit(99).cast("long"))


_NOTE_SQL = """'{"annotations":[{"id":"a","studyId":"s","name":"n' || p_partkey || '","point":[1,2,3]},{"id":"b","name":"x","point":[1]}' || CASE WHEN p_size % 2 = 0 THEN ',{"id":"c","studyId":"s","name":"k","point":[4],"text":"t","visible":false}' ELSE '' END || '],"dicomImportEngine":"' || p_brand || '","maskWorkflow":{"brushSizeMm":' || p_size || '}}'"""


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'n' || p_partkey || ';t' ELSE 'n' || p_partkey END AS texts, CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 1 END AS BIGINT) AS shown, 'custom' AS engine, 'crosshair' AS tool, CAST(p_size AS DOUBLE) AS brush, 300.0::DOUBLE AS low FROM part")
def study_defaults(spark, d):
    text = F.concat(F.lit('{"annotations":[{"id":"a","studyId":"s","name":"n'), "p_partkey", F.lit('","point":[1,2,3]},{"id":"b","name":"x","point":[1]}'), F.when(F.col("p_size") % 2 == 0, ',{"id":"c","studyId":"s","name":"k","point":[4],"text":"t","visible":false}').otherwise(""), F.lit('],"dicomImportEngine":"'), "p_brand", F.lit('","maskWorkflow":{"brushSizeMm":'), "p_size", F.lit("}}"))
    s = table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.normal_state(text).alias("s"))
    notes = F.col("s.annotations")
    return s.select("id", F.array_join(F.transform(notes, lambda n: n["text"]), ";").alias("texts"), F.size(F.filter(notes, lambda n: n["visible"])).cast("long").alias("shown"), F.col("s.dicomImportEngine").alias("engine"), F.col("s.activeTool").alias("tool"), F.col("s.maskWorkflow.brushSizeMm").alias("brush"), F.col("s.maskWorkflow.thresholdRange")[0].alias("low"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 2 THEN 'version' WHEN 3 THEN 'state' WHEN 4 THEN 'mask' WHEN 5 THEN 'path' END AS error, CASE p_partkey % 6 WHEN 0 THEN 'embedded:mask' WHEN 1 THEN 'embedded:mask' END AS source FROM part""")
def project_manifests(spark, d):
    k = F.col("p_partkey") % 6
    body = lambda version, app, path, size, state: F.lit(f'{{"version":{version},"app":"{app}","exportedAt":"t","masks":[{{"id":"m","path":"{path}","bytes":{size}}}],"surfaces":[]' + ("" if version == 1 else ',"dataSources":[{"id":"m","kind":"embedded","role":"mask","path":"p","bytes":1}]') + (',"state":{}' if state else "") + "}")
    text = F.when(k == 0, body(1, "other", "masks/a.bin", 8, True)).when(k == 1, body(2, "viewer", "masks/a.bin", 8, True)).when(k == 2, body(2, "other", "masks/a.bin", 8, True)).when(k == 3, body(2, "viewer", "masks/a.bin", 8, False)).when(k == 4, body(2, "viewer", "masks/a.bin", -1, True)).otherwise(body(2, "viewer", "../a.bin", 8, True))
    got = C.project_manifest(table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("json")), "json", "viewer")
    first = F.col("manifest.dataSources")[0]
    return got.select("id", "error", F.when(F.col("manifest").isNotNull(), F.concat_ws(":", first["kind"], first["role"])).alias("source"))


@query("SELECT page_id, CAST(ord AS BIGINT) AS ord, CASE ord WHEN 0 THEN url ELSE 'b' || page_id END AS url FROM pages, range(0, 2) AS r(ord) WHERE page_id % 3 <> 2 AND (page_id % 3 = 0 OR ord = 0)")
def remote_manifests(spark, d):
    k = F.col("page_id")
    esc = F.regexp_replace("url", r'(["\\])', r"\\$1")
    text = F.when(k % 3 == 0, F.concat(F.lit('{"name":"n","files":[{"url":"'), esc, F.lit('"},{"url":"b'), k, F.lit('","name":"x"}]}'))).when(k % 3 == 1, F.concat(F.lit('{"resources":[{"url":"'), esc, F.lit('","mime":"m"}]}'))).otherwise(F.lit('{"files":[{"url":"a"},{"name":"no url"}]}'))
    return C.remote_entries(table(spark, d, "pages").select("page_id", text.alias("json")), "json").select("page_id", F.col("ord").cast("long"), "url")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id * 10 END AS total FROM events")
def content_ranges(spark, d):
    k = F.col("event_id")
    h = F.when(k % 3 == 0, F.concat(F.lit("bytes 0-511/"), k * 10)).when(k % 3 == 1, "bytes 0-511/*")
    return table(spark, d, "events").select("event_id", C.range_total(h).alias("total"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'given' WHEN 1 THEN 'CT_20240102' || lpad(CAST(event_id % 1000000 AS VARCHAR), 6, '0') WHEN 2 THEN 'st' || user_id WHEN 3 THEN 'folder' ELSE 'CT' END AS id FROM events")
def scan_ids(spark, d):
    k, none = F.col("event_id"), F.lit(None).cast("string")
    m = k % 5
    time = F.when(m <= 1, F.concat(F.lpad((k % 1000000).cast("string"), 6, "0"), F.lit(".25"))).otherwise("")
    got = C.scan_id(F.when(m == 0, "given").otherwise(""), none, F.lit("20240102"), time, F.when(m <= 2, F.concat(F.lit("st"), "user_id")), F.when(m <= 3, "folder").otherwise(""))
    return table(spark, d, "events").select("event_id", got.alias("id"))


@query("WITH n AS (SELECT o_custkey % 7 AS s, o_orderstatus AS t, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, s, t LIMIT 1) SELECT o_orderkey AS id FROM orders JOIN n ON o_custkey % 7 = s AND o_orderstatus = t")
def modal_series(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 7).alias("s"), F.col("o_orderstatus").alias("t"))
    return C.modal_series(o, "s", "t").select("id")


@query("WITH o AS (SELECT o_custkey % 5 AS g, CASE WHEN o_custkey % 5 = 0 THEN '' WHEN o_orderstatus = 'P' THEN 'MR' WHEN o_custkey % 5 = 1 THEN 'CT' ELSE 'OT' END AS m, o_custkey % 5 = 0 AS f FROM orders), a AS (SELECT g, list_sort(list_distinct(list(m) FILTER (m <> ''))) AS ms, bool_or(f) AS f FROM o GROUP BY g) SELECT g, coalesce(array_to_string(ms, ','), '') AS modalities, CASE WHEN len(ms) > 0 AND NOT list_contains(ms, 'CT') THEN 'E_MODALITY' WHEN f THEN 'E_MULTIFRAME' ELSE 'E_GEOMETRY' END AS problem FROM a")
def folder_modalities(spark, d):
    g = F.col("o_custkey") % 5
    m = F.when(g == 0, "").when(F.col("o_orderstatus") == "P", "MR").when(g == 1, "CT").otherwise("OT")
    h = table(spark, d, "orders").select(g.alias("g"), m.alias("modality"), F.when(g == 0, 9).otherwise(1).alias("frames"))
    return C.modalities(h, "g").select("g", F.array_join("modalities", ",").alias("modalities"), "problem")


@query(
    f"""WITH {VOX} SELECT name, ok FROM (VALUES ('accepted-count', true), ('min-labels', false), ('min-accepted', false), ('sequential-labels', true), ('same-labels', true), ('positive-voxels', false),
 ('assigned', true), ('centroid', true), ('bbox', true), ('extent', true), ('voxel-count', false), ('measured-bbox', true)) AS t(name, ok)"""
)
def manifest_checks(spark, d):
    v = vox(spark, d)
    n = v.where("label > 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.min(c) for c in "zyx"), *(F.max(c) + 1 for c in "zyx")).alias("bbox"))
    items = n.select("label", (F.col("n") + F.when(F.col("label") == 2, F.col("n")).otherwise(0)).alias("assigned_voxels"), F.lit(None).cast("string").alias("quality_status"), "bbox", F.slice("bbox", 1, 3).alias("centroid"), F.slice("bbox", 4, 3).alias("extent"))
    return C.manifest_checks(items, v.select("label", "x", "y", "z"), 5)


_CURATED = """list_filter([CASE WHEN voxels < 10000 THEN 'small-fragment' END, CASE WHEN voxels > 140000 THEN 'large-region' END, CASE WHEN least(ez, ey, ex) < 18 THEN 'thin-fragment' END,
 CASE WHEN ez > 115 OR ey > 95 OR ex > 100 THEN 'broad-region' END, CASE WHEN cz < 55 OR cz > 260 THEN 'z-outlier' END, CASE WHEN cy < 55 OR cy > 380 THEN 'y-outlier' END, CASE WHEN cx < 95 OR cx > 520 THEN 'x-outlier' END], lambda r: r IS NOT NULL)"""


@query(f"WITH {OBJECTS} SELECT id, array_to_string({_CURATED}, ';') AS reasons FROM objects")
def curation_reasons(spark, d):
    return O.quality(objects(spark, d), O.CURATION_REASONS).select("id", F.array_join("quality_reasons", ";").alias("reasons"))


@query(
    """WITH o AS (SELECT p_partkey AS id, p_partkey % 90 AS z, p_partkey % 70 AS y, p_partkey % 80 AS x FROM part), a AS (SELECT id, least(120, greatest(0, z - 20) + 40) AS z1, least(60, greatest(0, y - 10) + 21) AS y1, least(80, greatest(0, x - 10) + 21) AS x1 FROM o)
SELECT id, greatest(0, z1 - 40) AS z0, z1, greatest(0, y1 - 21) AS y0, y1, greatest(0, x1 - 21) AS x0, x1 FROM a"""
)
def center_regions(spark, d):
    k = F.col("p_partkey")
    lo, hi = K.center_roi([k % 80, k % 70, k % 90], (21, 21, 40), (80, 60, 120))
    return table(spark, d, "part").select(k.alias("id"), *(v.cast("long").alias(f"{c}0") for c, v in zip("xyz", lo, strict=True)), *(v.cast("long").alias(f"{c}1") for c, v in zip("xyz", hi, strict=True)))


# names and text


@query("SELECT p_partkey AS id, CASE WHEN n = 0 THEN '0 voxels' WHEN n * 0.4 >= 1000 THEN format('{:,}', n) || ' voxels · ' || format('{:.2f}', n * 0.4::DOUBLE / 1000) || ' cm3' ELSE format('{:,}', n) || ' voxels · ' || CAST(floor(n * 0.4 + 0.5) AS BIGINT) || ' mm3' END AS t FROM (SELECT p_partkey, (p_partkey % 50) * 999 AS n FROM part)")
def voxel_texts(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), X.voxel_text(k % 50 * 999, 0.4).alias("t"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 = 1 THEN p_size + 0.5 END AS v FROM part")
def csv_lookups(spark, d):
    k = F.col("p_partkey") % 3
    line = F.when(k == 0, F.concat(F.lit("key,"), "p_size", F.lit(",7"))).when(k == 1, F.concat(F.lit("key, "), "p_size", F.lit(".5mm\r"))).otherwise("keys,3\nkey,x")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), X.csv_value(F.concat(F.lit("head,1\n"), line, F.lit("\nkey,99")), "key").alias("v"))


# geometry


_M = "[1 + s % 3, 0.5, 0.0, x, 0.25, 2.0, 0.0, y, 0.0, s % 2, 1.5, z, 0.0, 0.0, 0.0, 1.0]"


def _matrices(spark, d):
    s = F.col("p_size").cast("double")
    k = F.col("p_partkey").cast("double")
    m = F.array(1 + s % 3, *map(F.lit, (0.5, 0.0)), k, *map(F.lit, (0.25, 2.0, 0.0)), s, F.lit(0.0), s % 2, F.lit(1.5), k % 7, *map(F.lit, (0.0, 0.0, 0.0, 1.0)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), m.alias("m"))


@query("SELECT p_partkey AS id, true AS inverse, true AS twice FROM part")
def matrix_inverse(spark, d):
    same = [float(r == c) for r in range(4) for c in range(4)]
    p = G.multiply_matrices(F.col("m"), F.col("v"))
    near = lambda a, b: F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) < 1e-6), lambda ok: ok)
    t = G.transposed(G.transposed(F.col("m"), 4), 4)
    return _matrices(spark, d).withColumn("v", G.inverse_matrix(F.col("m"))).select("id", near(p, F.array(*map(F.lit, same))).alias("inverse"), near(t, F.col("m")).alias("twice"))


@query(
    f"""WITH {PTS}, n AS (SELECT id, x, y, z, sqrt(x * x + y * y + z * z) AS l FROM pts), u AS (SELECT id, x / l AS x, y / l AS y, z / l AS z FROM n WHERE l > 0)
SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM u"""
)
def rotation_onto(spark, d):
    p = points(spark, d).withColumn("b", F.array("x", "y", "z")).where("x <> 0 or y <> 0 or z <> 0")
    r = G.rotation_onto(F.array(*map(F.lit, (0.0, 0.0, 2.0))), F.col("b"))
    p = p.select("id", r.alias("r"))  # the third column of the rotation is where (0, 0, 1) goes
    return p.select("id", *(F.round(F.col("r")[3 * k + 2], 6).alias(c) for k, c in enumerate("xyz")))


@query("SELECT p_partkey AS id, round(cos(radians(p_size)), 9) AS a, round(sin(radians(p_size)), 9) AS b, true AS same FROM part")
def axis_rotations(spark, d):
    angle = F.radians(F.col("p_size").cast("double"))
    r = G.axis_rotation(F.array(*map(F.lit, (0.0, 0.0, 3.0))), angle)
    q = G.quaternion_rotation(F.array(F.cos(angle / 2), F.lit(0.0), F.lit(0.0), F.sin(angle / 2)))
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), r.alias("r"), q.alias("q"))
    same = F.forall(F.zip_with("r", "q", lambda x, y: F.abs(x - y) < 1e-9), lambda ok: ok)
    return t.select("id", F.round(F.col("r")[0], 9).alias("a"), F.round(F.col("r")[3], 9).alias("b"), same.alias("same"))


@query(
    f"""WITH r AS (SELECT event_id, (event_id % 101) / 100.0::DOUBLE * 14.7::DOUBLE AS ax, (user_id % 53) / 52.0::DOUBLE * 19.6::DOUBLE AS ay, 7.35::DOUBLE AS bx, 4.9::DOUBLE AS b_y, 14.7::DOUBLE AS cx, 0.0::DOUBLE AS cy FROM events),
v AS (SELECT *, ax - bx AS ux, ay - b_y AS uy, cx - bx AS vx, cy - b_y AS vy FROM r), m AS (SELECT *, sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy) AS n FROM v)
SELECT event_id, round(sqrt(ux * ux + uy * uy), 6) AS mm, round(degrees(acos(greatest(-1, least(1, (ux * vx + uy * vy) / CASE WHEN n = 0 THEN 1 ELSE n END)))), 4) AS angle, round(pi() * abs(bx - ax) / 2 * abs(b_y - ay) / 2, 6) AS ellipse FROM m"""
)
def overlay_measures(spark, d):
    a, b = (F.col("event_id") % 101) / 100.0, (F.col("user_id") % 53) / 52.0
    shares = F.array(F.array(a, b), F.array(F.lit(0.5), F.lit(0.25)), F.array(F.lit(1.0), F.lit(0.0)))
    p = G.view_points(shares, 50, 50, 0.3, 0.4)
    e = table(spark, d, "events").select("event_id", p.alias("p"))
    q = F.col("p")
    return e.select("event_id", F.round(G.distance(q[0], q[1]), 6).alias("mm"), F.round(G.view_angle(q), 4).alias("angle"), F.round(G.view_ellipse(q), 6).alias("ellipse"))


@query(
    """WITH p AS (SELECT p_partkey AS id, (p_partkey % 41) - 5.0::DOUBLE AS x, (p_partkey % 29) * 1.0::DOUBLE AS y FROM part), c AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 10.0, 10.0), (2, 20.0, 10.0), (3, 30.0, 0.0)) t(n, cx, cy)),
s AS (SELECT a.n, a.cx AS ax, a.cy AS ay, b.cx - a.cx AS dx, b.cy - a.cy AS dy FROM c a JOIN c b ON b.n = a.n + 1),
d AS (SELECT id, x, y, n, least(1, greatest(0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) AS t, ax, ay, dx, dy FROM p, s),
e AS (SELECT id, any_value(x) AS x, any_value(y) AS y, arg_min(n, round(sqrt(pow(x - (ax + t * dx), 2) + pow(y - (ay + t * dy), 2)), 9) * 1000 + n / 1000.0) AS n, min(sqrt(pow(x - (ax + t * dx), 2) + pow(y - (ay + t * dy), 2))) AS best FROM d GROUP BY id),
f AS (SELECT *, sqrt(x * x + y * y) AS d0, sqrt(pow(x - 30, 2) + y * y) AS d1 FROM e)
SELECT id, CAST(CASE WHEN d0 < best - 1e-9 AND d0 <= d1 THEN 0 WHEN d1 < best - 1e-9 THEN 4 ELSE n + 1 END AS BIGINT) AS place FROM f"""
)
def arch_inserts(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("id"), (k % 41 - 5).cast("double").alias("x"), (k % 29).cast("double").alias("y"))
    curve = F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0.0, 0.0), (10.0, 10.0), (20.0, 10.0), (30.0, 0.0))))
    new = V.with_control_point(curve, F.struct("x", "y"))
    return p.select("id", V.insert_place(curve, F.struct("x", "y")).cast("long").alias("place"), F.size(new).alias("n")).where("n = 5").select("id", "place")


# files


@query(
    """WITH h AS (SELECT o_orderkey AS id, (o_orderkey % 3) AS k FROM orders)
SELECT id, CASE k WHEN 0 THEN '0,1,2' WHEN 1 THEN '1,2,0' ELSE '2,0,1' END AS axes, CASE k WHEN 0 THEN '1,1,1' WHEN 1 THEN '1,-1,1' ELSE '-1,1,-1' END AS signs FROM h"""
)
def axis_maps(spark, d):
    k = F.col("o_orderkey") % 3
    vec = lambda *v: F.array(*map(F.lit, map(float, v)))
    row = F.when(k == 0, vec(0.9, 0.1, 0)).when(k == 1, vec(0, 1, 0.2)).otherwise(vec(0, 0.1, -1))
    col = F.when(k == 0, vec(0, 1, 0)).when(k == 1, vec(0, 0, -1)).otherwise(vec(1, 0, 0))
    third = F.when(k == 0, vec(0, 0, 1)).when(k == 1, vec(1, 0, 0)).otherwise(vec(0, -0.9, 0.1))
    m = D.axis_map([row, col, third])
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(m["axes"].cast("array<string>"), ",").alias("axes"), F.array_join(m["signs"].cast("array<string>"), ",").alias("signs"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN '0.0,1.0,0.0' ELSE '1.0,0.0,0.0' END AS "left", CASE WHEN o_orderkey % 2 = 0 THEN '-1.0,0.0,0.0' ELSE '0.0,-1.0,0.0' END AS anterior FROM orders"""
)
def patient_axes(spark, d):
    iop = F.when(F.col("o_orderkey") % 2 == 0, F.array(*map(F.lit, (0.0, 2.0, 0.0, 3.0, 0.0, 0.0))))
    a = D.patient_axes(iop)
    join = lambda c: F.array_join(F.transform(c, lambda v: (v + 0.0).cast("string")), ",")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), join(a["left"]).alias("left"), join(a["anterior"]).alias("anterior"))


@query(
    f"""WITH {VOX}, m AS (SELECT * FROM vox WHERE label = 2), t AS (SELECT x, y, z FROM m), six AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) d(dx, dy, dz)), lim AS (SELECT max(z) AS zm FROM vox),
grown AS (SELECT x, y, z FROM t UNION SELECT x + dx, y + dy, z + dz FROM t, six, lim WHERE x + dx BETWEEN 0 AND 24 AND y + dy BETWEEN 0 AND 24 AND z + dz BETWEEN 0 AND zm),
closed AS (SELECT g.x, g.y, g.z FROM grown g, six JOIN grown h ON h.x = g.x + dx AND h.y = g.y + dy AND h.z = g.z + dz GROUP BY g.x, g.y, g.z HAVING count(*) = 6)
SELECT (z * 25 + y) * 25 + x AS i FROM closed"""
)
def mask_closing(spark, d):
    v, g = vox(spark, d), grid(spark, d)
    return M.closing(M.mask_rows(v.where("label = 2")), g).select(F.col("i").cast("long"))


@query(
    f"""WITH {VOX}, a AS (SELECT *, max(v) OVER (PARTITION BY y, z ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS t FROM vox),
b AS (SELECT * REPLACE (max(t) OVER (PARTITION BY x, z ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS t) FROM a), c AS (SELECT * REPLACE (max(t) OVER (PARTITION BY x, y ORDER BY z RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS t) FROM b)
SELECT i, v FROM c WHERE v = t"""
)
def local_maxima(spark, d):
    return M.local_maxima(vox(spark, d).select("volume_id", "i", "x", "y", "z", "v"), "v", 1).select("i", "v")


@query(f"WITH {VOX} SELECT a.i, round(min(((a.x - b.x) * 0.5::DOUBLE) ** 2 + (a.y - b.y) ** 2 + ((a.z - b.z) * 2.0::DOUBLE) ** 2), 6) AS d2 FROM vox a, vox b WHERE a.v > -700 AND b.v <= -700 GROUP BY a.i")
def distance_in_mm(spark, d):
    v, g = vox(spark, d), grid(spark, d, 0.5, 1.0, 2.0)
    got = M.squared_distance(v, M.threshold(v, -699, 1e9), g, in_mm=True)
    return got.select(g.index(F.col("x"), F.col("y"), F.col("z")).cast("long").alias("i"), F.round("d2", 6).alias("d2"))


@query(f"WITH {VOX} SELECT i, CAST(least(32767, greatest(-32768, round_even(v * 12.5::DOUBLE - 3, 0))) AS BIGINT) AS v FROM vox")
def offline_values(spark, d):
    return vox(spark, d).select("i", D.rescaled_half_even(F.col("v").cast("double"), 12.5, -3.0).alias("v"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey % 3 <> 0")
def measurement_deletes(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    notes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("measurement_id"))
    return C.without_measurements(c, notes, c.where("id % 3 = 0"))[1].select("id")
