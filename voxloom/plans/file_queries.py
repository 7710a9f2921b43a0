"""Queries over files, texts and candidates, each with its SQL. Files are put together from columns of the tables."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from voxloom.functions import text as X
from voxloom.functions.jsnum import target_size as size_of
from voxloom.operators import candidates as N
from voxloom.operators import objects as O
from voxloom.operators import voxels as V
from voxloom.plans.tables import OBJECTS, PTS, VOX, objects, points, table, vox
from voxloom.sources import dicom, files, nifti, sinks, vendor

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _element(tag: tuple[int, int], vr: str, value, n: int):
    """A data element of a value of ``n`` bytes: bytes or a column of them."""
    size = b"\0\0" + struct.pack("<I", n) if vr in ("OW", "SQ") else struct.pack("<H", n)
    return [F.lit(struct.pack("<HH", *tag) + vr.encode() + size), F.lit(value) if isinstance(value, bytes) else value]


def _byte(c):
    return F.unhex(F.lpad(F.hex(c), 2, "0"))


def _dicoms(spark, d, syntax=None, samples=None):
    """One 2 x 2 slice for each supplier, in the series of its nation."""
    k = F.col("s_suppkey")
    padded = lambda c, n: F.encode(F.lpad(c.cast("string"), n, "0"), "US-ASCII")
    body = [
        *_element((8, 0x60), "CS", b"CT", 2),
        *_element((0x20, 0xE), "UI", padded(F.col("s_nationkey"), 4), 4),
        *_element((0x20, 0x32), "DS", F.concat(F.lit(b"0\\0\\"), padded(k, 6)), 10),
        *_element((0x20, 0x37), "DS", b"1\\0\\0\\0\\1\\0 ", 12),
        *_element((0x28, 2), "US", samples if samples is not None else b"\1\0", 2),
        *_element((0x28, 0x10), "US", b"\2\0", 2),
        *_element((0x28, 0x11), "US", b"\2\0", 2),
        *_element((0x28, 0x30), "DS", b"0.5\\0.5 ", 8),
        *_element((0x28, 0x100), "US", b"\x10\0", 2),
        *_element((0x28, 0x103), "US", b"\1\0", 2),
        *_element((0x28, 0x1052), "DS", b"-1000 ", 6),
        *_element((0x28, 0x1053), "DS", b"2 ", 2),
        *_element((0x7FE0, 0x10), "OW", F.concat(_byte(k % 100), F.lit(b"\0" + struct.pack("<3h", 1, 2, 3))), 8),
    ]
    uid = syntax if syntax is not None else F.lit(b"1.2.840.10008.1.2.1\0   ")
    return table(spark, d, "supplier").select(F.concat(F.lit("f/"), k, F.lit(".dcm")).alias("path"), F.concat(F.lit(b"\0" * 128 + b"DICM"), *_element((2, 0x10), "UI", uid, 23), *body).alias("content"))


@query("WITH s AS (SELECT s_nationkey AS n, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS z FROM supplier) SELECT CAST(n AS BIGINT) AS volume_id, z * 4 + p AS i, CAST(CASE p WHEN 0 THEN k % 100 ELSE p END * 2 - 1000 AS BIGINT) AS v FROM s, range(0, 4) AS r(p)")
def dicom_volumes(spark, d):
    f = _dicoms(spark, d)
    slices = dicom.assemble(dicom.series(dicom.read_headers(f)), f)
    slices = slices.withColumn("volume_id", F.split("volume", r"\|")[0].cast("long"))
    return files.voxels_of_slices(slices).select("volume_id", "i", "v")


@query("SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 1 THEN 'E_DICOM_SYNTAX' WHEN 2 THEN 'E_DICOM_SYNTAX' WHEN 3 THEN 'E_DICOM_COLOR' END AS error, s_suppkey % 4 = 0 AS native FROM supplier")
def dicom_gate(spark, d):
    k = F.col("s_suppkey") % 4
    uid = F.when(k == 1, F.lit(b"1.2.840.10008.1.2.4.70\0")).when(k == 2, F.lit(b"1.2.840.10008.1.2.2\0   ")).otherwise(F.lit(b"1.2.840.10008.1.2.1\0   "))
    head = dicom.read_headers(_dicoms(spark, d, uid, F.when(k == 3, F.lit(b"\3\0")).otherwise(F.lit(b"\1\0"))))
    native = dicom.is_native(head).select("path", F.lit(True).alias("native"))
    return head.join(native, "path", "left").select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("id"), "error", F.coalesce("native", F.lit(False)).alias("native"))


def _bytes_of(k, n: int):
    return F.concat(*(F.concat(_byte(k + j), F.lit(b"\0")) for j in range(n)))


@query("SELECT CAST(n_nationkey AS BIGINT) AS volume_id, CAST(j AS BIGINT) AS i, CAST((n_nationkey + j) * 2 + 1 AS BIGINT) AS v FROM nation, range(0, 12) AS r(j)")
def nifti_volumes(spark, d):
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 3, 2, 2, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<8f", head, 76, 1, 0.5, 0.6, 0.7, 0, 0, 0, 0)
    struct.pack_into("<3f", head, 108, 352, 2, 1)
    k = F.col("n_nationkey")
    f = table(spark, d, "nation").select(k.cast("string").alias("path"), F.concat(F.lit(bytes(head)), _bytes_of(k, 12)).alias("content"))
    return files.voxels_of_slices(nifti.read(f).withColumn("volume_id", F.col("path").cast("long"))).select("volume_id", "i", "v")


@query("SELECT CAST(n_nationkey AS BIGINT) AS volume_id, CAST(j AS BIGINT) AS i, CAST(j % 3 AS BIGINT) AS x, CAST(j // 6 AS BIGINT) AS z, CAST(n_nationkey + j AS BIGINT) AS v FROM nation, range(0, 12) AS r(j)")
def raw_volumes(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("volume_id"))
    blobs = n.select("volume_id", _bytes_of(F.col("volume_id"), 12).alias("content"))
    sizes = n.select("volume_id", *(F.lit(v).cast("long").alias(c) for c, v in (("width", 3), ("height", 2), ("depth", 2))))
    return files.voxels_of_slices(files.raw_volume(sizes, blobs)).select("volume_id", "i", "x", "z", "v")


@query(f"WITH {VOX} SELECT z, sum(v * (i % 7)) AS mark, count(*) AS n FROM vox GROUP BY z")
def slice_round_trip(spark, d):
    back = files.voxels_of_slices(files.slices_of_voxels(vox(spark, d), 25, 25))
    kept = vox(spark, d).select("volume_id", "i")
    return back.join(kept, ["volume_id", "i"], "left_semi").groupBy("z").agg(F.sum(F.col("v") * (F.col("i") % 7)).alias("mark"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {PTS} SELECT id, 'p' || id AS label, CASE WHEN id % 2 = 0 THEN -x ELSE x END AS x, CASE WHEN id % 2 = 0 THEN -y ELSE y END AS y, z FROM pts")
def landmark_sets(spark, d):
    p = points(spark, d)
    one = F.struct(F.struct(F.when(F.col("id") % 2 == 0, "RAS").otherwise("LPS").alias("coordinateSystem"), F.array(F.struct(F.concat(F.lit("p"), "id").alias("label"), F.array("x", "y", "z").alias("position"))).alias("controlPoints")).alias("m"))
    doc = p.select("id", F.to_json(F.struct(F.array(one["m"]).alias("markups"))).alias("json")).withColumnRenamed("id", "key")
    return sinks.landmarks(doc, "json", "key").select(F.col("key").alias("id"), "label", "x", "y", "z")


@query("SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS a, p_partkey + 10 - (10.0::DOUBLE * p_size + 20 * 0.5::DOUBLE) AS tx, 2.0::DOUBLE + 20 - 20 * 1.0::DOUBLE AS ty FROM part")
def transform_texts(spark, d):
    text = F.concat(F.lit("#Insight Transform File V1.0\n#Transform 0\nTransform: AffineTransform_double_3_3\nParameters: "), "p_size", F.lit(" 0.5 0 0 1 0 0 0 1 "), "p_partkey", F.lit(" 2 3\nFixedParameters: 10 20 30\n"))
    m = sinks.parse_transform(text)
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), m.alias("m"))
    again = sinks.parse_transform(sinks.transform_text(F.col("m")))
    t = t.withColumn("again", again)
    return t.select("id", F.col("again")[0].alias("a"), F.col("again")[3].alias("tx"), F.col("m")[7].alias("ty"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL ELSE 'v' || page_id END AS name, CASE page_id % 3 WHEN 0 THEN page_id + 0.25 ELSE page_id + 0.5 END AS size FROM pages")
def vendor_tags(spark, d):
    k = F.col("page_id")
    text = F.concat(F.lit("<Scan a='1'>\n <NAME>"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit(" v"), k, F.lit("\n"))), F.lit("</NAME>"), F.when(k % 3 == 0, F.concat(F.lit("<size>x</size><alt>"), k, F.lit(",25</alt>"))).otherwise(F.concat(F.lit("<size unit='mm'>"), k, F.lit(",5</size>"))), F.lit("</Scan>"))
    return table(spark, d, "pages").select("page_id", vendor.tag_text(text, "name").alias("name"), vendor.tag_number(text, "size", "alt").alias("size"))


@query("SELECT p_partkey AS id, 'a' || p_partkey || ';' || CAST(p_size AS DOUBLE) || ';-0.5' AS list, p_size + 0.5 AS comma, CAST(greatest(1, floor(p_size * 0.3::DOUBLE / 0.4::DOUBLE + 0.5)) AS BIGINT) AS size FROM part")
def number_texts(spark, d):
    s = F.col("p_size")
    numbers = X.number_list(F.concat(F.lit(" "), s.cast("string"), F.lit("\\x\\-0.5 \\nan\\")))
    shown = F.concat(F.lit("a"), "p_partkey", F.lit(";"), F.array_join(F.transform(numbers, lambda v: v.cast("string")), ";"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), shown.alias("list"), X.comma_number(F.concat(s.cast("string"), F.lit(",5"))).alias("comma"), size_of(s, 0.3, 0.4).cast("long").alias("size"))


@query("SELECT q * 10 + p AS fdi, ['Upper Right', 'Upper Left', 'Lower Left', 'Lower Right'][q] || ' ' || ['Central Incisor', 'Lateral Incisor', 'Canine', 'First Premolar', 'Second Premolar', 'First Molar', 'Second Molar', 'Third Molar'][p] AS fdi_name FROM range(1, 5) AS a(q), range(1, 9) AS b(p)")
def tooth_names(spark, d):
    return O.tooth_names(spark)


@query(
    f"""WITH {OBJECTS} SELECT id, id || ',"n ''' || id || '''",' || CASE WHEN id % 2 = 0 THEN CAST(11 + id % 8 AS VARCHAR) ELSE '' END || ',' || voxels || ',' || format('{{:.1f}}', voxels * 0.3::DOUBLE) || ',review,0.46,"a; b"' AS value FROM objects"""
)
def report_lines(spark, d):
    o = objects(spark, d).select(F.col("id").alias("label"), F.concat(F.lit('n "'), "id", F.lit('"')).alias("name"), F.when(F.col("id") % 2 == 0, 11 + F.col("id") % 8).alias("fdi"), "voxels", (F.col("voxels") * 0.3).alias("volume_mm3"), F.lit("review").alias("quality_status"), F.lit(0.46).alias("quality_score"), F.array(F.lit("a"), F.lit("b")).alias("quality_reasons"))
    return sinks.report_csv(o).where("line > 0").select((F.col("line") - 1).alias("id"), "value")


@query(f"WITH {OBJECTS} SELECT id AS label, '{{\"label\":' || id || ',\"voxels\":' || voxels || ',\"ez\":' || ez || '}}' AS value FROM objects")
def manifest_lines(spark, d):
    return N.manifest_lines(objects(spark, d).withColumnRenamed("id", "label"), "voxels", "ez")


@query(f"WITH {OBJECTS}, f AS (SELECT id, row_number() OVER (ORDER BY voxels DESC, id) AS label FROM objects WHERE voxels BETWEEN 1500 AND 180000 AND cz BETWEEN 45 AND 300 AND cy BETWEEN 45 AND 440 AND cx BETWEEN 80 AND 575) SELECT id, label FROM f WHERE label <= 33")
def library_items(spark, d):
    return N.library_items(objects(spark, d)).select("id", "label")


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 END AS n, CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 11 END AS y1 FROM part")
def roi_texts(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("1 2 3 4 5 6  0 0 0 9 "), k + 11, F.lit(" 9"))).when(k % 3 == 1, " ").otherwise("1 2 3 4 5 x")
    r = N.parsed_rois(text)
    return table(spark, d, "part").select(k.alias("id"), F.when(r.isNotNull(), F.size(r)).cast("long").alias("n"), F.try_element_at(r, F.lit(2))["y1"].alias("y1"))


@query(
    f"""WITH RECURSIVE {PTS}, s AS (SELECT volume_id, id, x, y, id * 37 % 101 AS voxels FROM pts), o AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY voxels DESC, id) AS n FROM s),
f AS (SELECT DISTINCT volume_id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[]) AS kept FROM o
 UNION ALL SELECT f.volume_id, o.n, CASE WHEN len(list_filter(f.kept, lambda k: sqrt((k.x - o.x) ** 2 + (k.y - o.y) ** 2) < 5)) = 0 THEN list_append(f.kept, {{'id': CAST(o.id AS BIGINT), 'x': o.x, 'y': o.y}}) ELSE f.kept END FROM f JOIN o ON o.volume_id = f.volume_id AND o.n = f.n + 1),
l AS (SELECT volume_id, list_transform(arg_max(kept, n), lambda k: k.id) AS ids FROM f GROUP BY volume_id), k AS (SELECT o.volume_id, o.id, list_contains(ids, o.id) AS kept FROM o JOIN l USING (volume_id))
SELECT volume_id, id, CASE WHEN kept THEN row_number() OVER (PARTITION BY volume_id, kept ORDER BY id) ELSE 0 END AS label FROM k"""
)
def pruned_instances(spark, d):
    p = points(spark, d).select("volume_id", "id", "x", "y", (F.col("id") * 37 % 101).alias("voxels"))
    return N.pruned_instances(p, "volume_id", 5.0).select("volume_id", "id", "label")


@query(f"WITH {VOX} SELECT CAST(min(v) AS BIGINT) AS lo, CAST(max(v) AS BIGINT) AS hi FROM vox WHERE v <> (SELECT max(v) FROM vox)")
def scalar_range_sentinel(spark, d):
    v = vox(spark, d)
    top = v.agg(F.max("v")).head()[0]
    return V.scalar_range(v, top or 0).select(F.col("lo").cast("long"), F.col("hi").cast("long"))


@query(f"WITH {VOX} SELECT p_partkey AS id, coalesce(v, 0) AS v FROM part LEFT JOIN vox ON x = p_partkey % 30 AND y = p_partkey % 25 AND z = p_partkey % 5")
def voxel_values(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(F.lit(0).cast("long").alias("volume_id"), k.alias("id"), (k % 30).alias("x"), (k % 25).alias("y"), (k % 5).alias("z"))
    return V.value_at(vox(spark, d), p).select("id", "v")




_WAY = "'r/' || r_regionkey || ' > n/' || n_nationkey || '.json > c/' || c_custkey || '.json'"


@query(
    f"""WITH c AS (SELECT r_regionkey, n_nationkey, c_custkey, c_name, {_WAY} AS way FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey)
SELECT 'o/' || o_orderkey || '.txt' AS path, 'order ' || o_orderkey AS label, way AS lineage, CAST(NULL AS VARCHAR) AS error, CAST(length(o_orderpriority) AS BIGINT) AS bytes FROM orders JOIN c ON c_custkey = o_custkey
UNION ALL SELECT 'n/' || n_nationkey || '.json', 'back', way, 'E_CYCLE', NULL FROM c
UNION ALL SELECT 'x/' || c_custkey, c_name, way, 'E_MISSING', NULL FROM c WHERE c_custkey % 10 = 0"""
)
def import_tree(spark, d):
    """Regions as collections of nations, nations as manifests of customers, and customers as manifests of orders."""
    from voxloom.sources import tree

    def at(kind: str, key: str, ending: str):
        return F.concat(F.lit(f"{kind}/"), F.col(key).cast("string"), F.lit(ending))

    def entries(df, key: str, url, name):
        e = F.struct(url.alias("url"), name.alias("name"))
        return df.groupBy(key).agg(F.array_sort(F.collect_list(e)).alias("files"))

    def manifest(df, path, files, name=None):
        cols = [*([name.alias("name")] if name is not None else []), files.alias("files")]
        return df.select(path.alias("path"), F.to_json(F.struct(*cols)).cast("binary").alias("content"), F.lit(None).cast("array<string>").alias("children"))

    region, nation, customer, orders = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    of_region = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(at("n", "n_nationkey", ".json"))).alias("children"))
    roots = region.join(of_region, F.col("r_regionkey") == F.col("n_regionkey")).select(at("r", "r_regionkey", "").alias("path"), F.lit(None).cast("binary").alias("content"), "children")
    of_nation = entries(customer, "c_nationkey", at("c", "c_custkey", ".json"), F.lit(None).cast("string"))
    of_customer = entries(orders, "o_custkey", at("o", "o_orderkey", ".txt"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")))
    own = customer.join(of_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
    entry = "array<struct<url:string,name:string>>"
    back = F.array(F.struct(at("n", "c_nationkey", ".json").alias("url"), F.lit("back").alias("name")))
    lost = F.when(F.col("c_custkey") % 10 == 0, F.array(F.struct(at("x", "c_custkey", "").alias("url"), F.lit(None).cast("string").alias("name")))).otherwise(F.array().cast(entry))
    files_ = F.concat(F.coalesce("files", F.array().cast(entry)), back.cast(entry), lost.cast(entry))
    store = manifest(of_nation, at("n", "c_nationkey", ".json"), F.col("files"))
    store = store.unionByName(manifest(own, at("c", "c_custkey", ".json"), files_, F.col("c_name")))
    store = store.unionByName(orders.select(at("o", "o_orderkey", ".txt").alias("path"), F.encode("o_orderpriority", "UTF-8").alias("content"), F.lit(None).cast("array<string>").alias("children")))
    got = tree.import_tree(roots, store)
    return got.select("path", "label", F.array_join("lineage", " > ").alias("lineage"), "error", F.length("content").cast("long").alias("bytes"))
