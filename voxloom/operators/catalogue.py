"""The study catalogue: rows made, listed and merged; study states with their defaults; manifests and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.objects import live

#: Defaults of a study's state (fixed values).
MASK_OPACITY, GROUP_OPACITY = 0.45, 0.6
BRUSH = {"brushShape": "circle", "brushSizeMm": 2.0, "operation": "draw", "watershedSeedKind": "foreground"}
THRESHOLD_RANGE = (300.0, 3000.0)
NOTE_COLOR, TOOL, ENGINES, LAYOUT = "#38bdf8", "crosshair", ("custom", "itk-gdcm"), "mpr-3d"

_NOTE = "struct<id:string,studyId:string,kind:string,name:string,point:array<double>,text:string,measurementId:string,color:string,visible:boolean,selected:boolean,createdAt:bigint,updatedAt:bigint>"
STATE = f"struct<annotations:array<{_NOTE}>,activeTool:string,dicomImportEngine:string,layoutPreset:string,maskWorkflow:struct<brushShape:string,brushSizeMm:double,operation:string,thresholdRange:array<double>,watershedSeedKind:string>>"
_FILE = "struct<id:string,path:string,bytes:bigint>"
MANIFEST = f"struct<version:int,app:string,exportedAt:string,dataSources:array<struct<id:string,kind:string,role:string,path:string,bytes:bigint>>,masks:array<{_FILE}>,labelmaps:array<{_FILE}>,surfaces:array<{_FILE}>,state:{STATE}>"


def app_id(prefix: str) -> Column:
    """``prefix_`` and a random unique id."""
    return F.concat(F.lit(f"{prefix}_"), F.uuid())


def created(inputs: DataFrame, now: Column, ids: Column, status: str | None = None) -> DataFrame:
    """New rows of ``inputs``: id, both times ``now``, not deleted, and a status if one is given."""
    made = {"id": ids, "created_at": now, "updated_at": now, "deleted_at": F.lit(None).cast("long")}
    return inputs.withColumns(made | ({"status": F.lit(status)} if status else {}))


def by_id(rows: DataFrame, key) -> DataFrame:
    """The live row of an id, if any: the filter reaches the scan."""
    return live(rows.where(F.col("id") == key))


def listed(rows: DataFrame, owner: str | None = None) -> DataFrame:
    """Rows never deleted: of one owner by falling time of creation, or of all by falling time of change."""
    kept = rows.where(F.col("deleted_at").isNull())
    return kept.where(F.col("owner_id") == owner).orderBy(F.desc("created_at")) if owner else kept.orderBy(F.desc("updated_at"))


def upserted(rows: DataFrame, new: DataFrame, now: Column, key: str = "id") -> DataFrame:
    """``rows`` after ``new`` (key and values) replaces or joins them; what is there already keeps its created_at."""
    old = rows.select(key, F.col("created_at").alias("_since"))
    put = new.join(old, key, "left").withColumns({"created_at": F.coalesce("_since", now), "updated_at": now}).select(*rows.columns)
    return rows.join(new.select(key), key, "left_anti").unionByName(put)


def normal_state(text: Column) -> Column:
    """A study state from JSON with its defaults: notes without id, study, name or point go, and unknown engines are the first."""
    s = F.from_json(text, STATE)
    whole = F.filter(F.coalesce(s["annotations"], F.array().cast(f"array<{_NOTE}>")), lambda n: (F.coalesce(n["id"], F.lit("")) != "") & (F.coalesce(n["studyId"], F.lit("")) != "") & (F.coalesce(n["name"], F.lit("")) != "") & n["point"].isNotNull())
    notes = F.transform(
        whole,
        lambda n: F.struct(
            n["id"].alias("id"), n["studyId"].alias("studyId"), F.coalesce(n["kind"], F.lit("point")).alias("kind"), n["name"].alias("name"), n["point"].alias("point"), F.coalesce(n["text"], n["name"]).alias("text"),
            F.coalesce(n["color"], F.lit(NOTE_COLOR)).alias("color"), F.coalesce(n["visible"], F.lit(True)).alias("visible"), F.coalesce(n["selected"], F.lit(False)).alias("selected"),
        ),
    )
    flow = s["maskWorkflow"]
    brush = F.struct(*(F.coalesce(flow[k], F.lit(v)).alias(k) for k, v in BRUSH.items()), F.coalesce(flow["thresholdRange"], F.array(*map(F.lit, THRESHOLD_RANGE))).alias("thresholdRange"))
    engine = F.when(s["dicomImportEngine"] == ENGINES[1], ENGINES[1]).otherwise(ENGINES[0])
    return F.struct(notes.alias("annotations"), F.coalesce(s["activeTool"], F.lit(TOOL)).alias("activeTool"), engine.alias("dicomImportEngine"), F.coalesce(s["layoutPreset"], F.lit(LAYOUT)).alias("layoutPreset"), brush.alias("maskWorkflow"))


def project_manifest(rows: DataFrame, text: str, app: str, version: int = 2) -> DataFrame:
    """``rows`` with ``manifest`` (null if refused) and ``error`` of a project's JSON; version 1 is brought to version 2.

    Version 1 lists its files by kind alone: they become embedded sources, and there are no label maps.
    """
    m = F.from_json(F.col(text), MANIFEST)
    none = F.array().cast(f"array<{_FILE}>")
    source = lambda kind: lambda e: F.struct(e["id"].alias("id"), F.lit("embedded").alias("kind"), F.lit(kind).alias("role"), e["path"].alias("path"), e["bytes"].alias("bytes"))
    out = rows.withColumn("_m", m).withColumn("_old", F.coalesce(F.col("_m.version") == 1, F.lit(False)))
    old, got = F.col("_old"), F.col("_m")
    moved = F.concat(F.transform(got["masks"], source("mask")), F.transform(got["surfaces"], source("surface")))
    out = out.withColumn("_sources", F.when(old, moved).otherwise(got["dataSources"]))
    out = out.withColumn("_labelmaps", F.when(old, none).otherwise(F.coalesce(got["labelmaps"], none)))
    lists = {"mask": got["masks"], "labelmap": F.col("_labelmaps"), "surface": got["surfaces"]}
    whole = lambda a: a.isNotNull() & F.forall(a, lambda e: e["id"].isNotNull() & e["path"].isNotNull() & F.coalesce(e["bytes"] >= 0, F.lit(False)))
    plain = lambda p: F.array_join(F.filter(F.split(F.translate(p, "\\", "/"), "/"), lambda x: ~x.isin("", ".", "..")), "/")
    unsafe = F.exists(F.concat(*(F.coalesce(a, none) for a in lists.values())), lambda e: (plain(e["path"]) == "") | (plain(e["path"]) != F.translate(e["path"], "\\", "/")))
    error = F.when(~F.coalesce((old | (got["version"] == version)) & (old | (got["app"] == app)), F.lit(False)), "version").when(F.get_json_object(text, "$.state").isNull(), "state")
    for kind, a in lists.items():
        error = error.when(~F.coalesce(whole(a), F.lit(False)), kind)
    error = error.when(F.col("_sources").isNull(), "sources").when(unsafe, "path")
    manifest = F.struct(F.lit(version).alias("version"), got["exportedAt"].alias("exportedAt"), F.col("_sources").alias("dataSources"), got["masks"].alias("masks"), F.col("_labelmaps").alias("labelmaps"), got["surfaces"].alias("surfaces"), normal_state(F.get_json_object(text, "$.state")).alias("state"))
    out = out.withColumn("error", error)
    return out.withColumn("manifest", F.when(F.col("error").isNull(), manifest)).drop("_m", "_old", "_sources", "_labelmaps")


def remote_entries(rows: DataFrame, text: str) -> DataFrame:
    """(columns of ``rows`` but ``text``, ord, url, name, mime) of the entries of remote manifests; no rows for other texts.

    Entries stand under files or, without it, under resources, and all of them need a url.
    """
    entry = "array<struct<url:string,name:string,mime:string>>"
    j = F.from_json(text, f"struct<name:string,files:{entry},resources:{entry}>")
    e = F.coalesce(j["files"], j["resources"])
    r = rows.withColumn("_e", e).where(F.col("_e").isNotNull() & F.forall("_e", lambda x: x["url"].isNotNull()))
    return r.select(*(c for c in rows.columns if c != text), F.posexplode("_e").alias("ord", "_x")).select(*(c for c in rows.columns if c != text), "ord", "_x.url", "_x.name", "_x.mime")


def range_total(header: Column) -> Column:
    """Total length that a Content-Range header states."""
    return F.nullif(F.regexp_extract(header, r"/(\d+)\s*$", 1), F.lit("")).cast("long")


def scan_id(preferred: Column, reconstruction: Column, date: Column, time: Column, study: Column, label: Column) -> Column:
    """Id of a scan: the first that is there of a given one, a reconstruction's, date and time, the study's, the folder's name."""
    some = lambda c: F.nullif(c, F.lit(""))
    short = some(F.substring(F.regexp_replace(F.coalesce(time, F.lit("")), r"\..*$", ""), 1, 6))
    stamp = F.when(some(date).isNotNull() & short.isNotNull(), F.concat(F.lit("CT_"), date, short))
    return F.coalesce(some(preferred), some(reconstruction), stamp, some(study), some(label), F.lit("CT"))


def uploaded(entries: DataFrame) -> DataFrame:
    """``entries`` (path) with label, their root folder; error E_DIRECTORY_UPLOAD where no path has a folder."""
    if entries.where(F.col("path").contains("/")).take(1):
        return entries.withColumns({"label": F.split("path", "/")[0], "error": F.lit(None).cast("string")})
    return entries.withColumns({"label": F.lit(None).cast("string"), "error": F.lit("E_DIRECTORY_UPLOAD")})


def modal_series(headers: DataFrame, *keys: str) -> DataFrame:
    """Rows of the commonest combination of ``keys``; the first in order on ties."""
    n = headers.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), *keys).limit(1)
    return headers.join(F.broadcast(n.drop("_n")), list(keys), "left_semi")


def modalities(headers: DataFrame, *by: str) -> DataFrame:
    """Distinct modalities in order, and what is said of a folder that has no slice stack."""
    g = headers.groupBy(*by).agg(F.array_sort(F.collect_set(F.nullif(F.col("modality"), F.lit("")))).alias("modalities"), F.coalesce(F.max(F.col("frames") > 1), F.lit(False)).alias("multi"))
    other = (F.size("modalities") > 0) & ~F.array_contains("modalities", "CT")
    return g.withColumn("problem", F.when(other, "E_MODALITY").when(F.col("multi"), "E_MULTIFRAME").otherwise("E_GEOMETRY"))


def manifest_checks(items: DataFrame, labelmap: DataFrame, stated: int, min_labels: int = 10, min_accepted: int = 8, most_off: float = 0.015) -> DataFrame:
    """(name, ok): what has to hold between a manifest's items and its label volume.

    ``items`` has label, assigned_voxels, quality_status, bbox (z0, y0, x0, z1, y1, x1), centroid and extent.
    The label volume is read once, into one row a label.
    """
    seen = labelmap.where("label > 0").groupBy("label").agg(F.count(F.lit(1)).alias("seen"), F.array(*(F.min(c) for c in "zyx"), *(F.max(c) + 1 for c in "zyx")).cast("array<bigint>").alias("box"))
    both = items.select("label", "assigned_voxels", "quality_status", F.col("bbox").cast("array<bigint>").alias("bbox"), F.size("centroid").alias("nc"), F.size("extent").alias("ne"), F.lit(True).alias("item")).join(seen, "label", "full_outer")
    item, off = F.col("item").isNotNull(), F.abs(F.coalesce("seen", F.lit(0)) - F.col("assigned_voxels")) / F.greatest("assigned_voxels", F.lit(1))
    n = F.count_if(item)
    every = lambda c: F.count_if(item & ~F.coalesce(c, F.lit(False))) == 0
    checks = {
        "accepted-count": n == stated,
        "min-labels": n >= min_labels,
        "min-accepted": F.count_if(item & (F.coalesce("quality_status", F.lit("accepted")) == "accepted")) >= min_accepted,
        "sequential-labels": (n == F.count_distinct(F.when(item, F.col("label")))) & (n == 0) | ((F.min(F.when(item, F.col("label"))) == 1) & (F.max(F.when(item, F.col("label"))) == n) & (n == F.count_distinct(F.when(item, F.col("label"))))),
        "same-labels": F.count_if(F.col("item").isNull() | F.col("seen").isNull()) == 0,
        "positive-voxels": F.coalesce(F.sum("seen"), F.lit(0)) == F.coalesce(F.sum("assigned_voxels"), F.lit(0)),
        "assigned": every(F.col("assigned_voxels") > 0),
        "centroid": every(F.col("nc") == 3),
        "bbox": every(F.size("bbox") == 6),
        "extent": every(F.col("ne") == 3),
        "voxel-count": every(off <= most_off),
        "measured-bbox": every(F.col("box") == F.col("bbox")),
    }
    row = both.agg(*(F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()))
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(f"`{k}`").alias("ok")) for k in checks))).alias("c")).select("c.*")


def without_measurements(measurements: DataFrame, annotations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after the measurements of ``gone`` (id) are deleted, with the annotations that belong to them (measurement_id)."""
    return measurements.join(gone.select("id"), "id", "left_anti"), annotations.join(gone.select(F.col("id").alias("measurement_id")), "measurement_id", "left_anti").select(annotations.columns)
