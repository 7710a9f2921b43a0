"""Project archives: packing masks, label maps and surfaces with their manifest, and reading them back."""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.operators.catalogue import project_manifest
from voxloom.operators.workflows import archive_paths
from voxloom.sources.files import expand_zips

MANIFEST_NAME = "study.json"  # fixed value
#: Folder and ending of each kind of file (fixed values).
KINDS = {"mask": ("masks", "bin"), "labelmap": ("labelmaps", "uint16.raw"), "surface": ("surfaces", "stl")}


def project_archives(projects: DataFrame, parts: DataFrame, app: str, version: int = 2) -> DataFrame:
    """(project, content): a zip of each project's files and their manifest.

    ``projects`` is (project, exported_at, state: JSON), ``parts`` is (project, kind, ord, id, content). Paths are made
    from ids, numbered where two are alike. One task writes one archive: its files are gathered there.
    """
    named = None
    for kind, (folder, ending) in KINDS.items():
        some = parts.where(F.col("kind") == kind)
        path = archive_paths(some.select("project", "ord", "id", "content"), folder, "id", ending, by=["project"])
        some = path.select("project", F.lit(kind).alias("kind"), "ord", "id", "path", "content")
        named = some if named is None else named.unionByName(some)
    rows = projects.join(named, "project", "left")

    def pack(group: pa.Table) -> pa.Table:
        r = sorted((x for x in group.to_pylist() if x["path"] is not None), key=lambda x: (x["kind"], x["ord"]))
        head = group.slice(0, 1).to_pylist()[0]
        entry = lambda x: {"id": x["id"], "path": x["path"], "bytes": len(x["content"])}
        lists = {f"{k}s": [entry(x) for x in r if x["kind"] == k] for k in KINDS}
        sources = [e | {"kind": "embedded", "role": k} for k in KINDS for e in lists[f"{k}s"]]
        text = json.dumps({"version": version, "app": app, "exportedAt": head["exported_at"], "dataSources": sources, "state": json.loads(head["state"] or "{}"), **lists}, indent=2)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(MANIFEST_NAME, text)
            for x in r:
                z.writestr(x["path"], x["content"])
        return pa.table({"project": [head["project"]], "content": pa.array([out.getvalue()], pa.binary())})

    return rows.groupBy("project").applyInArrow(pack, "project string, content binary")


def read_projects(archives: DataFrame, app: str) -> tuple[DataFrame, DataFrame]:
    """(project, manifest, error) and (project, kind, id, content, error) of archives (project, content).

    A file that is missing has E_MISSING, one of another length than the manifest says E_BYTES.
    """
    inside = expand_zips(archives.select(F.concat("project", F.lit(".zip")).alias("path"), "content"))
    inside = inside.select(F.split("path", "/")[0].alias("project"), F.regexp_replace("path", "^[^/]*/", "").alias("path"), "content")
    text = inside.where(F.col("path") == MANIFEST_NAME).select("project", F.decode("content", "utf-8").alias("json"))
    found = project_manifest(archives.select("project").join(text, "project", "left"), "json", app)
    whole = found.select("project", "manifest", F.when(F.col("json").isNull(), "E_MANIFEST").otherwise(F.col("error")).alias("error"))
    entries = None
    for kind in KINDS:
        e = whole.where("error is null").select("project", F.lit(kind).alias("kind"), F.explode(f"manifest.{kind}s").alias("e")).select("project", "kind", "e.id", "e.path", "e.bytes")
        entries = e if entries is None else entries.unionByName(e)
    read = entries.join(inside, ["project", "path"], "left")
    error = F.when(F.col("content").isNull(), "E_MISSING").when(F.length("content") != F.col("bytes"), "E_BYTES")
    return whole, read.select("project", "kind", "id", "content", error.alias("error"))


def restored(parts: DataFrame, images: DataFrame) -> DataFrame:
    """``parts`` (project, kind, content) with error E_SIZE where a mask has not one byte, or a label map two, for each voxel of the project's image (project, voxels)."""
    need = F.when(F.col("kind") == "mask", F.col("voxels")).when(F.col("kind") == "labelmap", F.col("voxels") * 2)
    bad = F.when(need.isNotNull() & (F.length("content") != need), "E_SIZE").when(F.col("kind").isin("mask", "labelmap") & F.col("voxels").isNull(), "E_IMAGE")
    return parts.join(images, "project", "left").withColumn("error", F.coalesce("error", bad)).drop("voxels")
