"""Trees of sources: files, archives, manifests and collections, followed until only files are left, with their lineage."""

from __future__ import annotations

import json
import zipfile
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.text import extension, normal_path
from voxloom.operators.staging import written

_NODE = "path string, content binary, children array<string>, label string, lineage array<string>, error string"
ROWS, BYTES = 4_000, 16_000_000  # of children that a task hands on together
_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def _opened(batches):
    """The children of archives and manifests; an archive that cannot be read comes back with an error."""

    def row(path, content, label, lineage, error=None):
        return {"path": path, "content": content, "children": None, "label": label, "lineage": lineage, "error": error}

    shape = pa.schema([("path", pa.string()), ("content", pa.binary()), ("children", pa.list_(pa.string())), ("label", pa.string()), ("lineage", pa.list_(pa.string())), ("error", pa.string())])

    def children(r):
        below = [*r["lineage"], r["path"]]
        if r["kind"] == "manifest":
            got = json.loads(r["content"])
            for e in got.get("files") or got.get("resources") or []:
                yield row(e["url"], None, e.get("name") or got.get("name") or r["label"], below)
            return
        try:
            with zipfile.ZipFile(pa.BufferReader(r["content"])) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield row(f"{r['path'].removesuffix('.zip')}/{i.filename}", z.read(i), r["label"], below)
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError):
            yield row(r["path"], None, r["label"], r["lineage"], "E_ARCHIVE")

    held, size = [], 0
    for b in batches:
        for r in b.to_pylist():
            for child in children(r):
                held.append(child)
                size += len(child["content"] or b"")
                if len(held) >= ROWS or size >= BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=shape)
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=shape)


def _kind(nodes: DataFrame) -> DataFrame:
    """``nodes`` with their kind: error, collection (it names children), archive, manifest (JSON with entries that all have a url), or file."""
    entry = "array<struct<url:string,name:string>>"
    j = F.from_json(F.when(extension(F.col("path")) == ".json", F.col("content").cast("string")), f"struct<files:{entry},resources:{entry}>")
    e = F.coalesce(j["files"], j["resources"])
    manifest = F.coalesce(e.isNotNull() & F.forall(e, lambda x: x["url"].isNotNull()), F.lit(False))
    zipped = (extension(F.col("path")) == ".zip") | (F.substring("content", 1, 4) == F.lit(b"PK\x03\x04"))
    kind = F.when(F.col("error").isNotNull(), "error").when(F.col("children").isNotNull(), "collection").when(F.coalesce(zipped, F.lit(False)), "archive").when(manifest, "manifest").otherwise("file")
    return nodes.withColumn("kind", kind)


def import_tree(sources: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """(path, content, source, label, lineage, error) of the files that ``sources`` (path, content, and perhaps children) lead to.

    Archives hold their files; manifests and collections name theirs, whose contents are those of ``store`` (path, content, and perhaps
    children). ``lineage`` is the way from the source to the file, ``label`` the name that was last given on it. What cannot be followed is a row with an error:
    E_ARCHIVE, E_MISSING (not in the store), E_CYCLE (a path on its own way, which is not followed). Rounds go down one level
    each, and each is written; a file reached on several ways has a row for each.
    """
    none = F.lit(None).cast("array<string>")

    def made(df: DataFrame) -> DataFrame:
        return df if "children" in df.columns else df.withColumn("children", none)

    def path(df: DataFrame) -> DataFrame:
        return df.withColumn("path", F.when(F.col("path").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), F.col("path")).otherwise(normal_path(F.col("path"))))

    known = None if store is None else path(made(store)).select(F.col("path").alias("_at"), F.col("content").alias("_content"), F.col("children").alias("_children"))
    level = path(made(sources)).select("path", "content", "children", F.lit(None).cast("string").alias("label"), F.array().cast("array<string>").alias("lineage"), F.lit(None).cast("string").alias("error"))
    out = None
    while True:
        here = written(_kind(level), "tree-level")
        done = here.where("kind in ('file', 'error')").select(*_NAMES)
        out = done if out is None else out.unionByName(done)
        inner = here.where("kind in ('archive', 'manifest', 'collection')")
        if not inner.take(1):
            break
        packed = inner.where("kind <> 'collection'").select("path", "content", "label", "lineage", "kind").mapInArrow(_opened, _NODE)
        below = F.concat("lineage", F.array("path"))
        named = inner.where("kind = 'collection'").select(F.explode("children").alias("_child"), "label", below.alias("lineage"))
        named = named.select(F.col("_child").alias("path"), F.lit(None).cast("binary").alias("content"), none.alias("children"), "label", "lineage", F.lit(None).cast("string").alias("error"))
        kids = path(packed.unionByName(named))
        cycle = F.col("error").isNull() & F.array_contains("lineage", F.col("path"))
        kids = kids.withColumn("error", F.when(cycle, "E_CYCLE").otherwise(F.col("error")))
        open_ = F.col("content").isNull() & F.col("error").isNull()
        if known is not None:
            found = kids.where(open_).join(known, F.col("path") == F.col("_at"), "left")
            found = found.select("path", F.col("_content").alias("content"), F.col("_children").alias("children"), "label", "lineage", F.when(F.col("_at").isNull(), "E_MISSING").alias("error"))
        else:
            found = kids.where(open_).withColumn("error", F.lit("E_MISSING"))
        level = kids.where(~open_).select(*_NAMES).unionByName(found.select(*_NAMES))
    return out.select("path", "content", F.coalesce(F.get("lineage", F.lit(0)), F.col("path")).alias("source"), "label", "lineage", "error")
