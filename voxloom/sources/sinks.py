"""Text and file contents of results as columns and rows, written by Spark's writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions.geometry import once
from voxloom.functions.text import csv_text, escape_html, volume_text

_HEAD = "label,name,fdi,voxels,volume_mm3,status,score,reasons"


def report_csv(items: DataFrame) -> DataFrame:
    """One text column ``value``, to be written with ``.write.text``; the header is the row with line 0."""
    cell = F.concat_ws(
        ",", F.col("label").cast("string"), csv_text(F.col("name")), F.coalesce(F.col("fdi").cast("string"), F.lit("")), F.col("voxels").cast("string"),
        F.format_string("%.1f", F.col("volume_mm3").cast("double")), F.col("quality_status"), F.col("quality_score").cast("string"), csv_text(F.array_join("quality_reasons", "; ")),
    )
    head = items.sparkSession.createDataFrame([(0, _HEAD)], "line long, value string")
    return head.unionByName(items.select((F.col("label").cast("long") + 1).alias("line"), cell.alias("value")))


def report_rows_html(items: DataFrame) -> DataFrame:
    td = lambda c: F.concat(F.lit("<td>"), escape_html(c), F.lit("</td>"))
    return items.select("label", F.concat(F.lit("<tr>"), td(F.col("name")), td(volume_text(F.col("volume_mm3").cast("double"))), td(F.col("quality_status")), F.lit("</tr>")).alias("value"))


#: Style of the report (fixed text).
_STYLE = """  body { font: 14px sans-serif; margin: 2rem; }
  table { border-collapse: collapse; width: 100%; }
  th, td { border: 1px solid #e2e8f0; padding: 6px 8px; text-align: left; }
  .review { font-weight: 600; }"""
REPORT_COLUMNS = ("Label", "FDI", "Voxels", "Volume", "Centroid (z, y, x)", "Quality", "Notes")


def _thousands(n: Column) -> Column:
    return F.format_number(n.cast("long"), 0)


def report_html(items: DataFrame, scans: DataFrame, by: str = "scan_id", title: str = "Tooth separation report", note: str = "Reference only.") -> DataFrame:
    """(by, value): a page for each scan of ``scans`` (by, source_label, algorithm, candidates; any of them null), with a table of its items.

    ``items``: (by, label, fdi, fdi_name, voxels, volume_mm3, cz, cy, cx, quality_status, quality_reasons). All texts are escaped; a
    status that is missing counts as accepted, other missing values are a dash. A scan's items are few: each is a string of its page.
    """
    dash, text = F.lit("\u2014"), lambda c: escape_html(F.coalesce(c, F.lit("")))
    status = F.coalesce("quality_status", F.lit("accepted"))
    fdi = F.when(F.col("fdi").isNotNull(), F.rtrim(F.concat(F.col("fdi").cast("string"), F.lit(" "), text(F.col("fdi_name"))))).otherwise(dash)
    center = F.concat_ws(", ", *(F.floor(F.col(c) + 0.5).cast("string") for c in ("cz", "cy", "cx")))
    cells = [F.col("label").cast("string"), fdi, _thousands(F.col("voxels")), F.coalesce(volume_text(F.col("volume_mm3").cast("double")), dash), center]
    td = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), *map(td, cells), F.lit('<td class="'), text(status), F.lit('">'), text(status), F.lit("</td>"), td(text(F.array_join("quality_reasons", ", "))), F.lit("</tr>"))
    rows = items.withColumn("_row", F.struct(F.col("label").alias("label"), row.alias("row")))
    rows = rows.groupBy(by).agg(F.array_sort(F.collect_list("_row")).alias("rows"), F.count(F.lit(1)).alias("n"), F.count_if(status == "accepted").alias("accepted"), F.sum(F.col("volume_mm3").cast("double")).alias("volume"))
    s = scans.join(rows, by, "left")
    line = lambda name, c: F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  <div>{name}: "), text(c.cast("string")), F.lit("</div>\n"))).otherwise("")
    count = lambda c, name: F.concat(F.lit("<strong>"), F.coalesce(c, F.lit(0)).cast("string"), F.lit(f"</strong> {name}"))
    total = F.when(F.col("volume").isNotNull(), F.concat(F.lit(" \u00b7 total volume "), volume_text(F.col("volume")))).otherwise("")
    body = F.array_join(F.transform(F.coalesce("rows", F.array().cast("array<struct<label:bigint,row:string>>")), lambda r: r["row"]), "\n")
    page = F.concat(
        F.lit('<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8" />\n<title>'), text(F.lit(title)), F.lit(" \u2014 "), text(F.col(by).cast("string")), F.lit(f"</title>\n<style>\n{_STYLE}\n</style>\n</head>\n<body>\n  <h1>"), text(F.lit(title)), F.lit("</h1>\n"),
        line("Scan", F.col(by)), line("Source", F.col("source_label")), line("Method", F.col("algorithm")),
        F.lit(f"  <p>{note}</p>\n  <p>"), count(F.col("n"), "items"), F.lit(" \u00b7 "), count(F.col("accepted"), "accepted"), F.lit(" \u00b7 "), count(F.col("candidates"), "candidates"), total, F.lit("</p>\n"),
        F.lit("  <table>\n<tr>" + "".join(f"<th>{c}</th>" for c in REPORT_COLUMNS) + "</tr>\n"), body, F.lit("\n  </table>\n</body>\n</html>"),
    )
    return s.select(by, page.alias("value"))


def transform_text(m: Column) -> Column:
    """Text of a row-major 4 x 4 affine as twelve parameters and a fixed centre at the origin."""
    order = [0, 1, 2, 4, 5, 6, 8, 9, 10, 3, 7, 11]
    return F.concat(
        F.lit("#Insight Transform File V1.0\n#Transform 0\nTransform: AffineTransform_double_3_3\nParameters: "),
        once(m, lambda v: F.concat_ws(" ", *(v[k].cast("string") for k in order))),
        F.lit("\nFixedParameters: 0 0 0\n"),
    )


def parse_transform(text: Column) -> Column:
    """Row-major 4 x 4 affine of such a text, its centre folded into the translation; null if it has none."""
    at = lambda a, k: F.try_element_at(a, F.lit(k + 1))

    def nums(t: Column, name: str) -> Column:
        return F.transform(F.split(F.trim(F.regexp_extract(t, rf"(?m)^{name}:([^\n]*)", 1)), r"\s+"), lambda x: x.try_cast("double"))

    def matrix(n: Column) -> Column:
        p, c = n["p"], n["c"]
        r = lambda i, j: at(p, 3 * i + j)
        row = lambda i: [r(i, 0), r(i, 1), r(i, 2), at(p, 9 + i) + at(c, i) - (r(i, 0) * at(c, 0) + r(i, 1) * at(c, 1) + r(i, 2) * at(c, 2))]
        return F.when(F.size(p) >= 12, F.array(*row(0), *row(1), *row(2), *(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0))))

    origin = F.array(*(F.lit(0.0),) * 3)
    center = lambda t: once(nums(t, "FixedParameters"), lambda c: F.coalesce(F.when(F.size(c) >= 3, c), origin))
    return once(text, lambda t: once(F.struct(nums(t, "Parameters").alias("p"), center(t).alias("c")), matrix))


_MARKUPS = "struct<markups:array<struct<type:string,coordinateSystem:string,controlPoints:array<struct<id:string,label:string,description:string,position:array<double>>>>>>"


def landmarks(documents: DataFrame, json_col: str, key: str) -> DataFrame:
    """(key, ord, id, label, description, x, y, z, system) of landmark documents, in left-posterior-superior axes."""
    j = documents.select(key, F.from_json(json_col, _MARKUPS[7:-1].replace("markups:", "markups ", 1)).alias("j"))
    system = F.coalesce(F.col("j.markups")[0]["coordinateSystem"], F.lit("LPS"))
    p = j.select(key, system.alias("system"), F.posexplode(F.flatten(F.transform("j.markups", lambda m: m["controlPoints"]))).alias("ord", "p"))
    sign = F.when(F.col("system").isin("RAS", "0"), -1.0).otherwise(1.0)
    return p.select(key, "ord", "p.id", "p.label", "p.description", (F.col("p.position")[0] * sign).alias("x"), (F.col("p.position")[1] * sign).alias("y"), F.col("p.position")[2].alias("z"), "system")


def landmark_json(points: DataFrame, key: str) -> DataFrame:
    """(key, value): landmark documents of (key, ord, id, label, description, x, y, z); a set has tens of points."""
    point = F.struct("ord", F.struct("id", "label", "description", F.array("x", "y", "z").alias("position")).alias("p"))
    g = points.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(point)), lambda s: s["p"]).alias("controlPoints"))
    markup = F.struct(F.lit("Fiducial").alias("type"), F.lit("LPS").alias("coordinateSystem"), "controlPoints")
    return g.select(key, F.to_json(F.struct(F.array(markup).alias("markups"))).alias("value"))
