"""Quality of documents by co-training two views (operator 7).

One classifier sees the text's content (words and word shapes), the other the document's metadata
(source, language, length). Over some rounds each gives the other the labels it is sure of on
unlabelled documents; at the end both are calibrated on labelled documents kept aside, and their
calibrated log-odds are added to score all documents. The same is done for toxicity.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import slices_by_bytes, split_words, table

#: Bounds of the rows learned from (chosen by a hash of the id, about so many): labelled and unlabelled.
LABELLED, POOL = 6000, 3000
ROUNDS, SURE, SHARE = 3, 0.97, 0.1  # rounds; least confidence and largest part of the pool handed over in one
BITS = 18
CLEAR = 3.5  # deviations by which a feature's rows must differ from the mean to count
ASIDE = 5  # one labelled document in so many only calibrates


def _slot(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def _shape(w: str) -> str:
    """Runs of small letters, capitals and digits as one sign each; other signs as they are, once."""
    out = []
    for c in w:
        k = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def _words(text: pa.Array):
    offsets, codes, words = split_words(pc.replace_substring_regex(pc.fill_null(text, ""), r"\s", " "))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    some = np.fromiter((bool(w) for w in words), dtype=bool, count=len(words))
    keep = some[codes]
    plain = np.fromiter((_slot("w:" + "".join(c for c in w.lower() if c.isalnum())) for w in words), dtype=np.int64, count=len(words))
    shape = np.fromiter((_slot("s:" + _shape(w)) for w in words), dtype=np.int64, count=len(words))
    return doc[keep], codes[keep], plain, shape, len(offsets) - 1


def _repetition(doc: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of how much a text repeats: distinct words, words like the one before, the commonest word."""
    total = np.maximum(np.bincount(doc, minlength=n), 1)
    pair, times = np.unique((doc << 40) + code, return_counts=True)
    who = pair >> 40
    distinct = np.bincount(who, minlength=n) / total
    again = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (code[1:] == code[:-1])], minlength=n) / total if len(doc) else np.zeros(n)
    most = np.zeros(n)
    np.maximum.at(most, who, times)
    size = np.log2(total).astype(int)
    names = [[_slot(f"distinct:{int(d * 10)}:{min(z, 10)}"), _slot(f"again:{min(int(a * 40), 10)}"), _slot(f"most:{int(m / t * 20)}:{min(z, 6)}"), _slot(f"words:{z}")] for d, a, m, t, z in zip(distinct, again, most, total, size, strict=True)]
    return np.repeat(np.arange(n), 4), np.array(names, dtype=np.int64).reshape(-1), np.ones(4 * n)


def text_features(text: pa.Array, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value): 1 for a word that occurs, the part of the words with a shape, and repetition."""
    doc, code, plain, shape, n = _words(text)
    total = np.bincount(doc, minlength=n)
    rows, slots, values = ([x] for x in _repetition(doc, code, n))
    for kind, slot in enumerate((plain, shape)):
        s = slot[code]
        d = doc
        if used is not None:
            keep = used[s]
            s, d = s[keep], d[keep]
        at, times = np.unique(d * (1 << BITS) + s, return_counts=True)
        d, s = at >> BITS, at & ((1 << BITS) - 1)
        rows.append(d)
        slots.append(s)
        values.append(np.ones(len(d)) if kind == 0 else 4 * times / np.maximum(total[d], 1))
    return np.concatenate(rows), np.concatenate(slots), np.concatenate(values)


def meta_features(source: list, lang: list, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    slots = [[_slot(f"source:{s}"), _slot(f"lang:{g}"), _slot(f"length:{int(n).bit_length() if n is not None and n >= 0 else None}")] for s, g, n in zip(source, lang, n_chars, strict=True)]
    flat = np.array(slots, dtype=np.int64).reshape(-1, 3)
    return np.repeat(np.arange(len(flat)), 3), flat.ravel(), np.ones(flat.size)


@dataclass
class View:
    """A logistic model over hashed features, and its calibration."""

    weight: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS))
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, x, n: int) -> np.ndarray:
        row, slot, value = x
        return np.bincount(row, weights=self.weight[slot] * value, minlength=n) + self.bias

    def calibrated(self, x, n: int) -> np.ndarray:
        return np.clip(self.scale * self.raw(x, n) + self.shift, -12, 12)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_view(x, y: np.ndarray, w: np.ndarray, steps: int = 150, rate: float = 0.08, ridge: float = 2e-3) -> View:
    """Logistic regression on rows of weight ``w`` (0: left out).

    Only features whose share of positive rows differs from the mean by ``CLEAR`` deviations count;
    most words of a text are rare and would be learned by heart.
    """
    row, slot, value = x
    live = w[row] > 0
    row, slot, value = row[live], slot[live], value[live]
    share = float((w * y).sum() / max(w.sum(), 1e-9))
    seen = np.bincount(slot, weights=w[row], minlength=1 << BITS)
    good = np.bincount(slot, weights=(w * y)[row], minlength=1 << BITS)
    clear = np.abs(good - seen * share) >= CLEAR * np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    live = (clear & (seen >= 3))[slot]
    row, value = row[live], value[live]
    names, col = np.unique(slot[live], return_inverse=True)
    wt, bias = np.zeros(len(names)), 0.0
    mean = float((w * y).sum() / max(w.sum(), 1e-9))
    bias = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    m, v, mb, vb = np.zeros_like(wt), np.zeros_like(wt), 0.0, 0.0
    total = max(w.sum(), 1e-9)
    for t in range(1, steps + 1):
        err = w * (y - _sigmoid(np.bincount(row, weights=wt[col] * value, minlength=len(y)) + bias)) / total
        g = np.bincount(col, weights=err[row] * value, minlength=len(names)) - ridge * wt / 10
        gb = float(err.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        mb += 0.1 * (gb - mb)
        vb += 0.01 * (gb * gb - vb)
        wt += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        bias += rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    out = View()
    out.weight[names], out.bias = wt, bias
    return out


def _calibrate(view: View, x, n: int, y: np.ndarray, aside: np.ndarray) -> None:
    """Scale and shift of the raw score by logistic regression on the rows kept aside."""
    z, t = view.raw(x, n)[aside], y[aside]
    if not len(t):
        return
    # Platt's targets
    soft = np.where(t > 0.5, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * z + b)
        d, h = p - soft, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(d * z).sum() + 0.01 * (a - 1), d.sum() + 0.01 * b])
        hess = np.array([[(h * z * z).sum() + 0.01, (h * z).sum()], [(h * z).sum(), h.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    view.scale, view.shift = max(float(a), 0.0), float(b)


@dataclass
class CoTrained:
    text: View
    meta: View
    prior: float

    def score(self, xt, xm, n: int) -> np.ndarray:
        return _sigmoid(self.text.calibrated(xt, n) + self.meta.calibrated(xm, n) - self.prior)


def co_train(xt, xm, y: np.ndarray, labelled: np.ndarray, aside: np.ndarray, rounds: int = ROUNDS) -> CoTrained:
    """Two views over the same rows; ``y`` holds for labelled rows, others are the pool."""
    n = len(y)
    learn = labelled & ~aside
    if not learn.any():
        return CoTrained(View(), View(), 0.0)
    target = [np.where(learn, y, 0.0), np.where(learn, y, 0.0)]
    weight = [learn.astype(float), learn.astype(float)]
    mean = float(y[learn].mean())
    prior = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    views = [View(), View()]
    x = (xt, xm)
    for r in range(rounds + 1):
        views = [fit_view(x[k], target[k], weight[k]) for k in (0, 1)]
        if r == rounds:
            break
        for k in (0, 1):  # what one view is sure of, the other learns
            p = _sigmoid(views[k].raw(x[k], n))
            free = ~labelled & (weight[1 - k] == 0)
            most = int(SHARE * max(1, (~labelled).sum()))
            for value, sure in ((1.0, p), (0.0, 1 - p)):
                can = np.flatnonzero(free & (sure >= SURE))
                part = int(most * (mean if value else 1 - mean)) + 1
                take = can[np.argsort(-sure[can], kind="stable")[:part]]
                target[1 - k][take], weight[1 - k][take] = value, 0.5
    for k in (0, 1):
        _calibrate(views[k], x[k], n, y, aside & labelled)
    return CoTrained(views[0], views[1], prior)


def training_rows(docs: DataFrame, labels: DataFrame, targets: list[str], id_col: str = "doc_id", labelled: int = LABELLED, pool: int = POOL):
    """Bounded rows to learn from: features of about ``labelled`` labelled and ``pool`` other documents.

    Labels that repeat an id are averaged; null ids and labels are left out; with an empty table on either side there is nothing to learn.
    """
    draw = lambda k: F.pmod(F.xxhash64(F.lit(k), F.col(id_col)), F.lit(1_000_000))
    known = labels.groupBy(id_col).agg(*(F.avg(t).alias(t) for t in targets)).where(" and ".join(f"{t} is not null" for t in targets))
    n_known, n_docs = known.count(), docs.count()
    mine = known.where(draw("label") < 1_000_000 * min(1.0, labelled / max(1, n_known)))
    others = docs.select(id_col).where(draw("pool") < 1_000_000 * min(1.0, pool / max(1, n_docs))).join(known, id_col, "left_anti")
    chosen = mine.withColumn("_known", F.lit(True)).unionByName(others.distinct(), allowMissingColumns=True)

    def run(batches):
        for b in batches:
            for s, k in slices_by_bytes(b.column("text")):
                part = b.slice(s, k)
                row, slot, value = text_features(part.column("text"))
                order = np.argsort(row, kind="stable")
                cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=k))]).astype(np.int32)
                slots = pa.ListArray.from_arrays(pa.array(cut), pa.array(slot[order].astype(np.int32)))
                values = pa.ListArray.from_arrays(pa.array(cut), pa.array(value[order]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names if c != "text"), slots, values], names=out.names)

    # at most labelled + pool ids, so they go to every task
    cols = ["text", "source", "lang", "n_chars"]
    rows = docs.select(id_col, *cols).join(F.broadcast(chosen), id_col)
    # an id that stands in many rows is learned from once
    rows = rows.groupBy(*chosen.columns).agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("r")).select(*chosen.columns, "r.*")
    names = rows.columns
    out = T.StructType([*(f for f in rows.schema if f.name != "text"), T.StructField("slots", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))])
    out = T.StructType([T.StructField(f.name, f.dataType) for f in out])
    return rows.mapInArrow(run, out).toArrow().sort_by(id_col)


def learn(rows: pa.Table, targets: list[str]) -> dict[str, CoTrained]:
    n = len(rows)
    lens = np.asarray(pc.list_value_length(rows.column("slots")).to_numpy(), dtype=np.int64) if n else np.zeros(0, dtype=np.int64)
    flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    xt = (np.repeat(np.arange(n), lens), flat("slots").astype(np.int64), flat("values").astype(float)) if n else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    xm = meta_features(*(rows.column(c).to_pylist() for c in ("source", "lang", "n_chars")))
    known = np.array([bool(k) for k in rows.column("_known").to_pylist()], dtype=bool)
    aside = np.arange(n) % ASIDE == 0
    out = {}
    for t in targets:
        y = np.array([v or 0.0 for v in rows.column(t).to_pylist()]) >= 0.5
        out[t] = co_train(xt, xm, y.astype(float), known, aside)
    return out


def score(docs: DataFrame, models: dict[str, CoTrained], id_col: str = "doc_id") -> DataFrame:
    """id and one ``<target>_score`` (0 to 1) for every row of ``docs`` (text, source, lang, n_chars).

    Null texts have no words and null metadata is a value of its own, so every row gets a score; repeated rows are scored each, an
    empty table gives no rows, and with nothing to learn from all scores are 0.5. Texts of any length are read whole in one Arrow map; no
    shuffle. Other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(f"{t}_score", T.DoubleType()) for t in models)])

    def run(batches):
        ms = shared.value
        used = np.zeros(1 << BITS, dtype=bool)
        for m in ms.values():
            used |= m.text.weight != 0
        for b in batches:
            for s, k in slices_by_bytes(b.column(1)):
                part = b.slice(s, k)
                xt = text_features(part.column(1), used)
                xm = meta_features(*(part.column(i).to_pylist() for i in (2, 3, 4)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(m.score(xt, xm, k)) for m in ms.values())], names=out.names)

    return docs.select(id_col, "text", "source", "lang", "n_chars").mapInArrow(run, out)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = table(spark, sf_dir, "documents"), ["quality", "toxic"]
    models = learn(training_rows(docs, table(spark, sf_dir, "labels"), targets), targets)
    got = score(docs, models)
    return got.select("doc_id", F.col("quality_score").alias("score"), F.col("toxic_score"), ((F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5)).alias("kept"))
