"""Benchmark decontamination by rare seeds and local alignment (operator 8).

Word n-grams of the test items are counted over the whole corpus; an item's seeds are its n-grams
that few documents hold, and in any case the rarer part of them, so that a passage which many documents
copy, or copy with the same edits, keeps seeds. A seed also meets where one foreign word stands inside
it. Where a document holds a seed, the stretch of words around it is aligned with
the item by Smith-Waterman (match +1, mismatch -1, gap -1). The best score over the item's length
tells copies, edited copies and partial copies from chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import free_name, give_back, map_columns, slices_by_bytes, table, words_of

SEED_WORDS = 3
GAPS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))  # places of a seed's words in a document: together, or with one word put in
RARE_PART = 0.75  # of each item's n-grams by corpus frequency, ties included
RARE_DOCS = 0.01  # an n-gram in at most this part of the documents is a seed too
THRESHOLD = 0.5  # of the item's length
PASSAGE = 256  # words; a longer item counts as its passages of so many words, of which the best decides
CELLS = 4_000_000  # of alignment windows held at once
BLOCK_CHARS = 20_000_000  # of benchmark text sent to the executors at once; more goes in blocks


def _plain(w: str) -> str:
    return w if w.isalnum() else "".join(c for c in w if c.isalnum())


def item_words(text: str | None) -> list[str]:
    _, codes, words = words_of(pa.array([text], pa.string()))
    plain = [_plain(w.lower()) for w in words]
    return [plain[c] for c in codes.tolist() if plain[c]]


def passages(words: list[str]) -> list[list[str]]:
    """An item's words in runs of equal length, of at most ``PASSAGE`` words."""
    n = -(-len(words) // PASSAGE)
    return [words[len(words) * k // n : len(words) * (k + 1) // n] for k in range(n)]


class Items:
    """Words and n-grams of one block of test items.

    Items of fewer than ``SEED_WORDS`` words are ``brief``: all of their words are one seed, which has to be met whole.
    """

    def __init__(self, rows: list[tuple]):
        rows = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
        words = [(i, w) for i, t in rows for w in passages(item_words(t))]
        self.ids = [i for i, _ in words]
        self.vocab = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in words for w in ws))}
        self.codes = [np.array([self.vocab[w] for w in ws], dtype=np.int64) for _, ws in words]
        self.size = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.base = len(self.vocab) + 1  # the last number stands for no word
        keys = [self.keys(c) for c in self.codes]
        item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        pos = np.concatenate([np.arange(len(k)) for k in keys]) if keys else np.zeros(0, dtype=np.int64)
        flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
        self.grams, gram = np.unique(flat, return_inverse=True)
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.pos = gram[order], item[order], pos[order]
        self.brief = sorted({len(c) for c in self.codes if len(c) < SEED_WORDS})
        self._bounds()

    def _bounds(self):
        self.first = np.searchsorted(self.gram, np.arange(len(self.grams)))
        self.times = np.searchsorted(self.gram, np.arange(len(self.grams)), side="right") - self.first

    def keys(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) < SEED_WORDS:
            codes = np.append(codes, np.full(SEED_WORDS - len(codes), self.base - 1))
        return self._key(codes[j : len(codes) - SEED_WORDS + 1 + j] for j in range(SEED_WORDS))

    def _key(self, parts) -> np.ndarray:
        key = 0
        for p in parts:
            key = key * self.base + p
        return key

    def keep_rare(self, df: np.ndarray, part: float, docs: float) -> None:
        """The n-grams of at most ``docs`` documents and the rarest ``part`` of each item's stay seeds (a brief item's if rare)."""
        mine = df[self.gram]
        n = np.bincount(self.item, minlength=len(self.ids))
        ranked = mine[np.lexsort((mine, self.item))]
        most = ranked[np.cumsum(n) - n + np.ceil(part * n).astype(np.int64) - 1]
        most[self.size < SEED_WORDS] = 0
        keep = mine <= np.maximum(most[self.item], docs)
        self.gram, self.item, self.pos = self.gram[keep], self.item[keep], self.pos[keep]
        self._bounds()

    def read(self, text: pa.Array):
        """Words of all texts as codes (-1: in no item), the text of each, and where n-grams of items stand."""
        offsets, codes, words = words_of(text)
        get = self.vocab.get
        of = np.fromiter((-2 if not (p := _plain(w.lower())) else get(p, -1) for w in words), dtype=np.int64, count=len(words))
        code = of[codes]
        keep = code > -2
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[keep]
        code = code[keep]
        known = np.flatnonzero(code >= 0)
        found = []
        for gap in GAPS:
            at = known[known < len(code) - gap[-1]]
            for j in gap[1:]:
                at = at[code[at + j] >= 0]
            at = at[doc[at] == doc[at + gap[-1]]] if len(at) else at
            found.append((at, self._key(code[at + j] for j in gap)))
        for n in self.brief:
            at = known[known <= len(code) - n]
            for j in range(1, n):
                at = at[(code[at + j] >= 0) & (doc[at] == doc[at + j])]
            found.append((at, self._key([*(code[at + j] for j in range(n)), *[self.base - 1] * (SEED_WORDS - n)])))
        at, key = (np.concatenate(x) for x in zip(*found, strict=True))
        g = np.minimum(np.searchsorted(self.grams, key), max(0, len(self.grams) - 1))
        hit = self.grams[g] == key if len(self.grams) else np.zeros(len(key), dtype=bool)
        return code, doc, at[hit], g[hit]


def smith_waterman(item: np.ndarray, size: np.ndarray, window: np.ndarray):
    """Best local score of each row: items (n, a; padded with -3 after ``size``) against windows (n, b; -2 pads).

    Row by row of the item; a gap along the window is a running maximum, so a step is a few array
    operations. Returns the scores and the column after each best alignment's end.
    """
    n, b = window.shape
    slope = np.arange(b + 1, dtype=np.int32)
    h = np.zeros((n, b + 1), dtype=np.int32)
    best, end = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64)
    for i in range(item.shape[1]):
        new = np.zeros_like(h)
        new[:, 1:] = h[:, :-1] + np.where(window == item[:, i : i + 1], 1, -1)
        np.maximum(new, h - 1, out=new)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        new[i >= size] = 0
        h = new
        top = h.max(axis=1)
        up = top > best
        best[up], end[up] = top[up], h[up].argmax(axis=1)
    return best, end


def _scores(items: Items, code: np.ndarray, doc: np.ndarray, at: np.ndarray, g: np.ndarray):
    """(document, item, score) for each pair that shares a seed."""
    n = items.times[g]
    which = np.arange(int(n.sum())) + np.repeat(items.first[g] - (np.cumsum(n) - n), n)
    item, diag = items.item[which], np.repeat(at, n) - items.pos[which]
    size = items.size
    slack = np.maximum(4, size // 4)[item]
    place = np.floor_divide(diag, slack)
    win = np.unique(np.stack([doc[np.repeat(at, n)], item, place], axis=1), axis=0)
    d, item, place = win[:, 0], win[:, 1], win[:, 2]
    slack = np.maximum(4, size // 4)[item]
    lo, width = (place - 1) * slack, size[item] + 3 * slack + size[item] // 2
    first = np.searchsorted(doc, d)
    last = np.searchsorted(doc, d, side="right")
    score = np.zeros(len(d))
    order = np.argsort(size[item], kind="stable")
    step = max(1, CELLS // int(width.max())) if len(width) else 1
    for s in range(0, len(order), step):
        o = order[s : s + step]
        a, w = int(size[item[o]].max()), int(width[o].max())
        it = np.full((len(o), a), -3, dtype=np.int64)
        for r, x in enumerate(item[o].tolist()):
            it[r, : size[x]] = items.codes[x]
        cols = lo[o][:, None] + np.arange(w)[None, :]
        inside = (cols >= first[o][:, None]) & (cols < last[o][:, None])
        win_codes = np.where(inside, code[np.clip(cols, 0, len(code) - 1)], -2)
        best, _ = smith_waterman(it, size[item[o]], win_codes)
        score[o] = best / size[item[o]]
    return d, item, score


def _frequencies(docs: DataFrame, text_col: str, shared) -> dict[int, int]:
    """Documents that hold each n-gram of the items, and at -1 all documents; a row for each n-gram seen."""

    def run(batches):
        items = shared.value
        total, seen = np.zeros(len(items.grams), dtype=np.int64), 0
        for b in batches:
            seen += b.num_rows
            for s, n in slices_by_bytes(b.column(0)):
                _, doc, at, g = items.read(b.column(0).slice(s, n))
                total += np.bincount(np.unique(doc[at] * len(items.grams) + g) % max(1, len(items.grams)), minlength=len(total)) if len(g) else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(total[some], seen))], names=["gram", "n"])

    return dict(map(tuple, docs.select(text_col).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect()))


def _against(docs: DataFrame, source: DataFrame, rows: list[tuple], text_col: str, found_col: str, threshold: float, rare: float, id_type: T.DataType) -> DataFrame:
    spark = docs.sparkSession
    seeds = Items(rows)
    if seeds.ids:
        df = _frequencies(source, text_col, spark.sparkContext.broadcast(seeds))
        seeds = Items(rows)
        seeds.keep_rare(np.array([df.get(i, 0) for i in range(len(seeds.grams))]), rare, max(1.0, RARE_DOCS * df.get(-1, 0)))
    shared = spark.sparkContext.broadcast(seeds)
    found = T.ArrayType(T.StructType([T.StructField("item_id", id_type), T.StructField("score", T.DoubleType())]))
    out = T.StructType([*docs.schema, T.StructField(found_col, found)])
    at_text = docs.columns.index(text_col)

    def run(batches):
        it = shared.value
        for b in batches:
            for s, n in slices_by_bytes(b.column(at_text)):
                part = b.slice(s, n)
                code, doc, at, g = it.read(part.column(at_text))
                lists = [[] for _ in range(n)]
                if len(g):
                    d, item, score = _scores(it, code, doc, at, g)
                    best: dict[tuple, float] = {}
                    for x, i, v in zip(d.tolist(), item.tolist(), score.tolist(), strict=True):
                        v = v if it.size[i] >= SEED_WORDS or v == 1 else 0.0
                        if v >= threshold and v > best.get((x, it.ids[i]), 0):
                            best[x, it.ids[i]] = v
                    for (x, i), v in sorted(best.items()):
                        lists[x].append({"item_id": i, "score": v})
                col = pa.array(lists, pa.list_(pa.struct([("item_id", pa.array(it.ids).type if it.ids else pa.int64()), ("score", pa.float64())])))
                yield pa.RecordBatch.from_arrays([*part.columns, col], names=out.names)
        give_back()

    return map_columns(docs, run, out)


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, rare: float = RARE_PART, found_col: str = "_found") -> DataFrame:
    """``docs`` with column ``found_col``: array of (item_id, score) of the test items found in each text.

    Every row stays, with all its columns; one that is called ``found_col`` is replaced, so choose
    another name (``free_name``) where it matters. Null and empty texts, null item ids and items without words have no
    match; repeated items and rows are each compared (rows of one item id give one match, the best); items that match equally well all
    stand in the array; an empty table on either side finds nothing. An item of one or two words is found only where all of its words stand together, and only
    if at most ``RARE_DOCS`` of the documents (or one) hold them; other words stand everywhere. An item of more than
    ``PASSAGE`` words counts as its passages. Texts of any length are read whole, twice (counts, then search), and never
    shuffled; only the counts of the items' own n-grams meet. Benchmark text goes to the executors in
    blocks of ``BLOCK_CHARS``, each counted on ``docs`` itself.
    """
    docs = docs.drop(found_col)
    b = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t"))
    chars = b.agg(F.sum(F.length("t"))).head()[0] or 0
    blocks = int(chars // BLOCK_CHARS) + 1
    out, made = docs, []
    for k in range(blocks):
        part = b if blocks == 1 else b.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k)
        made.append(free_name(f"found_{k}", out))
        out = _against(out, docs, [tuple(r) for r in part.collect()], text_col, made[-1], threshold, rare, benchmark.schema[item_col].dataType)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), F.concat(*made).alias(found_col))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = contamination(docs, table(spark, sf_dir, "benchmark"))
    best = F.array_sort("_found", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["item_id"] < b["item_id"], -1).otherwise(1))
    return got.select(
        "doc_id",
        (F.size("_found") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("_found", lambda x: x["score"])), F.lit(0.0)).alias("score"),
        F.try_element_at(best, F.lit(1))["item_id"].alias("item_id"),
        F.transform("_found", lambda x: x["item_id"]).alias("items"),
    )
