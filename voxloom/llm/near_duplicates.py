"""Near-duplicate documents by improved consistent weighted sampling (operator 2).

A document is the weighted set of its five-word shingles, weight = count x damped inverse document
frequency. Improved consistent weighted sampling draws samples whose chance of agreement is the
weighted Jaccard similarity; bands of samples make candidates; every candidate pair of different
texts is then verified by its exact weighted Jaccard similarity, and verified links form classes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import connected_components, free_name, give_back, keyed_join, mix64, slices_by_bytes, stage, table, words_of

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4  # at similarity 0.8 a pair shares no band once in 4,500 times, at 0.85 once in 100,000
SKETCH_BITS = 20  # bins in which shingles' documents are counted; the size is fixed, whatever the corpus
IDF_PART = 0.25  # a shingle of one document weighs 1 + IDF_PART, one of all documents 1
BLOCK = 512  # texts of a bucket that are all compared with each other; larger buckets go in blocks
STARS = 8  # texts of a larger bucket with which all others are compared first
AT_ONCE = 1 << 14  # shingles that are sampled together; only speed depends on it
SENT = 1_000_000  # most rows of (hash, id) that are broadcast; beyond it a shuffled join

_SLICE = 1 << 14
_HASH48 = np.uint64((1 << 48) - 1)


def shingles(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text its distinct shingles: (text, 48-bit hash, count), by text and hash.

    Words are what white space separates, in lower case; a text of fewer than five words has one
    shingle of all of them, a text without words none.
    """
    offsets, codes, words = words_of(text)
    n = np.diff(offsets)
    h = np.fromiter((xxhash.xxh64_intdigest(w.lower()) for w in words), dtype=np.uint64, count=len(words))[codes]
    if not len(h):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    first = np.cumsum(n) - n
    # a rolling combination over five places; short texts are padded with zeros
    size = np.maximum(n, WORDS) * (n > 0)
    start = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), dtype=np.uint64)
    flat[np.arange(len(h)) - np.repeat(first, n) + np.repeat(start, n)] = h
    m = len(flat) - WORDS + 1
    key = np.zeros(m, dtype=np.uint64)
    for j in range(WORDS):
        key = key * np.uint64(0x9E3779B97F4A7C15) + mix64(flat[j : j + m] + np.uint64(j))
    who = np.repeat(np.arange(len(n)), size)
    inside = who[:m] == who[WORDS - 1 :]
    packed = np.sort((who[:m][inside].astype(np.uint64) << np.uint64(48)) | (mix64(key[inside]) & _HASH48))
    change = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    count = np.diff(np.append(change, len(packed)))
    packed = packed[change]
    return (packed >> np.uint64(48)).astype(np.int64), packed & _HASH48, count


def _batches(batches, col: int, most: int = 32_768):
    for b in batches:
        for s, n in slices_by_bytes(b.column(col)):
            for k in range(s, s + n, most):
                yield b.slice(k, min(most, s + n - k))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents in each of 2**SKETCH_BITS bins of shingles, and the number of documents.

    Every task sums its own documents and sends its bins in compressed slices, which are summed by
    slice: what is shuffled does not grow with a task's documents.
    """
    bins = 1 << SKETCH_BITS

    def run(batches):
        total, seen = np.zeros(bins, dtype=np.int64), 0
        for b in _batches(batches, 0):
            _, h, _ = shingles(b.column(0))
            total += np.bincount((h & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
            seen += b.num_rows
        for s in range(bins // _SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([seen if s == 0 else 0]), pa.array([zlib.compress(total[s * _SLICE : (s + 1) * _SLICE].tobytes(), 1)])], names=["slice", "docs", "counts"])
        give_back()

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_SLICE, dtype=np.int64)
        for c in group.column("counts"):
            total += np.frombuffer(zlib.decompress(c.as_py()), dtype=np.int64)
        return pa.table({"slice": [group.column("slice")[0].as_py()], "docs": [pc.sum(group.column("docs")).as_py()], "counts": [total.tobytes()]})

    schema = "slice long, docs long, counts binary"
    rows = docs.select(text_col).mapInArrow(run, schema).groupBy("slice").applyInArrow(add, schema).collect()  # a fixed number
    out = np.zeros(bins, dtype=np.int64)
    for r in rows:
        out[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.frombuffer(r["counts"], dtype=np.int64)
    return out, sum(r["docs"] for r in rows)


def bin_weights(counts: np.ndarray, docs: int) -> np.ndarray:
    """Damped inverse document frequency of each bin, 1 to 1 + IDF_PART.

    What a bin holds by chance (the mean and three deviations) counts for nothing, so the rare
    shingles of a large corpus all weigh the same, and frequent ones less.
    """
    mean = counts.mean()
    df = np.clip(counts - mean - 3 * np.sqrt(mean), 1, max(1, docs))
    return (1 + IDF_PART * np.log((docs + 1) / (df + 1)) / np.log(docs + 2)).astype(np.float32)


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) quantiles at the middles of 65,536 equal parts, and their logarithms."""
    u = (np.arange(65536) + 0.5) / 65536
    lo, hi = np.zeros_like(u), np.full_like(u, 40.0)
    for _ in range(60):
        x = (lo + hi) / 2
        below = 1 - np.exp(-x) * (1 + x) < u
        lo, hi = np.where(below, x, lo), np.where(below, hi, x)
    return x.astype(np.float32), np.log(x).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling: the same element and weight draw the same in every document."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.gamma, self.log_gamma = _quantiles()

    def bands(self, start: np.ndarray, h: np.ndarray, count: np.ndarray) -> np.ndarray:
        """(documents, BANDS) keys; ``start`` is where each document's shingles begin.

        Documents are taken in runs of about ``AT_ONCE`` shingles, so that what a draw works on stays in
        the processor's cache.
        """
        log_w = np.log(count.astype(np.float32) * self.weights[(h & np.uint64(len(self.weights) - 1)).astype(np.int64)])
        out = np.empty((len(start), BANDS), dtype=np.uint64)
        end = np.append(start[1:], len(h))
        s = 0
        while s < len(start):
            e = max(s + 1, int(np.searchsorted(end, start[s] + AT_ONCE, side="right")))
            part = slice(int(start[s]), int(end[e - 1]))
            self._draw(start[s:e] - start[s], h[part], log_w[part], out[s:e])
            s = e
        return out

    def _draw(self, start: np.ndarray, h: np.ndarray, log_w: np.ndarray, out: np.ndarray) -> None:
        n = len(h)
        x, shifted, order = (np.empty(n, dtype=np.uint64) for _ in range(3))
        beta, t, log_a = (np.empty(n, dtype=np.float32) for _ in range(3))
        key = np.empty((BANDS, len(start)), dtype=np.uint64)
        key[:] = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None]
        half = np.uint64(32)
        for draw in range(BANDS * ROWS):
            np.add(h, np.uint64((draw + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), out=x)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                np.right_shift(x, np.uint64(shift), out=shifted)
                np.bitwise_xor(x, shifted, out=x)
                np.multiply(x, np.uint64(factor), out=x)
            np.right_shift(x, np.uint64(31), out=shifted)
            np.bitwise_xor(x, shifted, out=x)
            fours = x.view(np.uint16).reshape(-1, 4)  # quantile of r, quantile of c, beta, and the sample with it
            r = self.gamma.take(fours[:, 0])
            np.multiply(fours[:, 2], np.float32(1 / 65536), out=beta, dtype=np.float32)
            np.divide(log_w, r, out=t)
            np.add(t, beta, out=t)
            np.floor(t, out=t)
            np.subtract(t, beta, out=log_a)
            np.add(log_a, np.float32(1), out=log_a)
            np.multiply(log_a, r, out=log_a)
            np.subtract(self.log_gamma.take(fours[:, 1]), log_a, out=log_a)
            # a float's bits as an unsigned number of the same order
            bits = log_a.view(np.int32)
            least = bits ^ ((bits >> np.int32(31)) | np.int32(-0x80000000))
            order[:] = least.view(np.uint32)
            np.left_shift(order, half, out=order)
            np.right_shift(x, half, out=x)
            np.bitwise_xor(x, (t.astype(np.int32).view(np.uint32) * np.uint32(0x85EBCA6B)), out=x)
            np.bitwise_or(order, x, out=order)
            least = np.minimum.reduceat(order, start) & np.uint64(0xFFFFFFFF)
            band = draw // ROWS
            key[band] = mix64(key[band] * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:] = key.T


def _signed(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """(id, h, bands) of every row; texts without words have no bands."""

    def run(batches):
        sampler = Sampler(shared.value)
        for b in _batches(batches, 2):
            doc, h, count = shingles(b.column(2))
            n = np.bincount(doc, minlength=b.num_rows)
            some = np.flatnonzero(n)
            keys = sampler.bands((np.cumsum(n) - n)[some], h, count) if len(some) else np.zeros((0, BANDS), dtype=np.uint64)
            size = np.zeros(b.num_rows + 1, dtype=np.int32)
            size[some + 1] = BANDS
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), bands], names=["_id", "h", "bands"])
        give_back()

    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("h", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col).alias("_id"), _text_hash(text_col).alias("h"), F.col(text_col)).mapInArrow(run, schema)


def _text_hash(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def _links(text: pa.Array, block: np.ndarray, weights: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the verified links among the texts (only between blocks, where two are given)."""
    doc, h, count = shingles(text)
    n = len(text)
    w = weights[(h & np.uint64(len(weights) - 1)).astype(np.int64)].astype(np.float64)
    total = np.bincount(doc, weights=w * count, minlength=n)
    # a shingle that stands k times is k features, so that sums of smaller counts are products
    rep = np.repeat(np.arange(len(h)), count)
    nth = np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
    feature, col = np.unique(mix64(h[rep] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)
    often = np.bincount(col, minlength=len(feature))
    use = often[col] > 1
    row, col, fw = doc[rep][use], col[use], w[rep][use]
    _, col = np.unique(col, return_inverse=True)
    shared = np.zeros((n, n))
    order = np.argsort(col, kind="stable")
    row, col, fw = row[order], col[order], fw[order]
    for a in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        i, j = np.searchsorted(col, [a, a + 4096])
        m = np.zeros((n, min(4096, int(col[-1]) + 1 - a)))
        m[row[i:j], col[i:j] - a] = np.sqrt(fw[i:j])
        shared += m @ m.T
    ok = shared >= similarity * (total[:, None] + total[None, :] - shared) - 1e-9
    ok &= total[:, None] > 0
    if block.min() != block.max():
        ok &= block[:, None] != block[None, :]
    a, b = np.nonzero(np.triu(ok, 1))
    parent = np.arange(n)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _verified(rows: DataFrame, shared, similarity: float, cells: int) -> DataFrame:
    """Links (a, b) between text hashes, from (key, i, j, block, h, text) rows of buckets."""

    def run(group: pa.Table) -> pa.Table:
        a_out, b_out = [], []
        group = group.combine_chunks()
        key = np.stack([group.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
        order = np.lexsort(key.T[::-1])
        cut = np.flatnonzero(np.any(np.diff(key[order], axis=0) != 0, axis=1)) + 1
        hs = group.column("h")
        for at in np.split(order, cut):
            if len(at) < 2:
                continue
            take = pa.array(at)
            for x, y in _links(group.column("text").take(take).combine_chunks(), group.column("block").to_numpy()[at], shared.value, similarity):
                a_out.append(hs[int(at[x])].as_py())
                b_out.append(hs[int(at[y])].as_py())
        return pa.table({"a": pa.array(a_out, pa.binary()), "b": pa.array(b_out, pa.binary())})

    cell = F.pmod(F.xxhash64("key", "i", "j"), F.lit(cells))
    return rows.withColumn("cell", cell).groupBy("cell").applyInArrow(run, "a binary, b binary")


def _hash_block(blocks):
    return F.pmod(F.xxhash64(F.lit("block"), "h"), blocks.cast("long")).cast("int")


def _first_round(inner: DataFrame) -> DataFrame:
    """(key, i, j, block, h): buckets of at most ``BLOCK`` texts whole; of larger ones, blocks with the ``STARS`` texts of the bucket."""
    small = inner.where(F.col("size") <= BLOCK).select("key", F.lit(0).alias("i"), F.lit(0).alias("block"), "h")
    large = inner.where(F.col("size") > BLOCK)
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.lit("star"), "h"), "h"))  # only the first rows of a bucket are dealt out
    stars = large.withColumn("nth", nth).where(F.col("nth") <= STARS)
    stars = stars.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("block"), "h")
    rest = large.select("key", F.col("block").alias("i"), F.lit(1).alias("block"), "h")
    return small.unionByName(stars).unionByName(rest).select("key", F.col("i").cast("long"), F.col("i").cast("long").alias("j"), "block", "h")


def _second_round(inner: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, i, j, block, h): of buckets over ``BLOCK`` texts whose texts are not one class yet, pairs of blocks of different classes.

    Texts of a class with many texts of a bucket have blocks of their own, which never meet; the others share blocks.
    """
    large = inner.where(F.col("size") > BLOCK).join(classes.withColumnsRenamed({"id": "h"}), "h", "left")
    large = stage(large.select("key", "h", "size", F.coalesce("component", "h").alias("component")), "near-large")
    count = stage(large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")), "near-large-classes")
    big = count.where(F.col("n") > BLOCK // 2)  # at most two in BLOCK texts
    open_keys = count.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max("size").alias("size"), F.sum(F.when(F.col("n") > BLOCK // 2, F.col("n")).otherwise(0)).alias("own"))
    open_keys = stage(open_keys.where("classes > 1").select("key", F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("own")) / BLOCK)).alias("mixed")), "near-open")
    big = stage(big.select("key", "component", F.xxhash64("component").alias("own"), F.ceil(F.col("n") / BLOCK).alias("parts")), "near-big")
    sent = (lambda df: F.broadcast(df) if df.count() <= SENT else df)
    rows = large.join(sent(open_keys), "key").join(sent(big), ["key", "component"], "left")
    rows = rows.select("key", "h", F.coalesce("own", F.lit(0)).alias("own"), _hash_block(F.coalesce("parts", "mixed")).alias("sub"))
    rows = stage(rows, "near-blocks")
    label = rows.select("key", "own", "sub").distinct()
    a, b = label.toDF("key", "a_own", "a_sub"), label.toDF("key", "b_own", "b_sub")
    apart = (F.struct("a_own", "a_sub") <= F.struct("b_own", "b_sub")) & ((F.col("a_own") == 0) | (F.col("a_own") != F.col("b_own")))
    pair = stage(a.join(b, "key").where(apart).select("*", F.xxhash64("a_own", "a_sub").alias("i"), F.xxhash64("b_own", "b_sub").alias("j")), "near-block-pairs")
    sides = [pair.select("key", F.col(f"{x}_own").alias("own"), F.col(f"{x}_sub").alias("sub"), "i", "j", F.lit(k).alias("block")).where("true" if k == 0 else "i <> j") for k, x in enumerate("ab")]
    return rows.join(sides[0].unionByName(sides[1]), ["key", "own", "sub"]).select("key", "i", "j", "block", "h")


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(_id, h, bands) of every row, and (h, n, class_id, class_h, n_class) of every text with words, which n rows hold."""
    spark = docs.sparkSession
    counts, n_docs = document_frequencies(docs, text_col)
    shared = spark.sparkContext.broadcast(bin_weights(counts, n_docs))  # 2**SKETCH_BITS floats
    sig = stage(_signed(docs, shared, id_col, text_col), "near-signatures")
    nodes = sig.where(F.size("bands") > 0).groupBy("h").agg(F.min("_id").alias("id"), F.count(F.lit(1)).alias("n"), F.min("bands").alias("bands"))
    nodes = stage(nodes, "near-nodes")
    member = nodes.select("h", "id", F.explode("bands").alias("key"))
    size = member.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("h").cast("decimal(38,0)")).alias("who"))
    size = size.where("size > 1").groupBy("size", "who").agg(F.min("key").alias("key")).select("key", "size")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    inner = stage(member.join(size, "key").select("h", "id", "key", "size", blocks.alias("blocks"), _hash_block(blocks).alias("block")), "near-members")
    need = inner.select("h", "id").distinct()
    rows = docs.select(_text_hash(text_col).alias("h"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    few = need.count() <= SENT
    texts = rows.join(F.broadcast(need) if few else need, (rows["h"] == need["h"]) & rows["id"].eqNullSafe(need["id"]), "left_semi")
    texts = stage(texts.dropDuplicates(["h"]).select("h", "text"), "near-texts")

    def compared(part: DataFrame) -> DataFrame:
        return _verified(part.join(texts, "h"), shared, similarity, max(1, part.count() // 200))

    links = stage(compared(_first_round(inner)), "near-links")
    classes = connected_components(links)
    if inner.where(F.col("size") > BLOCK).take(1):
        classes = stage(classes, "near-first-classes")
        more = compared(_second_round(inner, classes))
        classes = connected_components(classes.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = nodes.select("h", "id", "n").join(classes.withColumnRenamed("id", "h"), "h", "left").select("h", "id", "n", F.coalesce("component", "h").alias("component"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("h")))
    names = named.groupBy("component").agg(first.alias("x"), F.sum("n").alias("n_class"), F.count(F.lit(1)).alias("texts"))
    names = stage(names.select("component", F.col("x.id").alias("class_id"), F.col("x.h").alias("class_h"), "n_class", "texts"), "near-names")
    return sig, stage(keyed_join(named, names, "component", "texts").select("h", "n", "class_id", "class_h", "n_class"), "near-classes")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each class, and every row without words.

    The row of the smallest id stays (of the smallest text hash, where one id has several texts); rows
    that repeat both id and text become one; an empty table stays empty; texts of any length are compared whole. Columns may have any names.
    """
    sig, of = _classes(docs, id_col, text_col, similarity)
    rows = keyed_join(sig.where(F.size("bands") > 0).select("_id", "h"), of, "h", "n")
    stays = (F.col("h") == F.col("class_h")) & F.col("_id").eqNullSafe(F.col("class_id"))
    h, gone_id, gone_h, again_h = (free_name(n, docs) for n in ("h", "gone_id", "gone_h", "again"))
    gone = stage(rows.where(~stays).select(F.col("_id").alias(gone_id), F.col("h").alias(gone_h)).distinct(), "near-gone")
    few = gone.count() <= SENT
    out = docs.withColumn(h, _text_hash(text_col))
    out = out.join(F.broadcast(gone) if few else gone, (F.col(h) == F.col(gone_h)) & F.col(id_col).eqNullSafe(F.col(gone_id)), "left_anti")
    again = rows.where(stays).groupBy("h").count().where("count > 1").select(F.col("h").alias(again_h))
    if not again.take(1):
        return out.drop(h)
    twice = out.join(again, F.col(h) == F.col(again_h))  # repeated rows of what stays
    once = out.join(again, F.col(h) == F.col(again_h), "left_anti")
    return once.drop(h).unionByName(twice.dropDuplicates([h]).drop(h, again_h))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of ``docs``: id, class_id (smallest id of its class), n_class (rows), kept.

    Equal texts are one class from the start and are compared once, so a huge group of copies costs
    a sum. Different texts of a bucket are all compared; where a bucket is large, first with some of its texts, and then only
    those of different classes with each other, in blocks. Only a
    spanning forest of what is found leaves a task. Buckets of other bands with the same members are
    compared once. Texts of any length are compared whole; other columns are not read, whatever their names; an empty table gives no rows. Texts without words (null, empty, blank) are each a class of their own, by row:
    class_id is the own id. ``kept`` marks the rows whose id is the class's. Null ids join classes but
    never name one unless all ids are null; rows that repeat an id share their fate.
    """
    sig, of = _classes(docs, id_col, text_col, similarity)
    some = keyed_join(sig.where(F.size("bands") > 0).select("_id", "h"), of, "h", "n").select("_id", "class_id", "n_class")
    none = sig.where(F.size("bands") == 0).select("_id", F.col("_id").alias("class_id"), F.lit(1).cast("long").alias("n_class"))
    return some.unionAll(none).select(F.col("_id").alias(id_col), "class_id", "n_class", F.col("_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
