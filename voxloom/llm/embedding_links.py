"""Near-duplicate embeddings by randomised-rotation binary codes (operator 6).

Each vector is rotated at random; the signs are its binary code, kept with the inner product of code and
vector as a correction factor, and four bits of each rotated component are what other vectors' codes are
compared with. The factors make inner-product estimates unbiased and bound their error, first for signs against four bits,
then for four bits against four bits. Only codes go to the buckets in which vectors meet; a pair that its bounds do not
rule out is undecided, and only vectors with undecided pairs are fetched whole for exact cosines.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import connected_components, is_empty, keyed_join, mix64, stage, table

COSINE = 0.9
MISS = 1e-5  # most often that a pair right at the threshold shares no band
SURE = 6.0  # deviations of an estimate's error within which a pair stays undecided
BUCKET_BITS = 10  # buckets of about 2**BUCKET_BITS unrelated vectors
BLOCK = 1024  # vectors of a bucket compared in one task; larger buckets go in pairs of blocks
HOT = 1000  # a vector with more than this part of all rows is joined by broadcast: at most so many
SENT = 1_000_000  # most bucket sizes that are broadcast


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def plan_bands(n: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(bits, bands): as many bits as leave buckets of their size, and as many bands as the threshold needs."""
    bits = int(np.clip(round(math.log2(max(n, 2)) - BUCKET_BITS), 0, 24))
    one = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-one))) if one < 1 else 1


@lru_cache(maxsize=64)
def _directions(dim: int, need: int) -> np.ndarray:
    """``need`` random directions as whole numbers, so that their products with codes are exact in any order."""
    rows = [np.rint(rotation(dim, seed) * 4096) for seed in range(1, 1 + -(-need // dim))]
    return np.concatenate(rows)[:need] if rows else np.zeros((0, dim))


def levels(code: np.ndarray) -> np.ndarray:
    """Packed four-bit components as odd whole numbers from -15 to 15."""
    out = np.empty((len(code), code.shape[1] * 2), dtype=np.float32)
    out[:, 0::2], out[:, 1::2] = code >> 4, code & 15
    return out * 2 - 15


def band_values(level: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """(n, bands) numbers made of sign bits of further directions, taken from the four-bit codes."""
    need = bits * bands
    if not need:
        return np.zeros((len(level), bands), dtype=np.uint32)
    s = (level.astype(np.float64) @ _directions(level.shape[1], need).T > 0).reshape(len(level), bands, bits)
    return (s * (np.uint32(1) << np.arange(bits, dtype=np.uint32))).sum(axis=2, dtype=np.uint32)


def band_keys(value: np.ndarray, dim: int) -> np.ndarray:
    """(n, bands) bucket keys of the band values of vectors of one length."""
    key = mix64(value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, value.shape[1] + 1, dtype=np.uint64))
    return key.view(np.int64) ^ np.int64(dim)


class Codes:
    """Codes of unit vectors of one length: packed four-bit components, and three factors of each vector.

    ``sign``: product of the sign code (unit) and the vector; ``four``: product of the four-bit levels and the
    vector; ``rest``: length of what the levels hold besides the vector, by ``four``. Vectors of odd length get a zero.
    """

    def __init__(self, code: np.ndarray, factors: np.ndarray):
        self.code, self.factors = code, factors
        self.level = levels(code)
        self.sign, self.four, self.rest = factors.astype(np.float32).T
        self.dim = self.level.shape[1]

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        if x.shape[1] % 2:
            x = np.pad(x, ((0, 0), (0, 1)))
        y = x @ rotation(x.shape[1], 0).T
        u = np.clip(np.floor((y / np.abs(y).max(axis=1, keepdims=True) + 1) * 8), 0, 15).astype(np.uint8)
        level = u.astype(np.float64) * 2 - 15
        sign = (np.where(u >= 8, y, -y)).sum(axis=1) / math.sqrt(y.shape[1])
        four = (level * y).sum(axis=1)
        rest = np.sqrt(np.maximum((level * level).sum(axis=1) - four * four, 0)) / four
        return cls(u[:, 0::2] << 4 | u[:, 1::2], np.stack([sign, four, rest], axis=1).astype("<f4"))

    def packed(self) -> list[bytes]:
        return [c.tobytes() + f.tobytes() for c, f in zip(self.code, self.factors, strict=True)]

    @classmethod
    def unpacked(cls, raw: list[bytes]) -> Codes:
        rows = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), -1)
        return cls(rows[:, :-12], np.ascontiguousarray(rows[:, -12:]).view("<f4"))

    def _noise(self) -> float:
        return 1 / math.sqrt(max(1, self.dim - 1))

    def by_sign(self, a, b) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the products of vectors ``a`` (sign codes) and ``b`` (levels), all with all, and the deviations of their errors."""
        s, r = self.sign[a][:, None], self.rest[b][None, :]
        est = (np.where(self.level[a] > 0, np.float32(1), np.float32(-1)) @ self.level[b].T) / (math.sqrt(self.dim) * s * self.four[b][None, :])
        return est, (np.sqrt(np.maximum(1 - s * s, 0)) + r) / s * self._noise()

    def by_levels(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the products of vectors ``a`` and ``b``, pair by pair, from levels alone, and the deviations of their errors."""
        est = np.einsum("ij,ij->i", self.level[a], self.level[b]) / (self.four[a] * self.four[b])
        ra, rb = self.rest[a], self.rest[b]
        return est, np.sqrt(ra * ra + rb * rb + (ra * rb) ** 2) * self._noise()


def _undecided(codes: Codes, values: np.ndarray, band: np.ndarray, first: np.ndarray, block: np.ndarray, both: np.ndarray, cosine: float):
    """Pairs (rows) inside buckets which the bounds do not rule out and that share no earlier band (those meet there).

    Buckets begin at the rows ``first`` and lie by block; where ``both`` marks one, only pairs of different blocks count.
    """
    before = np.arange(values.shape[1])
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(values)], strict=True):
        m = s + int(np.searchsorted(block[s:e], block[e - 1])) if both[s] else s
        if e - s < 2 or (both[s] and m == s):
            continue
        for x in range(s, m if both[s] else e, 512):
            rows = slice(x, min(x + 512, m if both[s] else e))
            est, dev = codes.by_sign(rows, slice(m, e))
            a, b = np.nonzero(est + SURE * dev >= cosine)
            a, b = a + x, b + m
            if not both[s]:
                a, b = a[a < b], b[a < b]
            est, dev = codes.by_levels(a, b)
            keep = est + SURE * dev >= cosine
            a, b = a[keep], b[keep]
            for k in range(0, len(a), 1 << 14):
                p, q = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                fresh = ~((values[p] == values[q]) & (before < band[p][:, None])).any(axis=1)
                yield p[fresh], q[fresh]


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow on the way."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, np.dtype]:
    """(id, v) of every row: v its components as bytes, null if it cannot link, and their type (no precision is lost)."""
    kind = np.dtype("<f4") if isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType) else np.dtype("<f8")

    def run(batches):
        for b in batches:
            col, there = b.column(1), b.column(0).is_valid().to_pylist()
            out: list[bytes | None] = [None] * b.num_rows
            for i in range(b.num_rows):
                v = col[i].values
                if not there[i] or v is None or not len(v) or v.null_count:
                    continue
                x = np.asarray(v.to_numpy(zero_copy_only=False), dtype=kind) + kind.type(0)  # -0 is 0
                if np.isfinite(x).all() and x.any():
                    out[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    schema = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("v", T.BinaryType())])
    return vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").alias("v")).mapInArrow(run, schema), kind


def _by_length(col: pa.Array, kind: np.dtype):
    """(rows, matrix) for each length of vector in a binary column."""
    raw = col.to_pylist()
    size = np.array([len(r) for r in raw])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, np.frombuffer(b"".join(raw[i] for i in at.tolist()), dtype=kind).reshape(len(at), -1)


def _buckets(group: pa.Table, names: list[str]):
    """(rows, codes, columns) for each length of code in a group, by bucket and block."""
    raw = np.array(group.column("code").to_pylist(), dtype=object)
    size = np.array([len(r) for r in raw])
    cols = {c: group.column(c).to_numpy() for c in names}
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        at = at[np.lexsort([cols[c][at] for c in ("block", "j", "i", "key")])]
        yield at, Codes.unpacked(raw[at].tolist()), {c: v[at] for c, v in cols.items()}


def _firsts(cols: dict) -> np.ndarray:
    k, i, j = (cols[c] for c in ("key", "i", "j"))
    return np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """A row for each row: id, n_links, component_id, kept (id is its component's smallest).

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id,
    have no links (component_id is their own id); an empty table gives no rows; vectors may be of any length, and those of
    different lengths never meet; other columns are not read, whatever their names. Equal vectors are one from the start, so a common
    vector costs a sum. A bucket is compared in blocks; counts
    and a spanning forest of the links leave a task, never the pairs. Links are exact: double-precision
    cosines decide, and a pair counts in the first band that it shares. Rows that repeat an id, with the same vector or
    another one, count as further vectors, each with links and a component of its own.
    """
    spark = vectors.sparkSession
    rows, kind = _vectors(vectors, id_col, vec_col)
    every = stage(rows, "vectors")
    good = every.where(F.col("v").isNotNull())
    nodes = good.groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # a node is a vector: ids may stand with several vectors, so nodes get numbers of their own
    coded = T.StructType([T.StructField("id", T.LongType()), T.StructField("first", vectors.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("code", T.BinaryType())])

    def encode(batches):
        nth = TaskContext.get().partitionId() << 40
        for b in batches:
            for at, x in _by_length(b.column(2), kind):
                packed = Codes.of(unit(x)).packed()
                yield pa.RecordBatch.from_arrays([pa.array(nth + np.arange(len(at))), *(b.column(c).take(pa.array(at)) for c in range(3)), pa.array(packed, pa.binary())], names=coded.names)
                nth += len(at)

    nodes = stage(nodes.select("first", "n", "v").mapInArrow(encode, coded), "coded")
    bits, bands = plan_bands(nodes.count(), cosine)
    dealt = T.StructType([T.StructField("key", T.LongType()), T.StructField("band", T.ShortType()), T.StructField("id", T.LongType()), T.StructField("code", T.BinaryType())])

    def deal(batches):
        for b in batches:
            raw = b.column(1).to_pylist()
            size = np.array([len(r) for r in raw])
            for n in np.unique(size):
                for some in np.array_split(at := np.flatnonzero(size == n), -(-len(at) // 1024)):
                    codes = Codes.unpacked([raw[i] for i in some.tolist()])
                    key = band_keys(band_values(codes.level, bits, bands), codes.dim)
                    who = pa.array(np.repeat(some, bands))
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.tile(np.arange(bands, dtype=np.int16), len(some))), b.column(0).take(who), b.column(1).take(who)], names=dealt.names)

    member = nodes.select("id", "code").mapInArrow(deal, dealt)
    sizes = stage(member.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket-sizes")
    some = sizes.agg(F.count(F.lit(1)), F.sum(F.ceil(F.col("size") / BLOCK) * F.col("size"))).head()
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    spread = member.join(F.broadcast(sizes) if some[0] <= SENT else sizes, "key")
    spread = spread.select("key", "band", "id", "code", blocks.alias("blocks"), F.pmod(F.xxhash64(F.lit("block"), "id"), blocks.cast("long")).cast("int").alias("block"))
    spread = spread.select("key", "band", "id", "code", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    spread = spread.select("key", "band", "id", "code", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))

    def cell(rows: int):
        return F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, int(rows) // 4000)))

    left = T.StructType([T.StructField("key", T.LongType()), T.StructField("band", T.ShortType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("id", T.LongType())])

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        keep = []
        for at, codes, cols in _buckets(group, ["key", "band", "i", "j", "block"]):
            values = band_values(codes.level, bits, bands)
            for p, q in _undecided(codes, values, cols["band"], _firsts(cols), cols["block"], cols["i"] != cols["j"], cosine):
                keep += [at[np.unique(p)], at[np.unique(q)]]
        return group.take(pa.array(np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *keep])))).select(left.names)

    def link(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        a_out, b_out, n_out = [], [], []
        for at, codes, cols in _buckets(group, ["key", "band", "i", "j", "block", "n"]):
            values = band_values(codes.level, bits, bands)
            x = unit(np.frombuffer(b"".join(group.column("v").take(pa.array(at)).to_pylist()), dtype=kind).reshape(len(at), -1))
            count, forest, w = np.zeros(len(at), dtype=np.int64), _Forest(len(at)), cols["n"]
            for p, q in _undecided(codes, values, cols["band"], _firsts(cols), cols["block"], cols["i"] != cols["j"], cosine):
                ok = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                p, q = p[ok], q[ok]
                np.add.at(count, p, w[q])
                np.add.at(count, q, w[p])
                for y, z in zip(p.tolist(), q.tolist(), strict=True):
                    forest.join(y, z)
            some = np.flatnonzero(count)
            a_out.append(at[some])
            b_out.append(at[np.array([forest.root(y) for y in some.tolist()], dtype=np.int64)])
            n_out.append(count[some])
        a, b, n = (np.concatenate([np.zeros(0, dtype=np.int64), *z]) for z in (a_out, b_out, n_out))
        return pa.table({"a": group.column("id").take(pa.array(a)), "b": group.column("id").take(pa.array(b)), "links": pa.array(n)})

    met = stage(spread.withColumn("cell", cell(some[1] or 0)).groupBy("cell").applyInArrow(meet, left), "undecided")
    met_rows = met.count()
    whole = met.join(nodes.drop("first"), "id").withColumn("cell", cell(met_rows))
    found = whole.groupBy("cell").applyInArrow(link, "a long, b long, links long")
    found = stage(found, "vector-links")
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    comp = stage(connected_components(found.select("a", "b")), "vector-components")
    least = comp.join(nodes.select("id", "first"), "id").groupBy("component").agg(F.min("first").alias("smallest"), F.count(F.lit(1)).alias("nodes"))
    comp = keyed_join(comp, stage(least, "smallest-ids"), "component", "nodes").select("id", "smallest")
    # copies of a vector link with each other, and with all that one of them links with
    full = nodes.select("id", "first", "n", "v").join(links, "id", "left").join(comp, "id", "left").select("v", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("smallest", "first").alias("component"))
    full = stage(full, "vector-nodes")
    # the few vectors with a good part of all rows are sent to every task, so none gets all rows of one
    most = (full.agg(F.sum("n")).head()[0] or 0) / HOT
    hot, cold = (full.where(c).drop("n") for c in (F.col("n") > most, F.col("n") <= most))
    named = good.join(F.broadcast(hot), "v")
    if not is_empty(cold):
        rest = good if is_empty(hot) else good.join(F.broadcast(hot.select("v")), "v", "left_anti")
        named = named.unionByName(rest.join(cold, "v"))
    alone = every.where(F.col("v").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = named.select("id", "n_links", "component").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        p, q = self.root(a), self.root(b)
        if p != q:
            self.up[max(p, q)] = min(p, q)


def op6_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))
