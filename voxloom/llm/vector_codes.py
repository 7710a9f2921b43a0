"""Vector code compression by heap Lloyd (operator 12).

Vectors are cut into parts, and each part position has a codebook that Lloyd's rounds fit. Blocks of vectors keep a heap for each
entry of each codebook: its parts, keyed by how much further the second nearest entry is at least than the own one. When
entries move, what they moved is added up by entry; only parts whose key that sum has reached are popped from the heap and
compared with all entries again, exactly. Sums of entries change by what moved, so a round costs its popped parts.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import fresh_path, give_back, keyed_join, stage, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 1024  # vectors of a block, whose heaps lie together
BUCKET = 1 << 26  # about so many bytes of vectors in a bucket: one task of a round
BUCKETS = 50_000  # most buckets; with more bytes they get larger


class Parts:
    """Exact distances of a block's parts to entries. ``x``: (parts, rows, length) whole numbers."""

    def __init__(self, data: bytes, parts: int, dim: int, most: int):
        x = np.frombuffer(data, dtype=kind_of(most)).reshape(-1, parts, dim // parts)
        self.x = x.transpose(1, 0, 2).astype(np.int64)
        # products of whole numbers are exact in doubles as long as all sums are
        self.real = np.float64 if dim // parts * 16 * most * most < 1 << 53 else np.int64

    def squared(self, p: int, rows: np.ndarray, book: np.ndarray) -> np.ndarray:
        """(rows, entries): squared distances of the rows' parts at position p to the entries of its codebook."""
        x, c = self.x[p][rows].astype(self.real), book.astype(self.real)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def kind_of(most: int) -> np.dtype:
    return np.dtype("<i2") if most < 1 << 15 else np.dtype("<i4") if most < 1 << 31 else np.dtype("<i8")


def nearest(d: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lower of equals), and the lower bound of the next one's distance minus the own one."""
    own = d.argmin(axis=1)
    if d.shape[1] == 1:
        return own, np.full(len(d), np.inf)
    two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
    return own, two[:, 1] - two[:, 0] - margin


class Heaps:
    """The heaps of a block: ``own[p]`` has each part's entry, ``heap[p][e]`` (key, row) of the parts of entry e.

    A key is the slack of a part when it was pushed, plus the entry's drift sum of then; once the drift sum reaches it, the
    part may have come nearer to another entry. Heaps whose first key is not reached are not even unpacked.
    """

    def __init__(self, own: np.ndarray, size: np.ndarray, keys: np.ndarray, rows: np.ndarray):
        self.own, self.size, self.keys, self.rows = own, size, keys, rows

    @classmethod
    def first(cls, parts: Parts, books: np.ndarray, margin: float) -> tuple[Heaps, np.ndarray]:
        n, k = parts.x.shape[1], books.shape[1]
        own, slack = (np.stack(z) for z in zip(*(nearest(parts.squared(p, np.arange(n), books[p]), margin) for p in range(len(books))), strict=True))
        order = [np.lexsort([s, o]) for s, o in zip(slack, own, strict=True)]  # ascending keys are a heap
        made = cls(own.astype(np.uint8), np.stack([np.bincount(o, minlength=k) for o in own]), np.stack([s[o] for s, o in zip(slack, order, strict=True)]), np.stack(order).astype(np.uint16))
        return made, _moved(parts, books.shape, [(p, np.arange(n), None, own[p]) for p in range(len(books))])

    def pop(self, parts: Parts, books: np.ndarray, drift: np.ndarray, margin: float) -> np.ndarray:
        """Rescan the parts whose keys the drift has reached; what entries gain and lose by it."""
        moved = []
        for p in range(len(books)):
            ends = np.cumsum(self.size[p])
            begins = ends - self.size[p]
            full = np.flatnonzero(self.size[p])
            hit = full[self.keys[p][begins[full]] <= drift[p][full]]
            if not len(hit):
                continue
            heaps, popped = {}, []
            for e in hit.tolist():
                heaps[e] = heap = self._heap(p, begins[e], ends[e])
                reached = drift[p, e]
                while heap and heap[0][0] <= reached:
                    popped.append(heapq.heappop(heap)[1])
            rows = np.array(popped, dtype=np.int64)
            own, slack = nearest(parts.squared(p, rows, books[p]), margin)
            for key, row, e in zip((slack + drift[p][own]).tolist(), popped, own.tolist(), strict=True):
                if e not in heaps:
                    heaps[e] = self._heap(p, begins[e], ends[e])
                heapq.heappush(heaps[e], (key, row))
            before = self.own[p][rows].astype(np.int64)
            moved.append((p, rows[before != own], before[before != own], own[before != own]))
            self.own[p][rows] = own
            keys, at = [], []
            for e in range(books.shape[1]):
                if e in heaps:
                    keys.append(np.array([x for x, _ in heaps[e]], dtype=np.float64))
                    at.append(np.array([x for _, x in heaps[e]], dtype=np.uint16))
                    self.size[p, e] = len(heaps[e])
                else:
                    keys.append(self.keys[p][begins[e] : ends[e]])
                    at.append(self.rows[p][begins[e] : ends[e]])
            self.keys[p], self.rows[p] = np.concatenate(keys), np.concatenate(at)
        return _moved(parts, books.shape, moved)

    def _heap(self, p: int, begin: int, end: int) -> list[tuple[float, int]]:
        return list(zip(self.keys[p][begin:end].tolist(), self.rows[p][begin:end].tolist(), strict=True))

    def packed(self) -> bytes:
        return b"".join(x.tobytes() for x in (self.size.astype("<i4"), self.keys.astype("<f8"), self.rows.astype("<u2"), self.own))

    @classmethod
    def unpacked(cls, raw: bytes, parts: int, k: int) -> Heaps:
        head = 4 * parts * k
        n = (len(raw) - head) // (11 * parts)
        cut = [0, head, head + 8 * n * parts, head + 10 * n * parts, len(raw)]
        size, keys, rows, own = (np.frombuffer(raw[a:b], dtype=d).reshape(parts, -1).copy() for a, b, d in zip(cut, cut[1:], ("<i4", "<f8", "<u2", "u1"), strict=False))
        return cls(own, size, keys, rows)


def _moved(parts: Parts, shape: tuple, moved: list) -> np.ndarray:
    """(parts, entries, length + 1): sums and counts that entries gain, from (position, rows, entries before, entries now)."""
    out = np.zeros((shape[0], shape[1], shape[2] + 1), dtype=np.int64)
    for p, rows, before, now in moved:
        x = np.concatenate([parts.x[p][rows], np.ones((len(rows), 1), dtype=np.int64)], axis=1)
        np.add.at(out[p], now, x)
        if before is not None:
            np.subtract.at(out[p], before, x)
    return out


def _blocks(rows: DataFrame, most: int, scale: int) -> DataFrame:
    """(block, ids, labels, data) of up to ``BLOCK`` vectors (id, label, v), their components as whole numbers."""
    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), T.StructField("data", T.BinaryType())])
    kind = kind_of(most)

    def run(batches):
        at, held, count = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count >= BLOCK:
                whole = pa.Table.from_batches(held)
                for s in range(0, count - count % BLOCK, BLOCK):
                    yield block(whole.slice(s, BLOCK), at)
                    at += 1
                held, count = whole.slice(count - count % BLOCK).to_batches(), count % BLOCK
        if count:
            yield block(pa.Table.from_batches(held), at)

    def block(t: pa.Table, at: int) -> pa.RecordBatch:
        t = t.combine_chunks()
        ends = pa.array([0, t.num_rows], pa.int32())
        ids, labels = (pa.ListArray.from_arrays(ends, x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x) for x in (t.column(0), t.column(1)))
        v = t.column(2).combine_chunks() if isinstance(t.column(2), pa.ChunkedArray) else t.column(2)
        data = np.floor(v.flatten().to_numpy(zero_copy_only=False) * float(scale)).astype(kind).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), ids, labels, pa.array([data], pa.binary())], names=out.names)

    return rows.select("id", "label", "v").mapInArrow(run, out)


class _Bucketed:
    """Tables of blocks dealt alike, so that they are joined without a shuffle; they lie in the shared folder."""

    def __init__(self, spark: SparkSession, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []

    def write(self, df: DataFrame, name: str) -> str:
        made = f"voxloom_{name}_{uuid.uuid4().hex}"
        df.write.option("path", fresh_path(self.spark, name)).option("compression", "zstd").bucketBy(self.buckets, "block").sortBy("block").saveAsTable(made)
        self.names.append(made)
        return made

    def drop(self) -> None:
        """Forget the tables; what they hold stays in the shared folder like all that is written there."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _summed(state: DataFrame, shape: tuple) -> np.ndarray:
    """The sum of all blocks' ``delta``: a vector for each task, and one row a number to the driver."""

    def run(batches):
        total = np.zeros(math.prod(shape), dtype=np.int64)
        for b in batches:
            for raw in b.column(0):
                total += np.frombuffer(raw.as_buffer(), dtype="<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "n"])

    rows = state.select("delta").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
    out = np.zeros(math.prod(shape), dtype=object)
    for r in rows:
        out[r["at"]] = int(r["n"])
    return out.reshape(shape)


def heap_lloyd(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every vector, code one byte a part, and the codebooks as (parts, entries, length).

    Components count as floor(``scale`` * x). Codebooks begin as the parts of the smallest ids (nulls last, ties by
    the vectors); fewer rows than ``entries`` make fewer entries. Equal distances go to the lower entry, an entry becomes the rounded down
    mean of its parts, and one without parts stays. Rows drop out whose vector is null or holds null or
    non-finite components; so do those of another length than the smallest id's that ``parts`` divides (empty ones too). Repeated rows and ids
    count each; an empty table gives no rows and no entries; components so large that a squared distance is no 64-bit
    number raise an OverflowError; other columns are not read, whatever their names.

    Vectors are dealt to buckets once. A round reads them with their heaps, without a shuffle, and writes the
    heaps anew; the driver gets a sum for each number of the codebooks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{id_col}`"), F.col(f"`{label_col}`"), F.col(f"`{vec_col}`").cast("array<double>")).toDF("id", "label", "v")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & ~bad & (F.size("v") > 0) & (F.size("v") % parts == 0))
    order = [F.col("id").asc_nulls_last(), F.col("v").asc()]
    head = rows.orderBy(*order).limit(1).collect()
    empty = T.StructType([T.StructField("id", vectors.schema[id_col].dataType), T.StructField("label", vectors.schema[label_col].dataType), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    if not head:
        return spark.createDataFrame([], empty), np.zeros((parts, 0, 0), dtype=object)
    dim = len(head[0]["v"])
    rows = rows.where(F.size("v") == dim)
    start = [[math.floor(scale * x) for x in r["v"]] for r in rows.orderBy(*order).limit(entries).collect()]
    n, most = rows.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", F.abs)))).head()
    most = math.ceil(most * scale) + 1 if most * scale < 1 << 62 else 1 << 62
    if dim * 4 * most * most >= 1 << 63:
        raise OverflowError("squared distances of these vectors do not fit in 64 bits")
    books = np.array(start, dtype=np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
    shape = (*books.shape[:2], books.shape[2] + 1)
    margin = 1e-9 * (most + 1)

    size = n * dim * kind_of(most).itemsize
    buckets = int(max(1, min(BUCKETS, -(-n // BLOCK), max(spark.sparkContext.defaultParallelism, size // BUCKET))))
    tables = _Bucketed(spark, buckets)
    try:
        data = tables.write(_blocks(rows, most, scale).repartition(buckets, "block"), "vector_blocks")
        state_type = "block long, state binary, delta binary"

        def state_rows(b, made):
            heaps, deltas = zip(*made, strict=True) if made else ((), ())
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([h.packed() for h in heaps], pa.binary()), pa.array([d.astype("<i8").tobytes() for d in deltas], pa.binary())], names=["block", "state", "delta"])

        def begin(batches):
            for b in batches:
                yield state_rows(b, [Heaps.first(Parts(x.as_buffer(), parts, dim, most), books0, margin) for x in b.column(1)])
            give_back()

        books0 = books
        state = tables.write(spark.table(data).select("block", "data").mapInArrow(begin, state_type), "vector_heaps")
        sums, drift = _summed(spark.table(state), shape), np.zeros(books.shape[:2])
        for nth in range(rounds):
            books, drift = _next(books, sums, drift)
            if nth + 1 < rounds:
                state = tables.write(_joined(spark, data, state, "data").mapInArrow(_popping(books, drift, parts, dim, most, margin, state_rows), state_type), "vector_heaps")
                sums = sums + _summed(spark.table(state), shape)
        coded = stage(_joined(spark, data, state, "data", "ids", "labels").mapInArrow(_coding(books, drift, parts, dim, most, margin), empty), "vector-codes")
    finally:
        tables.drop()
    return coded, books


def _joined(spark: SparkSession, data: str, state: str, *cols: str) -> DataFrame:
    return spark.table(data).select("block", *cols).join(spark.table(state).select("block", "state").hint("merge"), "block").select("block", "state", *cols)


def _next(books: np.ndarray, sums: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks after a round, and for each entry how far it and the farthest other one have moved in all."""
    new = books.copy()
    for p, e in np.ndindex(*books.shape[:2]):
        *total, n = sums[p, e].tolist()
        if n:
            new[p, e] = [x // n for x in total]
    step = np.sqrt(((new - books).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-12)
    others = np.zeros_like(step)
    if step.shape[1] > 1:
        two = np.sort(step, axis=1)[:, -2:]
        others = np.where(np.arange(step.shape[1])[None, :] == step.argmax(axis=1)[:, None], two[:, :1], two[:, 1:])
    return new, drift + step + others


def _popping(books, drift, parts, dim, most, margin, state_rows):
    def run(batches):
        for b in batches:
            made = []
            for raw, x in zip(b.column(1), b.column(2), strict=True):
                heaps = Heaps.unpacked(raw.as_buffer().to_pybytes(), parts, books.shape[1])
                made.append((heaps, heaps.pop(Parts(x.as_buffer(), parts, dim, most), books, drift, margin)))
            yield state_rows(b, made)
        give_back()

    return run


def _coding(books, drift, parts, dim, most, margin):
    """The last assignment: (id, label, code, error) of the vectors of each block."""

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                heaps, x = Heaps.unpacked(b.column(1)[k].as_buffer().to_pybytes(), parts, books.shape[1]), Parts(b.column(2)[k].as_buffer(), parts, dim, most)
                heaps.pop(x, books, drift, margin)
                own = heaps.own.astype(np.int64)
                error = sum(((x.x[p] - books[p][own[p]]) ** 2).sum(axis=1) for p in range(parts))
                codes = np.ascontiguousarray(heaps.own.T)
                yield pa.RecordBatch.from_arrays([b.column(3)[k].values, b.column(4)[k].values, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)], names=["id", "label", "code", "error"])
        give_back()

    return run


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = heap_lloyd(table(spark, sf_dir, "embeddings"))
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    out = keyed_join(coded, labels, "label", "n")
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in SQL: all parts against all entries in each round."""
    floor = "CASE WHEN s < 0 AND s % n <> 0 THEN s // n - 1 ELSE s // n END"
    ctes = [
        """kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"comp AS (SELECT r, (i - 1) // (d // {PARTS}) AS part, (i - 1) % (d // {PARTS}) AS pos, floor({SCALE} * embedding[i]::DOUBLE)::BIGINT AS x FROM (SELECT r, embedding, len(embedding) AS d, unnest(range(1, len(embedding) + 1)) AS i FROM kept))",
        f"book0 AS (SELECT part, r - 1 AS entry, pos, x AS c FROM comp WHERE r <= {ENTRIES})",
    ]
    for k in range(ROUNDS + 1):
        ctes.append(f"dist{k} AS MATERIALIZED (SELECT r, part, entry, sum((x - c) * (x - c))::BIGINT AS d FROM comp JOIN book{k} USING (part, pos) GROUP BY r, part, entry)")
        ctes.append(f"own{k} AS MATERIALIZED (SELECT r, part, entry, d FROM dist{k} QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, entry) = 1)")
        if k < ROUNDS:
            ctes.append(f"mean{k} AS (SELECT part, entry, pos, {floor} AS c FROM (SELECT part, entry, pos, sum(x)::BIGINT AS s, count(*) AS n FROM own{k} JOIN comp USING (r, part) GROUP BY ALL))")
            ctes.append(f"book{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN mean{k} m USING (part, entry, pos))")
    ctes.append(f"coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM own{ROUNDS} GROUP BY r)")
    ctes.append("sha AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book" + str(ROUNDS) + ")")
    return "WITH " + ",\n".join(ctes) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (r), sha"


SQL = _sql()
