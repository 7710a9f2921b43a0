import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import vector_codes as V


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Lloyd's rounds over all parts: [(id, label, code, error)] and the codebooks, in whole numbers of any size."""
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(scale * c) for c in r[1]] for r in fine], dtype=object)
    cut = x.reshape(len(x), parts, -1).transpose(1, 0, 2)
    books = cut[:, :entries].copy()

    def nearest():
        d = [((cut[p][:, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
        own = [[min(range(books.shape[1]), key=lambda e: (row[e], e)) for row in one] for one in d]
        return own, [sum(d[p][i][own[p][i]] for p in range(parts)) for i in range(len(x))]

    for _ in range(rounds):
        own, _ = nearest()
        for p, e in np.ndindex(*books.shape[:2]):
            mine = cut[p][np.array(own[p]) == e]
            if len(mine):
                books[p, e] = [int(s) // len(mine) for s in mine.sum(axis=0)]
    own, error = nearest()
    return [(r[0], r[2], bytes(own[p][i] for p in range(parts)), error[i]) for i, r in enumerate(fine)], books


def _rows(n, dim, seed=1, scale=1.0):
    r = np.random.default_rng(seed)
    v = np.float32(r.normal(size=(n, dim)) * scale).tolist()
    v[5] = v[6] = v[7]
    return [(int(i * 7 % n) // 2, v[i], [None, 1, 1, 2][i % 4]) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"block": F.lit("x"), "Ids": F.lit(None).cast("string"), "v": F.lit(1)})


@pytest.mark.parametrize(("n", "dim", "scale"), [(400, 16, 1.0), (9, 8, 0.001), (300, 64, 300.0), (120, 8, 30000.0)])
def test_equals_lloyd(spark, n, dim, scale):
    odd = [(3, None, 1), (-9, [1.0, None] * (dim // 2), 1), (-8, [float("nan")] * dim, None), (-7, [float("inf")] * dim, 2), (-6, [], 1), (None, [0.5] * dim, 1)]
    rows = [*_rows(n, dim, scale=scale), *odd]
    coded, books = V.heap_lloyd(_frame(spark, rows).repartition(5))
    got, (want, fit) = coded.collect(), plain([r for r in rows if r[1] != []])
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0, bytes(r[2]), r[3])
    assert sorted(((r["id"], r["label"], bytes(r["code"]), r["error"]) for r in got), key=key) == sorted(want, key=key)
    assert books.tolist() == fit.tolist()
    assert V.books_sha256(books) == hashlib.sha256(",".join(str(x) for p in fit for e in p for x in e).encode()).hexdigest()


def test_later_rounds_pop_few():
    x = np.floor(np.random.default_rng(3).normal(size=(1000, 16)) * 4096).astype(np.int64)
    most = int(np.abs(x).max()) + 1
    parts = V.Parts(x.astype(V.kind_of(most)).tobytes(), 8, 16, most)
    seen = []
    parts.squared = lambda p, rows, book, real=parts.squared: seen.append(len(rows)) or real(p, rows, book)
    books, margin = parts.x[:, :16].copy(), 1e-6
    heaps, sums = V.Heaps.first(parts, books, margin)
    drift = np.zeros(books.shape[:2])
    for _ in range(12):
        seen.clear()
        books, drift = V._next(books, sums.astype(object), drift)
        heaps = V.Heaps.unpacked(heaps.packed(), 8, 16)
        sums = sums + heaps.pop(parts, books, drift, margin)
    assert sum(seen) < 0.3 * x.shape[0] * 8


def test_other_lengths_and_empty(spark):
    rows = [(1, [1.0] * 8, 1), (0, [1.0] * 7, 1), (2, [2.0] * 16, 1), (3, [2.0] * 8, None)]
    coded, books = V.heap_lloyd(_frame(spark, rows))
    assert [(r["id"], r["error"]) for r in coded.orderBy("id").collect()] == [(1, 0), (3, 0)] and books.shape == (8, 2, 1)
    coded, books = V.heap_lloyd(_frame(spark, []))
    assert coded.collect() == [] and books.size == 0
    with pytest.raises(OverflowError):
        V.heap_lloyd(_frame(spark, [(1, [3e38] * 8, 1)]))
