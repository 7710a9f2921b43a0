import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom.llm import best_fit as B
from voxloom.llm import tokens


def _brackets(sizes):
    """Pairs of (piece, gap): each gap, by size, takes the last free piece before it."""
    stack, out = [], set()
    for s, k, i in sorted((s, k, i) for i, (s, k) in enumerate(sizes)):
        if k == B.PIECE:
            stack.append(i)
        elif stack:
            out.add((stack.pop(), i))
    return out


def test_sweeps_of_ranges_match_like_one_sweep():
    r = random.Random(1)
    for _ in range(150):
        sizes = [(r.randint(1, 12), r.randint(0, 1)) for _ in range(r.randint(1, 60))]
        want, counts, cells = _brackets(sizes), {}, {}
        for x in sizes:
            counts[x] = counts.get(x, 0) + 1
        place = {(s, k): (f, n) for s, k, f, n in B.ranges(counts, r.choice([3, 5, 100]))}
        for i, x in enumerate(sizes):
            first, n = place[x]
            cells.setdefault(first + i % n, []).append((*x, i))
        pairs, left, free = [], [], {}
        for c in sorted(cells):
            size, kind, ids = zip(*cells[c], strict=True)
            got = B.sweep(pa.table({"cell": pa.array([c] * len(ids)), "kind": pa.array(kind), "id": pa.array(ids), "size": pa.array(size)})).to_pylist()
            pairs += [(x["id"], x["partner"]) for x in got if x["partner"] is not None]
            rest = [x for x in got if x["partner"] is None]
            free |= {(c, x["kind"], x["place"]): x["id"] for x in rest}
            left.append((c, sum(x["kind"] == B.PIECE for x in rest), sum(x["kind"] == B.GAP for x in rest)))
        for own, last, cell, lo, n, _ in B.between(left):
            pairs += [(free[own, B.PIECE, last - k], free[cell, B.GAP, lo + k]) for k in range(n)]
        by_size = lambda x: sorted((sizes[a], sizes[b]) for a, b in x)
        assert by_size(pairs) == by_size(want) and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


def _decreasing(lengths, size):
    """Best-fit decreasing, one piece at a time: number of sequences."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        fit = [k for k, g in enumerate(gaps) if g >= x]
        if fit:
            gaps[min(fit, key=gaps.__getitem__)] -= x
        else:
            gaps.append(size - x)
    return len(gaps)


@pytest.mark.parametrize("kind", ["mixed", "tiny", "equal", "halves", "thirds"])
def test_few_sequences(spark, monkeypatch, kind):
    monkeypatch.setattr(B, "CELL", 50)
    r = np.random.default_rng(2)
    size = 256
    lengths = {"mixed": np.minimum(255, r.lognormal(3.5, 1.2, 900).astype(int) + 1), "tiny": r.integers(1, 9, 900), "equal": np.full(600, 100), "halves": r.integers(120, 140, 300), "thirds": r.integers(60, 100, 400)}[kind].tolist()
    got = B.assign(spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "pid long, length long").repartition(3), size).collect()
    assert sorted(x["pid"] for x in got) == list(range(len(lengths)))
    full = {}
    for x in got:
        assert x["length"] == lengths[x["pid"]]
        full[x["sid"]] = full.get(x["sid"], 0) + x["length"]
    assert max(full.values()) <= size
    assert len(full) <= 1.02 * _decreasing(lengths, size) + 1


def test_pieces_are_the_librarys(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    texts = ["", None, " ", "the end " * 3000, "a b c", "a b c", "é日本 x", *("word " * n for n in range(1, 60))]
    docs = spark.createDataFrame([(i if i else None, x) for i, x in enumerate(texts)], "doc_id long, text string").withColumns({"pid": F.lit("x"), "sid": F.lit(1), "Size": F.lit(None).cast("string")})
    for size in (64, 4096):
        got = B.best_fit(docs.repartition(3), size=size, with_ids=True)
        rows = got.collect()
        joined = {r["sequence_id"]: r["ids"] for r in tokens.sequences(got, size).collect()}
        by, ends = {}, {}
        for r in rows:
            by.setdefault(r["doc_id"], []).append(r)
            ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for i, x in enumerate(texts):
            ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4")
            own = sorted(by[i if i else None], key=lambda r: r["piece"])
            assert [(r["piece"], r["start"], r["length"]) for r in own] == [(k, k * size, min(size, len(ids) - k * size)) for k in range(-(-len(ids) // size))]
            for r in own:
                raw = ids[r["start"] : r["start"] + r["length"]].tobytes()
                assert r["ids_crc32"] == zlib.crc32(raw) and joined[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == raw
        for pieces in ends.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= size


def test_empty_table(spark):
    assert B.best_fit(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    full = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in B.best_fit(full, size=2).collect()] == [(1, 0, 0, 2)]
