"""Strokes as a stream against a fold over whole label maps."""

import random

import numpy as np
import pyarrow as pa
import pytest

from voxloom.operators.voxels import Grid
from voxloom.streaming import strokes

GRID = Grid(40, 37, 9, 0.5, 0.7, 2.0)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def _events(session, n, seed):
    r = random.Random(seed)
    out = []
    for k in range(n):
        op = r.choice(["paint", "paint", "paint", "end", "undo", "redo"])
        a = [r.randint(-2, m + 1) for m in (40, 37, 9)]
        axis = r.choice(["axial", "coronal", "sagittal"])
        b = [max(-2, c + r.randint(-5, 5)) for c in a]
        fixed = {"axial": 2, "coronal": 1, "sagittal": 0}[axis]
        b[fixed] = a[fixed]
        out.append((session, k, op, axis, *a, *b, r.choice([0.1, 2.0, 5.0]), r.choice(["circle", "square"]), r.choice(["draw", "draw", "erase", "threshold"]), 20.0, 60.0, r.choice([1, 2, 70]), r.choice([None, [], [2], [1, 70]])))
    return out


def _stamp(e, values):
    """Voxels that a stroke covers: index -> hit."""
    _, _, _, axis, *p, size, shape, mode, lo, hi, _, _ = e
    a, b = p[:3], p[3:]
    n, r = max(1, *(abs(v - u) for u, v in zip(a, b, strict=True))), max(0.25, size / 2)
    sides, step = {"axial": (0, 1), "coronal": (0, 2), "sagittal": (1, 2)}[axis], (0.5, 0.7, 2.0)
    reach = [int(np.ceil(r / step[s])) for s in sides]
    got = {}
    for k in range(n + 1):
        c = [int(np.floor(u + (v - u) * (k / n) + 0.5)) for u, v in zip(a, b, strict=True)]
        for du in range(-reach[0], reach[0] + 1):
            for dv in range(-reach[1], reach[1] + 1):
                q = list(c)
                q[sides[0]] += du
                q[sides[1]] += dv
                if all(0 <= x < m for x, m in zip(q, (40, 37, 9), strict=True)) and (shape == "square" or np.hypot(du * step[sides[0]], dv * step[sides[1]]) <= r):
                    i = (q[2] * 37 + q[1]) * 40 + q[0]
                    got[i] = mode != "threshold" or lo <= values[i] <= hi
    return got


def _fold(events, values, cap):
    """Whole label maps as snapshots: (depth, redo) after each event, and the last map."""
    now, undo, redo, before, log = np.zeros(40 * 37 * 9, dtype=int), [], [], None, []
    for e in events:
        op, mode, value, locked = e[2], e[12], e[15], e[16] or []
        if op == "paint":
            touched = False
            snapshot = now.copy()
            for i, hit in _stamp(e, values).items():
                if now[i] != value and now[i] in locked:
                    continue
                touched = True
                if mode == "erase":
                    now[i] = 0 if now[i] == value else now[i]
                elif hit:
                    now[i] = value
            before = snapshot if before is None and touched else before
        else:
            if before is not None:
                undo, redo, before = [*undo, before][-cap:], [], None
            if op == "undo" and undo:
                redo = [*redo, now.copy()][-cap:]
                now = undo.pop()
            elif op == "redo" and redo:
                undo = [*undo, now.copy()][-cap:]
                now = redo.pop()
        log.append((len(undo), len(redo)))
    return log, now


def test_stream_equals_the_fold_over_restarts(rocks, tmp_path):
    values = np.random.default_rng(1).integers(0, 100, 40 * 37 * 9)
    vox = rocks.createDataFrame(pa.table({"i": np.arange(len(values)), "v": values}))
    events = {s: _events(s, 70, k) for k, s in enumerate(("a", "b"))}
    cap = 4
    for start in (0, 30, 50):  # the middle part is sent twice: repetitions change nothing
        for s in events:
            part = events[s][start : {0: 30, 30: 50, 50: 70}[start]] + (events[s][40:50] if start == 50 else [])
            rocks.createDataFrame(part, strokes.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = rocks.readStream.schema(strokes.EVENT).parquet(f"{tmp_path}/in")
        q = strokes.label_sessions(stream, GRID, vox, cap).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").start(f"{tmp_path}/out")
        q.processAllAvailable()
        q.stop()  # the next one begins from the checkpoint
    log = rocks.read.parquet(f"{tmp_path}/out")
    voxels = strokes.label_voxels(log, GRID).collect()
    for s, own in events.items():
        steps, labels = _fold(own, values, cap)
        got = log.where(f"kind = 'event' and session = '{s}'").orderBy("seq").collect()
        assert [(r["seq"], r["op"], r["depth"], r["redo"]) for r in got] == [(k, e[2], *steps[k]) for k, e in enumerate(own)]
        assert {r["i"]: r["label"] for r in voxels if r["session"] == s} == {i: labels[i] for i in np.flatnonzero(labels).tolist()}
        assert max(d for d, _ in steps) == cap and any(r for _, r in steps)


def test_events_without_voxels(rocks, tmp_path):
    rows = [("a", 0, "undo", *[None] * 14), ("a", 1, "paint", "axial", 99, 99, 0, 99, 99, 0, 1.0, "circle", "draw", None, None, 1, None), ("a", 2, "end", *[None] * 14)]
    rocks.createDataFrame(rows, strokes.EVENT).write.parquet(f"{tmp_path}/in")
    q = strokes.label_sessions(rocks.readStream.schema(strokes.EVENT).parquet(f"{tmp_path}/in"), GRID).writeStream.format("memory").queryName("no_voxels").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["seq"], r["changed"], r["depth"], r["redo"]) for r in rocks.table("no_voxels").orderBy("seq").collect()] == [(0, 0, 0, 0), (1, 0, 0, 0), (2, 0, 0, 0)]
