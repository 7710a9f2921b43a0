"""Strokes folded into label maps as a stream: bricks of labels and differences of edits are the state of a session.

Events (session, seq, op, ...) are ``paint`` (a stroke from (ax, ay, az) to (bx, by, bz)), ``end`` (of an edit of several
strokes), ``undo`` and ``redo``. Stamps are expanded by column expressions before the state, and a session's state
changes only in the bricks that they touch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxloom.functions.jsnum import round_half_up
from voxloom.operators.voxels import Grid
from voxloom.streaming.sessions import CAP

EDGE = 32  # voxels a side of a brick of labels
EVENT = "session string, seq long, op string, axis string, ax long, ay long, az long, bx long, by long, bz long, size_mm double, shape string, mode string, lo double, hi double, value int, locked array<int>"
OUT = "session string, seq long, kind string, op string, changed long, depth int, redo int, brick long, labels binary"
_PLANE = {"axial": "xy", "coronal": "xz", "sagittal": "yz"}


def stamped(events: DataFrame, grid: Grid, vox: DataFrame | None = None) -> DataFrame:
    """A row for each voxel (i) that an event's stamps cover, ``hit`` if it is to be set; other events have one row without a voxel.

    A stroke stamps a disc or square at each step of its longest axis. In mode ``threshold`` only voxels of ``vox`` (i, v) within
    lo and hi are set; a voxel that several stamps cover may come several times. Works on streams and tables.
    """
    e = events.withColumn("_paint", F.col("op") == "paint")
    steps = F.greatest(*(F.abs(F.col(f"b{c}") - F.col(f"a{c}")) for c in "xyz"), F.lit(1))
    e = e.withColumn("_n", F.when(F.col("_paint"), steps).otherwise(0)).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    share = F.col("_k") / F.greatest("_n", F.lit(1))
    e = e.withColumns({f"_c{c}": round_half_up(F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * share) for c in "xyz"})
    radius = F.greatest(F.lit(0.25), F.col("size_mm") / 2)
    step = {"x": grid.sx, "y": grid.sy, "z": grid.sz}

    def by_axis(pick):
        return F.when(F.col("axis") == "axial", pick("xy")).when(F.col("axis") == "coronal", pick("xz")).otherwise(pick("yz"))

    for n, k in (("_du", 0), ("_dv", 1)):
        reach = by_axis(lambda plane, k=k: F.ceil(radius / max(step[plane[k]], 0.001)))
        e = e.withColumn(n, F.explode(F.when(F.col("_paint"), F.sequence(-reach, reach)).otherwise(F.array(F.lit(0).cast("long")))))
    round_ = by_axis(lambda plane: F.hypot(F.col("_du") * step[plane[0]], F.col("_dv") * step[plane[1]])) <= radius
    at = {}
    for c in "xyz":
        moved = F.lit(0)
        for name, plane in _PLANE.items():
            if c in plane:
                moved = F.when(F.col("axis") == name, F.col("_du" if plane[0] == c else "_dv")).otherwise(moved)
        at[c] = F.col(f"_c{c}") + moved
    inside = grid.inside(at["x"], at["y"], at["z"]) & ((F.col("shape") != "circle") | round_)
    e = e.withColumn("i", F.when(F.col("_paint") & inside, grid.index(at["x"], at["y"], at["z"])).cast("long"))
    e = e.where(~F.col("_paint") | F.col("i").isNotNull() | ((F.col("_k") == 0) & (F.col("_du") == 0) & (F.col("_dv") == 0)))
    e = e.select("session", "seq", "op", "mode", "value", "locked", "lo", "hi", "i")
    hit = F.col("mode") != "threshold"
    if vox is not None:
        e = e.join(vox.select("i", F.col("v").cast("double").alias("_v")), "i", "left")
        hit = hit | F.coalesce(F.coalesce("_v", F.lit(0.0)).between(F.col("lo"), F.col("hi")), F.lit(False))
    return e.select("session", "seq", "op", "mode", "value", "locked", "i", hit.alias("hit"))


class LabelBricks:
    """A label map as bricks that are unpacked when touched; ``load`` gives a brick's bytes or None."""

    def __init__(self, grid: Grid, load):
        self.grid, self.load, self.open, self.changed = grid, load, {}, set()
        self.across = [-(-n // EDGE) for n in (grid.width, grid.height, grid.depth)]

    def _place(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y, z = i % self.grid.width, i // self.grid.width % self.grid.height, i // (self.grid.width * self.grid.height)
        brick = (z // EDGE * self.across[1] + y // EDGE) * self.across[0] + x // EDGE
        return brick, (z % EDGE * EDGE + y % EDGE) * EDGE + x % EDGE

    def _brick(self, b: int) -> np.ndarray:
        if b not in self.open:
            raw = self.load(b)
            self.open[b] = np.zeros(EDGE**3, dtype="<u2") if raw is None else unpacked(raw)
        return self.open[b]

    def get(self, i: np.ndarray) -> np.ndarray:
        brick, at = self._place(i)
        out = np.zeros(len(i), dtype=np.int64)
        for b in np.unique(brick).tolist():
            out[brick == b] = self._brick(b)[at[brick == b]]
        return out

    def put(self, i: np.ndarray, label: np.ndarray) -> None:
        brick, at = self._place(i)
        for b in np.unique(brick).tolist():
            self._brick(b)[at[brick == b]] = label[brick == b]
            self.changed.add(b)


def packed(labels: np.ndarray) -> bytes:
    return zlib.compress(labels.astype("<u2").tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), dtype="<u2").copy()


def painted(labels: LabelBricks, i: np.ndarray, hit: np.ndarray, mode: str, value: int, locked) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(voxels, labels before, labels after) of one stroke; voxels of locked labels other than the own one stay out."""
    i, first = np.unique(i, return_index=True)
    hit, now = hit[first], labels.get(i)
    free = (now == value) | ~np.isin(now, list(locked))
    i, hit, now = i[free], hit[free], now[free]
    after = np.where(now == value, 0, now) if mode == "erase" else np.where(hit, value, now)
    labels.put(i[after != now], after[after != now])
    return i, now, after


class _Fold(StatefulProcessor):
    """State of a session: bricks of labels, differences of its edits, and the stacks of edits done and undone."""

    def __init__(self, grid: Grid, cap: int = CAP):
        self.grid, self.cap = grid, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bricks = handle.getMapState("bricks", "brick long", "labels binary")
        self.edits = handle.getMapState("edits", "edit long", "diff binary")
        self.stacks = handle.getValueState("stacks", "done array<long>, undone array<long>, edit long, open boolean, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, undone, edit, is_open, last = ([], [], 0, False, -1) if not self.stacks.exists() else self.stacks.get()
        done, undone = list(done), list(undone)
        labels = LabelBricks(self.grid, lambda b: self.bricks.getValue((b,))[0] if self.bricks.containsKey((b,)) else None)
        all_rows, out = pd.concat(list(rows)), []
        for seq, event in all_rows[all_rows["seq"] > last].groupby("seq", sort=True):
            op, changed, last = event["op"].iloc[0], 0, int(seq)
            if op == "paint":
                event = event[event["i"].notna()]
                if len(event):
                    one = event.iloc[0]
                    diff = painted(labels, event["i"].to_numpy().astype(np.int64), event["hit"].to_numpy().astype(bool), one["mode"], int(one["value"]), [] if one["locked"] is None else one["locked"])
                    changed = int((diff[1] != diff[2]).sum())
                    if len(diff[0]):
                        self._keep(edit, _joined(self._diff(edit), diff) if is_open else diff)
                        is_open = True
            else:
                if is_open:
                    done, undone, edit, is_open = self._push(done, edit), self._drop(undone), edit + 1, False
                if op in ("undo", "redo"):
                    source, target = (done, undone) if op == "undo" else (undone, done)
                    if source:
                        n = source.pop()
                        i, before, after = self._diff(n)
                        put = before if op == "undo" else after
                        changed = int((before != after).sum())
                        labels.put(i, put)
                        target.append(n)
                        self._drop(target[: -self.cap])
                        del target[: -self.cap]
            out.append((key[0], last, "event", op, changed, len(done), len(undone), None, None))
        for b in sorted(labels.changed):
            raw = packed(labels.open[b])
            self.bricks.updateValue((b,), (raw,))
            out.append((key[0], last, "brick", None, None, None, None, b, raw))
        self.stacks.update((done, undone, edit, is_open, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"changed": "Int64", "depth": "Int32", "redo": "Int32", "brick": "Int64"})

    def _push(self, done: list[int], edit: int) -> list[int]:
        done = [*done, edit]
        self._drop(done[: -self.cap])
        return done[-self.cap :]

    def _drop(self, edits: list[int]) -> list[int]:
        for e in edits:
            self.edits.removeKey((e,))
        return []

    def _keep(self, edit: int, diff) -> None:
        i, before, after = diff
        raw = np.concatenate([i.astype("<i8").view("<u2"), before.astype("<u2"), after.astype("<u2")])
        self.edits.updateValue((edit,), (zlib.compress(raw.tobytes(), 1),))

    def _diff(self, edit: int):
        raw = np.frombuffer(zlib.decompress(self.edits.getValue((edit,))[0]), dtype="<u2")
        n = len(raw) // 6
        return raw[: 4 * n].copy().view("<i8"), raw[4 * n : 5 * n].astype(np.int64), raw[5 * n :].astype(np.int64)

    def close(self) -> None:
        pass


def _joined(old, new):
    """The difference of two strokes of one edit: labels before the first and after the last."""
    i, before, after = (np.concatenate(x) for x in zip(old, new, strict=True))
    at, first = np.unique(i, return_index=True)
    last = len(i) - 1 - np.unique(i[::-1], return_index=True)[1]
    return at, before[first], after[last]


def label_sessions(events: DataFrame, grid: Grid, vox: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """A stream of what events (``EVENT``) change: a row of kind ``event`` for each, and of kind ``brick`` for each brick changed in a batch.

    Undo and redo go back and forth over at most ``cap`` edits; they and ``end`` close an open edit, and a new edit
    clears what was undone. An event whose seq is not over the last one seen counts as a repetition and is left out, so events that
    are sent again change nothing. The session needs the RocksDB state store.
    """
    return stamped(events, grid, vox).groupBy("session").transformWithStateInPandas(_Fold(grid, cap), OUT, "append", "none")


def label_voxels(log: DataFrame, grid: Grid) -> DataFrame:
    """(session, i, label) of the labelled voxels, by the last row of each brick in what ``label_sessions`` has written."""
    newest = F.row_number().over(Window.partitionBy("session", "brick").orderBy(F.desc("seq")))
    bricks = log.where("kind = 'brick'").withColumn("_n", newest).where("_n = 1").select("session", "brick", "labels")
    across = [-(-n // EDGE) for n in (grid.width, grid.height, grid.depth)]

    def run(frames):
        for f in frames:
            for session, brick, raw in f.itertuples(index=False):
                labels = unpacked(raw)
                at = np.flatnonzero(labels)
                x = brick % across[0] * EDGE + at % EDGE
                y = brick // across[0] % across[1] * EDGE + at // EDGE % EDGE
                z = brick // (across[0] * across[1]) * EDGE + at // EDGE**2
                yield pd.DataFrame({"session": session, "i": (z * grid.height + y) * grid.width + x, "label": labels[at].astype(np.int32)})

    return bricks.mapInPandas(run, "session string, i long, label int")
