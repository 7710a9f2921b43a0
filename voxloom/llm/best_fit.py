"""Best-fit packing in bulk-synchronous rounds (operator 11).

Every round sorts the pieces left and the gaps of open sequences by size, in ranges that the counts of sizes give. A
sweep over a range matches each gap with the largest piece before it that is still free, as brackets are matched; what a range
leaves is matched between ranges by rank. Gaps shrink by what they got, and the next round begins.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import slices_by_bytes, stage, table
from voxloom.llm.tokens import SEQUENCE, default_tokenizer, word_ids

END = 1
CELL = 8192  # pieces and gaps that one task sweeps; one size with more is split
CELLS = 100_000  # about so many ranges at most: beyond it they get longer
PIECE, GAP = 0, 1

_SWEPT = "cell long, kind int, id long, size int, partner long, place long"


def pieces_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """(pid, id, piece, start, length, ids_crc32[, ids]): each document's ids and ``end``, cut after every ``size`` ids."""
    path = tokenizer or default_tokenizer()
    out = T.StructType([T.StructField("pid", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])
    if with_ids:
        out = out.add("ids", T.BinaryType())

    def run(batches):
        coder, at = word_ids(path), (TaskContext.get().partitionId() + 1) << 40
        for b in batches:
            for s, k in slices_by_bytes(b.column(1)):
                flat, n = coder.encode(b.column(1).slice(s, k), end)
                first = np.cumsum(n) - n
                pieces = -(-n // size)
                row = np.repeat(np.arange(k), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = nth * size
                length = np.minimum(n[row] - start, size)
                raw = memoryview(flat.astype("<u4").tobytes())
                cut = [raw[4 * x : 4 * (x + m)] for x, m in zip((first[row] + start).tolist(), length.tolist(), strict=True)]
                cols = [pa.array(at + np.arange(len(row))), b.column(0).slice(s, k).take(pa.array(row)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
                at += len(row)
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array([bytes(c) for c in cut], pa.binary())] if with_ids else [])], names=out.names)
        coder.forget()

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).toDF("id", "text").mapInArrow(run, out)


def sweep(group: pa.Table) -> pa.Table:
    """Match the gaps of one range with its pieces; what is left gets its place among those left of its kind.

    Sizes ascend, a piece before a gap of the same size. A piece opens a bracket and a gap closes the last one
    open: the steps over one depth alternate, so an opening step and the closing one that comes next at its depth are a pair.
    """
    group = group.combine_chunks()
    kind, ids, size = (group.column(c).to_numpy() for c in ("kind", "id", "size"))
    order = np.lexsort([ids, kind, size])
    kind, ids, size = kind[order], ids[order], size[order]
    depth = np.cumsum(np.where(kind == PIECE, 1, -1)) + kind
    by = np.argsort(depth, kind="stable")
    pair = np.flatnonzero((depth[by][1:] == depth[by][:-1]) & (kind[by][:-1] == PIECE) & (kind[by][1:] == GAP))
    piece, gap = by[pair], by[pair + 1]
    free = np.ones(len(kind), dtype=bool)
    free[piece] = free[gap] = False
    left = np.flatnonzero(free)
    is_gap = kind[left] == GAP
    place = np.where(is_gap, np.cumsum(is_gap), np.cumsum(~is_gap)) - 1
    rows, none = np.concatenate([piece, left]), pa.nulls(len(left), pa.int64())
    partner = pa.concat_arrays([pa.array(ids[gap], pa.int64()), none])
    places = pa.concat_arrays([pa.nulls(len(piece), pa.int64()), pa.array(place, pa.int64())])
    cell = pa.array(np.full(len(rows), group.column("cell")[0].as_py(), dtype=np.int64))
    return pa.table({"cell": cell, "kind": pa.array(kind[rows].astype(np.int32)), "id": pa.array(ids[rows]), "size": pa.array(size[rows].astype(np.int32)), "partner": partner, "place": places})


def ranges(counts: dict[tuple[int, int], int], most: int) -> list[tuple[int, int, int, int]]:
    """(size, kind, first cell, cells) for the counts of (size, kind), in order: cells of at most about ``most`` rows."""
    out, cell, used = [], 0, 0
    for (size, kind), n in sorted(counts.items()):
        if used and used + n > most:
            cell, used = cell + 1, 0
        split = -(-n // most)
        out.append((size, kind, cell, split))
        cell, used = (cell + split, 0) if split > 1 else (cell, used + n)
    return out


def between(left: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Matches between ranges: (piece's cell, its last place, gap's cell, its first place, how many, number of the first).

    ``left``: (cell, pieces, gaps) that ranges have left, by cell. A range's gaps take the pieces
    of the ranges before it, the last ones first.
    """
    stack, out, made = [], [], 0
    for cell, pieces, gaps in left:
        taken = 0
        while stack and taken < gaps:
            own, free = stack.pop()
            n = min(free, gaps - taken)
            out.append((own, free - 1, cell, taken, n, made))
            taken, made = taken + n, made + n
            if free > n:
                stack.append((own, free - n))
        if pieces:
            stack.append((cell, pieces))
    return out


def _local(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    cols = list(zip(*rows, strict=True)) or [[] for _ in names]
    return spark.createDataFrame(pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)}))


def _counts(df: DataFrame, *cols: str) -> list[tuple]:
    """Counts by columns of few values (sizes, ranges)."""
    return [tuple(r) for r in df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).collect()]


def assign(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """(pid, sid, length) for ``pieces`` (pid, length) shorter than ``size``: pieces of one sid have at most ``size`` together.

    A round opens as many new sequences as the pieces too long for every gap need at least (at first all pieces). A gap that
    holds the longest piece left more than once takes part as so many equal gaps, so rounds follow the logarithm of the
    sizes and not the number of pieces of a sequence. The driver sees counts by size and by range only.
    """
    spark = pieces.sparkSession
    left = pieces.select(F.col("pid").alias("id"), F.col("length").cast("int").alias("size"))
    have = dict(_counts(left, "size"))
    gaps, open_gaps, opened = None, {}, 0
    placed = []
    while have:
        shortest, longest = min(have), max(have)
        room = max(open_gaps, default=0)
        stuck = {x: n for x, n in have.items() if x > room}
        new = max(sum(n for x, n in stuck.items() if 2 * x > size), -(-sum(x * n for x, n in stuck.items()) // size))
        if new:
            fresh = spark.range(opened, opened + new).select(F.col("id").alias("sid"), F.lit(size).alias("gap"))
            gaps, opened = fresh if gaps is None else gaps.unionByName(fresh), opened + new
            open_gaps[size] = open_gaps.get(size, 0) + new
        times = F.greatest(F.lit(1), F.floor(F.col("gap") / longest)).cast("int")
        parts = gaps.where(F.col("gap") >= shortest).select("sid", (F.col("gap") / times).cast("int").alias("size"), F.explode(F.sequence(F.lit(1), times)).alias("nth"))
        counts = {(x, PIECE): n for x, n in have.items()}
        for g, n in open_gaps.items():
            if g >= shortest:
                k = max(1, g // longest)
                counts[g // k, GAP] = counts.get((g // k, GAP), 0) + n * k
        most = max(CELL, sum(counts.values()) // CELLS)
        cells = F.broadcast(_local(spark, ranges(counts, most), ["size", "kind", "first", "cells"]))
        rows = left.select("id", "size", F.lit(PIECE).alias("kind"), F.col("id").alias("by")).unionByName(parts.select(F.col("sid").alias("id"), "size", F.lit(GAP).alias("kind"), F.xxhash64("sid", "nth").alias("by")))
        rows = rows.join(cells, ["size", "kind"]).select((F.col("first") + F.pmod(F.xxhash64("by"), F.col("cells"))).alias("cell"), "kind", "id", "size")
        swept = stage(rows.groupBy("cell").applyInArrow(sweep, _SWEPT), "swept")

        free = swept.where(F.col("partner").isNull())
        kinds: dict[tuple[int, int], list] = {}
        for cell, kind, x, n in sorted(_counts(free, "cell", "kind", "size")):
            kinds.setdefault((cell, kind), []).append((x, n))
        total = {k: sum(n for _, n in v) for k, v in kinds.items()}
        across = between([(c, total.get((c, PIECE), 0), total.get((c, GAP), 0)) for c in sorted({c for c, _ in kinds})])
        now = swept.where(F.col("partner").isNotNull()).select(F.col("id").alias("pid"), F.col("partner").alias("sid"), F.col("size").alias("length"))
        left = free.where(F.col("kind") == PIECE)
        if across:
            # of each range the last pieces are taken: those from a place on
            first = {}
            for own, last, _, _, n, _ in across:
                first[own] = min(first.get(own, last + 1), last - n + 1)
            runs = F.broadcast(_local(spark, [(own, PIECE, last - n + 1, last, at + n - 1, -1) for own, last, _, _, n, at in across] + [(cell, GAP, lo, lo + n - 1, at, 1) for _, _, cell, lo, n, at in across], ["cell", "kind", "lo", "hi", "at", "step"]))
            numbered = free.join(runs, ["cell", "kind"]).where(F.col("place").between(F.col("lo"), F.col("hi")))
            numbered = numbered.select((F.col("at") + F.col("step") * (F.col("place") - F.col("lo"))).alias("match"), "kind", "id", "size")
            p, g = (numbered.where(F.col("kind") == k) for k in (PIECE, GAP))
            far = p.select("match", F.col("id").alias("pid"), F.col("size").alias("length")).join(g.select("match", F.col("id").alias("sid")), "match")
            now = now.unionByName(stage(far.select("pid", "sid", "length"), "matched-far"))
            cut = F.broadcast(_local(spark, list(first.items()), ["cell", "taken"]))
            left = left.join(cut, "cell", "left").where(F.col("taken").isNull() | (F.col("place") < F.col("taken")))
            for cell, taken in first.items():
                rest, kept = taken, []
                for x, n in kinds[cell, PIECE]:
                    kept.append((x, min(n, rest)))
                    rest -= min(n, rest)
                kinds[cell, PIECE] = kept
        placed.append(now)
        left = left.select("id", "size")
        have = {}
        for (_, kind), v in kinds.items():
            for x, n in v if kind == PIECE else ():
                if n:
                    have[x] = have.get(x, 0) + n
        got = now.groupBy("sid").agg(F.sum("length").alias("got"))
        gaps = gaps.join(got, "sid", "left").select("sid", (F.col("gap") - F.coalesce("got", F.lit(0))).cast("int").alias("gap"))
        gaps = stage(gaps.where(F.col("gap") >= min(have, default=size + 1)), "gaps")
        open_gaps = dict(_counts(gaps, "gap")) if have else {}
    out = placed[0] if placed else left.select(F.col("id").alias("pid"), F.col("id").alias("sid"), F.col("size").alias("length"))
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def best_fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """Documents packed whole into few sequences of at most ``size`` ids; only longer ones are cut, after every ``size``.

    Columns: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for: ``tokens.sequences`` joins them).
    A null or empty text is one piece of length 1 (its end id); repeated rows and ids are packed each; a null id stays null; an
    empty table gives no rows; a text of any length is encoded whole; only the two named columns are read, so other
    columns' names do not matter. Pieces of one size are equal to the packing, ties go by piece number. A full piece is
    a sequence of its own. Sequence ids are unique, in no order and with holes.
    """
    made = stage(pieces_of(docs, id_col, text_col, tokenizer, size, end, with_ids), "fit-pieces", "zstd")
    whole = F.col("length") == size
    placed = assign(made.where(~whole).select("pid", "length"), size)
    before = Window.partitionBy("sid").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("pid", F.col("sid").alias("sequence_id"), F.coalesce(F.sum(F.col("length").cast("long")).over(before), F.lit(0)).alias("offset"))
    cols = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"), *(["ids"] if with_ids else [])]
    alone = made.where(whole).withColumn("sequence_id", F.col("pid")).withColumn("offset", F.lit(0).cast("long"))
    return alone.select(*cols).unionByName(made.where(~whole).join(placed, "pid").select(*cols))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))
