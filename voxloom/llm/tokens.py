"""Token ids: packing into fixed windows (operator 3) and flat binary files (operator 9)."""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import fresh_path, give_back, ragged_take, runs_of, segment_sum, slices_by_bytes, stage, table, text_bytes, word_starts

SEQUENCE = 4096
PACK_END, FILE_END = 2, 1
SHARD_IDS = 64_000_000  # ids after which a task begins its next shard
#: Distinct pieces whose ids a worker keeps between batches; only speed depends on it.
KEPT = 300_000

# Kinds of bytes: white space, letters, digits, punctuation, and what is left to the library.
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KIND = np.full(256, _ODD, dtype=np.uint8)
_KIND[:128] = _SIGN
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
#: One piece by the rules below: letters whose lower case is one letter and which composition leaves alone, a digit, or ASCII signs.
_PIECE = re.compile(r"[a-zà-öø-ÿß]+|[0-9]|[!-/:-@\[-`{-~]+")
#: The rules that ``WordIds`` knows, as the vocabulary file states them.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _cut(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes in lower case, marks where pieces begin, and marks of white space.

    A piece is a run of letters, a digit, or a run of signs. A word, as white space separates them, is
    left whole and in its own case if it holds anything else: bytes outside ASCII that are no Latin-1 letter, an
    apostrophe before a letter, or what may begin a special token.
    """
    kind, low = _KIND[raw], _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    after = raw[lead + 1]
    fine = (after != 0x97) & (after != 0xB7)
    lead, after = lead[fine], after[fine]
    kind[lead] = kind[lead + 1] = _LETTER
    low[lead + 1] = after + np.where(after < 0x9F, 32, 0).astype(np.uint8)
    space = kind == _SPACE
    begins = word_starts(space, offsets)
    start = ~space
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    start |= begins
    odd = [np.flatnonzero(kind == _ODD), np.flatnonzero((raw[:-1] == 39) & (kind[1:] == _LETTER)), np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))]
    if any(map(len, odd)):
        words = np.flatnonzero(begins)
        which = np.unique(np.searchsorted(words, np.concatenate(odd), side="right") - 1)
        begin, end = words[which], np.append(words, len(raw))[which + 1]
        at = np.repeat(begin, end - begin) + np.arange(int((end - begin).sum())) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin)
        start[at] = False
        start[begin] = True
        own = ~space[at]
        low[at[own]] = raw[at[own]]
    return low, start, space


class WordIds:
    """Ids of texts by the tokenizers library, which is asked once for each distinct piece.

    Where the vocabulary file states just the rules in ``_RULES``, texts are cut into pieces as arrays
    of bytes: a piece of plain letters, a digit or plain signs goes straight to the library's BPE
    model, any other word through the whole tokenizer. With a file of other rules every text goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = dict(enumerate(_byte_letters()))
        self._empty()
        with open(path, encoding="utf-8") as f:
            says = json.load(f)
        special = {t["content"] for t in says["added_tokens"]}
        self.known = all(says.get(k) == v for k, v in _RULES.items()) and all(t.startswith("<|") and " " not in t for t in special)

    def _empty(self) -> None:
        """No piece is known: of known ones ``place`` has the number, ``size`` the number of ids, and ``flat`` the ids."""
        self.place: dict[bytes, int] = {}
        self.flat, self.size = array("I"), array("q")

    def _add(self, p: bytes) -> int:
        if p.isalpha():
            ids = [t.id for t in self.model.tokenize(p.decode())]
        elif _PIECE.fullmatch(word := p.decode()):
            ids = [t.id for t in self.model.tokenize(p.decode("latin-1").translate(self.letters))]
        else:
            ids = self.whole.encode(word, add_special_tokens=False).ids
        self.flat.extend(ids)
        self.size.append(len(ids))
        at = self.place[p] = len(self.place)
        return at

    def forget(self) -> None:
        self._empty()
        give_back()

    def encode(self, text: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of all texts, with ``end`` after each, and the number of ids of each."""
        if self.known:
            flat, count = self._by_pieces(text)
        else:
            ids = [e.ids for e in self.whole.encode_batch([t or "" for t in text.to_pylist()], add_special_tokens=False)]
            count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.concatenate([np.zeros(0, dtype=np.uint32), *(np.array(x, dtype=np.uint32) for x in ids)])
        if end is not None:
            flat = np.insert(flat, np.cumsum(count), np.uint32(end))
            count = count + 1
        return flat, count

    def _by_pieces(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > KEPT:
            self._empty()
        raw, offsets = text_bytes(text)
        low, start, space = _cut(raw, offsets)
        codes, pieces = runs_of(low, start, space)
        at = list(map(self.place.get, pieces))
        for i, x in enumerate(at):
            if x is None:
                at[i] = self._add(pieces[i])
        values, size = np.array(self.flat, dtype=np.uint32), np.array(self.size, dtype=np.int64)
        flat, n = ragged_take(values, np.cumsum(size) - size, size, np.array(at, dtype=np.int64)[codes])
        return flat, segment_sum(n, np.searchsorted(np.flatnonzero(start), offsets))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def _tokenized(docs: DataFrame, id_col: str, text_col: str, path: str, end: int) -> DataFrame:
    """(id, part, start, n, ids): ids as little-endian 32-bit, start counts the ids before it in its part."""

    def run(batches):
        coder, part, at = word_ids(path), TaskContext.get().partitionId(), 0
        for b in batches:
            for s, k in slices_by_bytes(b.column(1)):
                piece = b.slice(s, k)
                flat, n = coder.encode(piece.column(1), end)
                ends = np.cumsum(n)
                raw = pa.Array.from_buffers(pa.large_binary(), k, [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int64)), pa.py_buffer(flat.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.full(k, part, dtype=np.int64)), pa.array(at + ends - n), pa.array(n), raw.cast(pa.binary())], names=[id_col, "part", "start", "n", "ids"])
                at += int(ends[-1]) if k else 0
        coder.forget()

    schema = T.StructType([docs.schema[id_col], T.StructField("part", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in schema]))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, size: int = SEQUENCE, end: int = PACK_END, with_ids: bool = False) -> DataFrame:
    """Concatenate all documents and cut at every ``size`` ids; a row for each piece.

    Columns: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).
    Pass one tokenises and writes the ids; the totals of its partitions (one row each) give every
    partition its global base by prefix sums; pass two cuts at fixed windows, each cut inside a
    document leaving a boundary record on either side. No document is shuffled. Only the last sequence
    can be short. A null or empty text is one piece of length 1 (its end id); repeated rows are
    packed again each; an empty table gives no rows; a null id stays null; a text of any length is encoded
    whole; only the two named columns are read, so other columns' names do not matter (an id column called like one of
    the results' columns is no use: rename it).
    """
    spark = docs.sparkSession
    ids = stage(_tokenized(docs, id_col, text_col, tokenizer or default_tokenizer(), end), "pack-ids", "zstd")
    totals = sorted(ids.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("t")).collect())  # a row a partition
    base, at = [], 0
    for part, t in totals:
        base.append((part, at))
        at += t
    bases = spark.createDataFrame(base, "part long, base long")
    placed = ids.join(F.broadcast(bases), "part").select(id_col, F.col("n").alias("doc_tokens"), (F.col("base") + F.col("start")).alias("at"), "ids")

    def run(batches):
        for b in batches:
            n, at, raw = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            pieces = (at + n - 1) // size - at // size + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            seq = at[row] // size + k
            first, last = np.maximum(seq * size, at[row]), np.minimum((seq + 1) * size, at[row] + n[row])
            start, length = first - at[row], last - first
            views = [memoryview(x) for x in raw]
            cut = [views[r][4 * s : 4 * (s + m)] for r, s, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            cols = [b.column(0).take(pa.array(row)), start, length, np.array([zlib.crc32(c) for c in cut], dtype=np.int64), n[row], seq, first - seq * size]
            if with_ids:
                cols.append(pa.array([bytes(c) for c in cut], pa.binary()))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=out.names)

    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))])
    if with_ids:
        out = out.add("ids", T.BinaryType())
    return placed.mapInArrow(run, out)


def sequences(pieces: DataFrame, size: int = SEQUENCE, pad: int = 0) -> DataFrame:
    """Packed sequences from ``pack(..., with_ids=True)``: sequence_id, n_tokens, ids (32-bit, padded to ``size``).

    A sequence has at most ``size`` pieces, so no group is unbounded.
    """
    got = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    fill = F.unhex(F.repeat(F.lit(struct.pack("<I", pad).hex()), (F.lit(size) - F.col("n_tokens")).cast("int")))
    return got.select("sequence_id", "n_tokens", F.concat(joined, fill).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = FILE_END, id_bytes: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write ids in ascending id order; returns the manifest (part, nth, file, n_docs, n_tokens, base).

    A shard is ``<file>.bin`` (flat little-endian unsigned ids of ``id_bytes``), ``<file>.off``
    (n_docs + 1 unsigned 64-bit offsets into it) and ``<file>.arrow`` (the ids of its documents). A task
    begins its next shard after ``shard_ids`` ids, so a shard holds at most these and one slice of texts.
    Rows are dealt by ranges of (id, text hash, where they were read) and sorted in each range, so one id with very many
    rows, or one row very many times, does not meet in one shard. Shard names are new for each attempt of a task, and only those
    in the manifest count, so a task that runs twice does no harm. ``base``, the ids before a shard,
    comes from prefix sums over the shards' totals. Null texts count as empty, null ids come first,
    repeated rows are written each, an empty table has no shards; other columns, whatever their names, are not read;
    a text of any length is written whole.
    """
    spark, tok = docs.sparkSession, tokenizer or default_tokenizer()
    kind = np.dtype(f"<u{id_bytes}")

    def run(batches):
        fs, top = _filesystem(path)
        coder, part = word_ids(tok), TaskContext.get().partitionId()
        nth, shard = 0, None
        for b in batches:
            for s, k in slices_by_bytes(b.column(1)):
                if shard is None:
                    shard = _Shard(fs, top, f"{part:06d}-{nth:04d}-{uuid.uuid4().hex}")
                flat, n = coder.encode(b.column(1).slice(s, k), end)
                if len(flat) and int(flat.max()) > np.iinfo(kind).max:
                    raise ValueError(f"an id does not fit in {id_bytes} bytes")
                shard.add(b.column(0).slice(s, k), flat.astype(kind), n)
                if shard.at >= shard_ids:
                    yield shard.close(part, nth, id_col)
                    nth, shard = nth + 1, None
        coder.forget()
        if shard is not None:
            yield shard.close(part, nth, id_col)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    by = (F.col("id"), F.xxhash64("text"), F.col("place"))
    rows = rows.withColumn("place", F.spark_partition_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    made = stage(rows.mapInArrow(run, _MANIFEST), "token-shards")
    base, at = [], 0
    for r in sorted(made.collect()):  # a row a shard
        base.append((*r, at))
        at += r["n_tokens"]
    return spark.createDataFrame(base, f"{_MANIFEST}, base long")


_MANIFEST = "part long, nth long, file string, n_docs long, n_tokens long"


class _Shard:
    """One shard's files while they are written."""

    def __init__(self, fs, top: str, name: str):
        fs.create_dir(top, recursive=True)
        self.fs, self.top, self.name, self.at = fs, top, name, 0
        self.ends, self.keys = [np.zeros(1, dtype=np.int64)], []
        self.out = fs.open_output_stream(f"{top}/{name}.bin")

    def add(self, keys: pa.Array, flat: np.ndarray, n: np.ndarray) -> None:
        self.out.write(flat.tobytes())
        self.ends.append(self.at + np.cumsum(n))
        self.at = int(self.ends[-1][-1])
        self.keys.append(keys)

    def close(self, part: int, nth: int, id_col: str) -> pa.RecordBatch:
        self.out.close()
        with self.fs.open_output_stream(f"{self.top}/{self.name}.off") as f:
            f.write(np.concatenate(self.ends).astype("<u8").tobytes())
        ids = pa.table({id_col: pa.chunked_array(self.keys)})
        with self.fs.open_output_stream(f"{self.top}/{self.name}.arrow") as f, pa.ipc.new_file(f, ids.schema) as w:
            w.write_table(ids)
        row = {"part": part, "nth": nth, "file": self.name, "n_docs": len(ids), "n_tokens": self.at}
        return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int64()), ("nth", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))


def read_token_files(manifest: DataFrame, path: str, id_col: str = "doc_id", id_type: T.DataType | None = None, id_bytes: int = 2, with_ids: bool = False) -> DataFrame:
    """A row for each document of the shards, read by memory mapping: id, start, n_tokens, ids_crc32 (and ids)."""
    kind = np.dtype(f"<u{id_bytes}")

    def mapped(fs, name):
        if isinstance(fs, pafs.LocalFileSystem):
            return pa.memory_map(name).read_buffer()
        with fs.open_input_file(name) as f:
            return f.read_buffer()

    def run(batches):
        fs, top = _filesystem(path)
        for b in batches:
            for r in b.to_pylist():
                name = f"{top}/{r['file']}"
                off = np.frombuffer(mapped(fs, f"{name}.off"), dtype="<u8").astype(np.int64)
                ids = np.frombuffer(mapped(fs, f"{name}.bin"), dtype=kind)
                keys = pa.ipc.open_file(pa.BufferReader(mapped(fs, f"{name}.arrow"))).read_all().column(0).combine_chunks()
                for s in range(0, len(off) - 1, 4096):
                    o = off[s : s + 4097]
                    raw = [ids[x:y].astype("<u4").tobytes() for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
                    cols = [keys.slice(s, len(raw)), pa.array(r["base"] + o[:-1]), pa.array(np.diff(o)), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*cols, *([pa.array(raw, pa.binary())] if with_ids else [])], names=out.names)

    out = T.StructType([T.StructField(id_col, id_type or T.LongType()), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
    if with_ids:
        out = out.add("ids", T.BinaryType())
    shards = manifest.select("file", "base")
    return shards.repartition(max(1, shards.count())).mapInArrow(run, out)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = fresh_path(spark, "token-files")
    return read_token_files(write_token_files(docs, path), path, id_type=docs.schema["doc_id"].dataType)
