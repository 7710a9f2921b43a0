"""Token counts by rank-synchronous merging of ragged arrays (operator 5).

The vocabulary is that of a sentencepiece BPE model. A text becomes pre-tokens (a run of word
marks and what follows it), the distinct pre-tokens of a batch lie in one flat symbol array with
offsets, and in each round every pre-token applies its best-ranked pair (the leftmost on ties) at
once with all others. What survives is counted; characters outside the vocabulary count one token
for each UTF-8 byte, as byte fallback does.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from voxloom.llm.common import segment_sum, slices_by_bytes, split_words, table

MARK = "▁"
#: Longer pre-tokens are merged with a queue, since they would need as many rounds as merges.
LONG = 256
#: Distinct pre-tokens whose counts a worker keeps between batches; only speed depends on it.
KEPT = 400_000
_NONE = np.int64(1) << 62


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class MergeTable:
    """Pair -> (merged symbol, rank) of one model, as hashed arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        score = np.array([sp.get_score(i) for i in range(n)])
        self.symbol = dict(pieces)
        for p in pieces:
            for ch in p:
                self.symbol.setdefault(ch, len(self.symbol) + n)
        self.base = max(self.symbol.values(), default=0) + 1  # base + k: an unknown character of k bytes
        self.cost = np.ones(self.base + 5, dtype=np.int64)
        for ch, s in self.symbol.items():
            if s >= n:
                self.cost[s] = len(ch.encode())
        self.cost[self.base :] = np.arange(5)
        rank = np.unique(-score, return_inverse=True)[1]
        keys, merged, self.inner = [], [], set()
        for p, i in pieces.items():
            for k in range(1, len(p)):
                self.inner.add(p[k - 1 : k + 1])
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    keys.append((a << 20) | b)
                    merged.append(i)
        keys, merged = np.array(keys, dtype=np.int64), np.array(merged, dtype=np.int64)
        self.pairs = dict(zip(keys.tolist(), zip(rank[merged].tolist(), merged.tolist(), strict=True), strict=True)) if len(keys) else {}
        self.bits = 20
        size = 1 << self.bits
        self.slot_key = np.full(size, -1, dtype=np.int64)
        self.slot_rank = np.zeros(size, dtype=np.int64)
        self.slot_to = np.zeros(size, dtype=np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slot_key[at] < 0
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]], self.slot_rank[at[put]], self.slot_to[at[put]] = keys[left[put]], rank[merged[left[put]]], merged[left[put]]
            left, at = left[~put], (at[~put] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``_NONE`` where a pair does not merge) and merged symbols."""
        keys = (a << 20) | b
        at = self._slot(keys)
        rank, to = np.full(len(keys), _NONE), np.zeros(len(keys), dtype=np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            found = self.slot_key[at]
            hit = found == keys[todo]
            rank[todo[hit]], to[todo[hit]] = self.slot_rank[at[hit]], self.slot_to[at[hit]]
            on = ~hit & (found >= 0)
            todo, at = todo[on], (at[on] + 1) & (len(self.slot_key) - 1)
        return rank, to

    def symbols(self, word: str) -> list[int]:
        get, base = self.symbol.get, self.base
        return [s if (s := get(ch)) is not None else base + len(ch.encode("utf-8", "surrogatepass")) for ch in word]

    def parts(self, word: str) -> list[str]:
        """Cut a long pre-token where no piece of the vocabulary holds both neighbours."""
        cut = [0, *(k for k in range(1, len(word)) if word[k - 1 : k + 1] not in self.inner), len(word)]
        return [word[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def count_long(self, word: str) -> int:
        """The same merges for one very long pre-token, by a queue of (rank, position)."""
        sym = self.symbols(word)
        n = len(sym)
        after, before, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        queue = [(r[0], i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := pairs.get((sym[i] << 20) | sym[i + 1]))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = pairs[(a << 20) | b][1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := pairs.get((sym[i] << 20) | sym[k]):
                    heapq.heappush(queue, (r[0], i, sym[i], sym[k]))
            h = before[i]
            if h >= 0 and (r := pairs.get((sym[h] << 20) | sym[i])):
                heapq.heappush(queue, (r[0], h, sym[h], sym[i]))
        return int(sum(self.cost[s] for s in sym if s >= 0))

    def count(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word (word marks included), merged rank-synchronously."""
        out = np.zeros(len(words), dtype=np.int64)
        owner, symbols, lens = [], [], []
        for i, w in enumerate(words):
            for p in self.parts(w) if len(w) > LONG else (w,):
                if len(p) > LONG:
                    out[i] += self.count_long(p)
                elif p:
                    owner.append(i)
                    symbols.extend(self.symbols(p))
                    lens.append(len(p))
        if not owner:
            return out
        owner, lens = np.array(owner), np.array(lens, dtype=np.int64)
        sym = np.array(symbols, dtype=np.int64)
        start = np.cumsum(lens) - lens
        rank, to = self._ranks(sym, start, lens)
        while True:
            at = np.arange(len(sym), dtype=np.int64)
            key = np.where(rank == _NONE, _NONE, (rank << 40) | at)  # rank first, then the leftmost
            best = np.minimum.reduceat(key, start)
            live = best < _NONE
            done = np.flatnonzero(~live)
            if len(done):
                total = segment_sum(self.cost[sym], np.append(start, len(sym)))
                np.add.at(out, owner[done], total[done])
            if not live.any():
                return out
            # drop what has ended, merge one pair in each of the others
            pos = best[live] & ((np.int64(1) << 40) - 1)
            keep = np.repeat(live, lens)
            sym[pos] = to[pos]
            keep[pos + 1] = False
            place = np.cumsum(keep) - 1
            pos = place[pos]
            sym, rank, to = sym[keep], rank[keep], to[keep]
            owner, lens = owner[live], lens[live] - 1
            start = np.cumsum(lens) - lens
            last = start + lens - 1
            for x, ok in ((pos, pos < last), (pos - 1, pos > start)):
                y = x[ok]
                rank[y], to[y] = self.look(sym[y], sym[y + 1])
            rank[last] = _NONE

    def _ranks(self, sym, start, lens):
        rank, to = np.full(len(sym), _NONE), np.zeros(len(sym), dtype=np.int64)
        if len(sym) > 1:
            rank[:-1], to[:-1] = self.look(sym[:-1], sym[1:])
        rank[start + lens - 1] = _NONE
        return rank, to


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _pretokens(text: str) -> list[str]:
    """Runs of word marks with what follows each, of a text with unusual spacing."""
    return _RUNS.findall(MARK + text.replace(" ", MARK)) if text else []


def count_batch(text: pa.Array, model: MergeTable, known: dict[str, int]) -> np.ndarray:
    """Tokens of each text of a batch; ``known`` keeps counts of pre-tokens between batches."""
    text = pc.fill_null(text, "")
    odd = pc.or_(pc.match_substring_regex(text, f"  |^ | $|{MARK}"), pc.equal(text, ""))
    odd_at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    offsets, codes, words = split_words(pc.if_else(odd, "", text))
    words = [MARK + w for w in words]
    new = [w for w in words if w not in known]
    if len(known) + len(new) > KEPT:
        known.clear()
        new = words
    known.update(zip(new, model.count(new).tolist(), strict=True))
    each = np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))
    total = segment_sum(each[codes], offsets)
    for i in odd_at.tolist():  # unusual spacing: runs of marks stay together
        total[i] = int(model.count(_pretokens(text[i].as_py())).sum())
    return total


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens; null ids, repeated rows and further columns are
    allowed (a row in gives a row out), an empty table gives no rows, and columns of any other names are not read. Texts of any length are read
    whole, the longest one by one. No shuffle: a scan and one Arrow map;
    executors read the model file at ``model_path``, which must exist on each of them.
    """
    path = model_path or default_model()
    key = docs.schema[id_col]

    def run(batches):
        model, known = merge_table(path), {}
        for b in batches:
            for s, n in slices_by_bytes(b.column(1)):
                part = b.slice(s, n)
                text = part.column(1)
                tokens = count_batch(text, model, known)
                size = pc.cast(pc.fill_null(pc.binary_length(text), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType([T.StructField(id_col, key.dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
