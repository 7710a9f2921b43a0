"""Language ID of words by a linear-chain conditional random field (operator 1).

A word's score for a language sums the weights of its affixes and n-grams (hashed) and of the word
itself where the lexicon has it; learned transitions tie neighbouring words. Forward-backward gives
each word's posterior, also in code-switched text; a document's language is the one with the largest
letter-weighted posterior mass over all its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import give_back, map_columns, mix64, segment_sum, slices_by_bytes, table, words_of

#: Code points of whole labelled documents taken for learning, for each language about so many (by a hash of the id).
SAMPLE_CHARS = 600_000  # code points learned from, of each language
TOTAL_CHARS = 24_000_000  # and of all languages together
TABLE_BITS = 16
CHAIN = 128  # words of a chain that is learned from
PART = 512  # words of a document that are stepped through together with other parts; messages pass between them
SLICE = 1_500_000  # bytes of text whose features are held at once
_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def _hash(*cols: np.ndarray) -> np.ndarray:
    h = np.full(len(cols[0]), len(cols), dtype=np.uint64)
    for c in cols:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + c)
    return h


class Features:
    """Hashed features of distinct words: word_of (which word) and slot (which weight), word hash, letters."""

    def __init__(self, words: list[str]):
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        ok = _letters()[code]
        owner = np.repeat(np.arange(len(words)), lens)[ok]
        code = code[ok].astype(np.uint64)
        self.letters = np.bincount(owner, minlength=len(words))
        some = np.flatnonzero(self.letters)
        n = self.letters[some]
        # ^word$ for every word with letters, in one array
        size = n + 2
        start = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), dtype=np.uint64)
        flat[start], flat[start + size - 1] = 1, 2
        at = np.ones(len(flat), dtype=bool)
        at[start] = at[start + size - 1] = False
        flat[at] = code
        who = np.repeat(some, size)
        first = np.zeros(len(flat), dtype=bool)
        first[start] = True
        last = np.zeros(len(flat), dtype=bool)
        last[start + size - 1] = True
        word_of, slot = [], []
        for k in (2, 3, 4):
            if len(flat) < k:
                continue
            m = len(flat) - k + 1
            inside = who[:m] == who[k - 1 :]
            if k == 4:  # affixes of three letters only
                inside &= first[:m] | last[k - 1 :]
            i = np.flatnonzero(inside)
            slot.append((_hash(*(flat[i + j] for j in range(k))) >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
            word_of.append(who[i])
        self.slot = np.concatenate(slot) if slot else np.zeros(0, dtype=np.int64)
        self.word_of = np.concatenate(word_of) if word_of else np.zeros(0, dtype=np.int64)
        # an order-dependent hash of the whole word, for the lexicon
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(self.letters) - self.letters, self.letters)
        self.word = np.zeros(len(words), dtype=np.uint64)
        np.add.at(self.word, owner, mix64(code + (pos.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))


class Crf:
    """Weights of affixes and n-grams, of lexicon words, and of transitions."""

    def __init__(self, langs: list[str], lexicon: np.ndarray):
        k = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.grams = np.zeros((1 << TABLE_BITS, k))
        self.words = np.zeros((len(lexicon) + 1, k))
        self.start, self.move = np.zeros(k), np.eye(k)

    def place(self, f: Features) -> np.ndarray:
        """Row of each word in the lexicon's weights; the last row is no entry."""
        if not len(self.lexicon):
            return np.zeros(len(f.word), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, f.word), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == f.word, at, len(self.lexicon))

    def emissions(self, f: Features, place: np.ndarray) -> np.ndarray:
        out = np.stack([np.bincount(f.word_of, weights=self.grams[f.slot, j], minlength=len(f.word)) for j in range(len(self.langs))], axis=1)
        return out + self.words[place]

    def posteriors(self, e: np.ndarray, lens: np.ndarray):
        """Forward-backward over chains of the given lengths, laid one after another in ``e``.

        Chains go by falling length, so that each step only handles those that still run.
        Returns the posteriors (as laid out), the expected transitions, and the log-likelihood's normaliser.
        """
        k = len(self.langs)
        order = np.argsort(-lens, kind="stable")
        first = (np.cumsum(lens) - lens)[order]
        ls = lens[order]
        live = np.searchsorted(-ls, -np.arange(int(ls[0]) if len(ls) else 0), side="left")  # chains longer than t
        top = e.max(axis=1, keepdims=True)
        x = np.exp(e - top)
        move = np.exp(self.move)
        a, b = np.empty_like(x), np.ones_like(x)
        log_z = float(top.sum())
        prev = None
        for t, n in enumerate(live.tolist()):
            at = first[:n] + t
            cur = x[at] * (np.exp(self.start) if t == 0 else prev[:n] @ move)
            s = cur.sum(axis=1, keepdims=True)
            prev = cur / s
            log_z += float(np.log(s).sum())
            a[at] = prev
        moves = np.zeros((k, k))
        nxt = None
        for t in range(len(live) - 1, 0, -1):
            n = live[t]
            at = first[:n] + t
            back = np.ones((n, k))
            if nxt is not None:
                back[: len(nxt)] = nxt
            xb = x[at] * back
            b_prev = xb @ move.T
            # expected transitions into step t
            pair = np.einsum("ni,nj->nij", a[at - 1], xb) * move
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            moves += pair.sum(axis=0)
            nxt = b_prev / b_prev.sum(axis=1, keepdims=True)
            b[at - 1] = nxt
        p = a * b
        return p / p.sum(axis=1, keepdims=True), moves, log_z


def document_posteriors(model: Crf, e: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Exact forward-backward over whole documents of ``count`` words, laid one after another in ``e``.

    Documents are cut into parts of ``PART`` words, which are stepped through together. The product of a part's
    transitions and emissions carries the forward message to its end and the backward message to its
    begin, so that no transition is lost between parts.
    """
    k = len(model.langs)
    parts = -(-count // PART)
    lens = np.full(int(parts.sum()), PART, dtype=np.int64)
    some = count > 0
    lens[np.cumsum(parts)[some] - 1] = (count - PART * (parts - 1))[some]
    nth = np.arange(len(lens)) - np.repeat(np.cumsum(parts) - parts, parts)
    many = np.repeat(parts, parts) > 1
    first = np.cumsum(lens) - lens
    x = np.exp(e - e.max(axis=1, keepdims=True))
    move, start = np.exp(model.move), np.exp(model.start)
    # messages at the borders of parts; the first part of a document begins with the start weights
    ahead, behind = np.full((len(lens), k), 1.0 / k), np.full((len(lens), k), 1.0)
    if many.any():
        which = np.flatnonzero(many)
        through = np.empty((len(which), k, k))
        order = np.argsort(-lens[which], kind="stable")
        live = np.searchsorted(-lens[which][order], -np.arange(int(lens[which].max())), side="left")
        prod = None
        for t, n in enumerate(live.tolist()):
            at = order[:n]
            now = x[first[which[at]] + t]
            if t == 0:
                prod = np.where(nth[which[at]][:, None, None] == 0, start / k, move) * now[:, None, :]
            else:
                prod[:n] = (prod[:n].reshape(-1, k) @ move).reshape(n, k, k) * now[:, None, :]
            prod[:n] /= prod[:n].max(axis=(1, 2), keepdims=True)
        through[order] = prod
        place = np.full(len(lens), -1)
        place[which] = np.arange(len(which))
        for j in range(1, int(parts.max())):
            at = np.flatnonzero(many & (nth == j))
            got = np.einsum("ni,nij->nj", ahead[at - 1], through[place[at - 1]])
            ahead[at] = got / got.sum(axis=1, keepdims=True)
        last = np.repeat(parts, parts) - 1
        for j in range(int(parts.max()) - 1, 0, -1):
            at = np.flatnonzero(many & (nth == j))
            after = np.where((last[at] > j)[:, None], behind[at], 1.0)
            got = np.einsum("nij,nj->ni", through[place[at]], after)
            behind[at - 1] = got / got.sum(axis=1, keepdims=True)
    order = np.argsort(-lens, kind="stable")
    begin = first[order]
    live = np.searchsorted(-lens[order], -np.arange(int(lens.max()) if len(lens) else 0), side="left")
    a, b = np.empty_like(x), np.empty_like(x)
    prev = None
    for t, n in enumerate(live.tolist()):
        come = np.where((nth[order[:n]] == 0)[:, None], start, ahead[order[:n]] @ move) if t == 0 else prev[:n] @ move
        cur = x[begin[:n] + t] * come
        prev = cur / cur.sum(axis=1, keepdims=True)
        a[begin[:n] + t] = prev
    b[first + lens - 1] = behind
    for t in range(len(live) - 1, 0, -1):
        at = begin[: live[t]] + t
        back = (x[at] * b[at]) @ move.T
        b[at - 1] = back / back.sum(axis=1, keepdims=True)
    p = a * b
    return p / p.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, str]], rounds: int = 40, step: float = 0.15, ridge: float = 1e-4) -> Crf | None:
    """Learn from (text, language) rows by gradient steps on the chains' likelihood.

    Runs of 5 to 40 words of different rows are joined into chains, so that the transitions have
    switches to learn from. None if there is no row with a letter.
    """
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return None
    rng = np.random.default_rng(7)
    runs = []
    for text, lang in rows:
        words = text.lower().split()
        i = 0
        while i < len(words):
            n = int(rng.integers(5, 41))
            runs.append((words[i : i + n], langs.index(lang)))
            i += n
    rng.shuffle(runs)
    seq = [(w, y) for ws, y in runs for w in ws]
    vocab = {w: i for i, w in enumerate(dict.fromkeys(w for w, _ in seq))}
    f = Features(list(vocab))
    ids = np.fromiter((vocab[w] for w, _ in seq), dtype=np.int64, count=len(seq))
    y = np.fromiter((v for _, v in seq), dtype=np.int64, count=len(seq))
    keep = f.letters[ids] > 0
    ids, y = ids[keep], y[keep]
    if not len(ids):
        return None
    times = np.bincount(ids, minlength=len(vocab))
    model = Crf(langs, np.unique(f.word[times >= 3]))
    place, k = model.place(f), len(langs)
    lens = np.full(-(-len(ids) // CHAIN), CHAIN, dtype=np.int64)
    lens[-1] = len(ids) - CHAIN * (len(lens) - 1)
    heads = np.cumsum(lens) - lens
    inner = np.setdiff1d(np.arange(len(ids)), heads)
    seen = np.zeros((k, k))
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    seen_start = np.bincount(y[heads], minlength=k)
    state = {}

    def ascend(name, grad, t):
        w = getattr(model, name)
        grad = grad / len(ids) - ridge * w
        m, v = state.setdefault(name, [np.zeros_like(w), np.zeros_like(w)])
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w += step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)

    for t in range(1, rounds + 1):
        p, moves, _ = model.posteriors(model.emissions(f, place)[ids], lens)
        err = -p
        err[np.arange(len(y)), y] += 1
        by_word = np.stack([np.bincount(ids, weights=err[:, j], minlength=len(vocab)) for j in range(k)], axis=1)
        grams = np.stack([np.bincount(f.slot, weights=by_word[f.word_of, j], minlength=1 << TABLE_BITS) for j in range(k)], axis=1)
        words = np.stack([np.bincount(place, weights=by_word[:, j], minlength=len(model.words)) for j in range(k)], axis=1)
        words[-1] = 0
        ascend("grams", grams, t)
        ascend("words", words, t)
        ascend("move", seen - moves, t)
        ascend("start", seen_start - p[heads].sum(axis=0), t)
    return model


def label_texts(model: Crf, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letter-weighted share of each language over all words of each text (no letters: zeros), and letters."""
    offsets, codes, words = words_of(text)
    f = Features([w.lower() for w in words])
    letters = f.letters[codes]
    keep = letters > 0
    count = segment_sum(keep.astype(np.int64), offsets)
    ids, weight = codes[keep], letters[keep].astype(np.float64)
    docs = len(offsets) - 1
    share = np.zeros((docs, len(model.langs)))
    if not len(ids):
        return share, np.zeros(docs)
    p = document_posteriors(model, model.emissions(f, model.place(f))[ids], count)
    ends = np.concatenate([[0], np.cumsum(count)])
    for j in range(share.shape[1]):
        share[:, j] = segment_sum(p[:, j] * weight, ends)
    total = segment_sum(weight, ends)
    return share / np.maximum(total, 1)[:, None], total


def fold(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")), F.lit(0)) % 4


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", chars: int = SAMPLE_CHARS, total: int = TOTAL_CHARS) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows outside the held-out fold: of every language the first rows by hash, until they hold ``chars`` code points.

    Every language has a row at least. A text longer than the bound counts with a stretch of ``chars`` code points, from a place that its hash
    gives and without the words cut at its ends; all others are whole. With very many languages each gets its part of ``total``.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), F.col(id_col)), 24)
    some = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (fold(id_col) != 2))
    some = some.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw"), F.xxhash64(text_col).alias("h"))
    n = some.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.min("draw").alias("first")).collect()  # a row a language
    if not n:
        return []
    chars = max(1, min(chars, total // len(n)))
    # twice the rows that are expected to be enough are ranked, not all of a language
    most = F.create_map(*(F.lit(x) for r in n for x in (r["lang"], max(r["first"], int(min(1.0, 2 * chars / max(1, r["n"])) * 2**40)))))
    drawn = some.where(F.col("draw") <= F.element_at(most, F.col("lang")))
    size = F.length("text")
    at = F.pmod(F.col("h"), F.greatest(size - chars + 1, F.lit(1)).cast("long")).cast("int") + 1
    cut = F.regexp_replace(F.substring(F.col("text"), at, F.lit(chars)), r"^\S*\s+|\s+\S*$", "")
    drawn = drawn.withColumn("text", F.when(size > chars, cut).otherwise(F.col("text")))
    before = Window.partitionBy("lang").orderBy("draw", "h").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0))).where(F.col("before") < chars)
    return sorted((r[0], r[1]) for r in drawn.select("text", "lang").collect())


def identify(docs: DataFrame, model: Crf | None, text_col: str = "text", carry: list[str] | None = None, prefix: str = "_lang_") -> DataFrame:
    """The columns ``carry`` (all, if not given) of every row, with _lang_pred, _lang_score (share of the
    winner) and _lang_shares (language -> share).

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing could
    be learned; ties go to the first language in alphabetical order; repeated rows are labelled each; an empty table gives no
    rows; only the text is used. A column that has one of these names already is replaced: choose another
    ``prefix`` (``free_prefix``) where it matters. Texts of any length are read whole, in one Arrow map without a
    shuffle; the model's size depends on the parameters alone.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    made = [f"{prefix}{c}" for c in ("pred", "score", "shares")]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    rows = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*carry, text_col])))
    at, n_carry = rows.columns.index(text_col), len(carry)
    out = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in carry), T.StructField(made[0], T.StringType()), T.StructField(made[1], T.DoubleType()), T.StructField(made[2], T.MapType(T.StringType(), T.DoubleType()))])

    def run(batches):
        m = shared.value
        for b in batches:
            for s, n in slices_by_bytes(b.column(at), SLICE):
                part = b.slice(s, n)
                if m is None:
                    share, letters, langs = np.zeros((n, 1)), np.zeros(n), ["und"]
                else:
                    (share, letters), langs = label_texts(m, part.column(at)), m.langs
                best = share.argmax(axis=1)
                pred = np.where(letters > 0, np.array(langs, dtype=object)[best], "und")
                score = np.where(letters > 0, np.clip(share.max(axis=1), 0, 1), 0.0)
                shares = pa.MapArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(langs)), pa.array(langs * n, pa.string()), pa.array(share.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:n_carry], pa.array(pred, pa.string()), pa.array(score), shares], names=out.names)
        give_back()

    return map_columns(rows, run, out)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(training_rows(docs))
    got = identify(docs, model, carry=["doc_id"])
    return got.select("doc_id", (fold("doc_id") == 2).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"))
