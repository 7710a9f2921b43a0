"""Divergence of a language's sources by a two-pass vocabulary automaton (operator 13).

Pass one counts in how many documents each term of a language stands, exactly, and keeps the frequent ones. Pass two
runs an Aho-Corasick automaton of the kept terms, each between delimiters, over the texts and counts their occurrences by
source. These sparse postings give the distance of every two sources of a language and the terms that mark a source.
"""

from __future__ import annotations

from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.common import fresh_path, give_back, runs_of, slices_by_bytes, stage, table, text_bytes, word_starts

LEAST_DOCS = 30
TOP = 50
SCALE, PRIOR = 1_000_000_000, 5
AUTOMATON = 2_000_000  # characters of terms in one automaton (about 60 bytes each); more terms are counted by further ones
SLICE = 4_000_000  # bytes of text worked on at once
HELD = 2_000_000  # counts that a task holds before it passes them on
SENT_ROWS = 100_000  # counts that leave a task in one batch
BLOCK = 256  # sources of a language compared in one task; more go in pairs of blocks
CELL = 16_000  # postings of a block that meet in one task
SENT = 1_000_000  # most groups or languages that are broadcast

#: What terms do not hold (ASCII but letters) becomes a space, and A-Z lower case.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 32


def _folded(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_bytes(text)
    return _FOLD[raw], offsets


def _coded(col: pa.Array) -> tuple[np.ndarray, list[str]]:
    d = pc.fill_null(col.cast(pa.string()), "").dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and how often each stands."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys)))


class _Counts:
    """Counts by whole-number keys (``a << 40 | b``) that leave a task in batches of bounded size."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.size += len(keys)

    def full(self) -> bool:
        """Whether many different keys are held; sums equal ones first."""
        if self.size > HELD:
            self._sum()
            return self.size > HELD // 2
        return False

    def _sum(self) -> None:
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys)
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        self.keys, self.counts, self.size = [keys[at]], [np.add.reduceat(counts[order], at)], len(at)

    def sent(self):
        """(a, b, count) arrays of all that is held, which is dropped."""
        if self.size:
            self._sum()
            (keys,), (counts,) = self.keys, self.counts
            self.keys, self.counts, self.size = [], [], 0
            for k in range(0, len(keys), SENT_ROWS):
                some = keys[k : k + SENT_ROWS]
                yield pa.array(some >> 40), pa.array(some & ((1 << 40) - 1)), pa.array(counts[k : k + SENT_ROWS])


def _numbers(known: dict, values) -> np.ndarray:
    """Numbers of values; new ones get the next number."""
    return np.fromiter((known.setdefault(v, len(known)) for v in values), np.int64)


def _document_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, docs): documents that hold a term, in parts to be summed."""

    def run(batches):
        counts, names, words = _Counts(), {}, {}

        def sent():
            lang, term = pa.array(list(names), pa.string()), pa.array(list(words), pa.large_binary()).cast(pa.large_string())
            for a, b, n in counts.sent():
                yield pa.RecordBatch.from_arrays([lang.take(a), term.take(b).cast(pa.string()), n], names=["lang", "term", "docs"])
            names.clear()
            words.clear()

        for b in batches:
            for s, k in slices_by_bytes(b.column(1), SLICE):
                piece = b.slice(s, k)
                lang, langs = _coded(piece.column(0))
                low, offsets = _folded(piece.column(1))
                space = low == 32
                first = word_starts(space, offsets)
                codes, terms = runs_of(low, first, space)
                at = np.searchsorted(np.flatnonzero(first), offsets)
                doc = np.repeat(np.arange(k), np.diff(at))
                width = np.int64(max(1, len(terms)))
                once, _ = _runs(doc * width + codes)  # a term of a document
                doc, code = np.divmod(once, width)
                both, n = _runs(lang[doc] * width + code)
                of, which = np.divmod(both, width)
                counts.add(_numbers(names, langs)[of] << 40 | _numbers(words, terms)[which], n)
                if counts.full():
                    yield from sent()
        yield from sent()
        give_back()

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, docs long")


@lru_cache(maxsize=1)
def _automaton(path: str, shard: int):
    """(automaton of the padded terms of a shard, the terms, the numbers of those that each language keeps, ascending)."""
    import ahocorasick

    fs, top = pafs.FileSystem.from_uri(path)
    files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{top}/shard={shard}", allow_not_found=True)) if f.path.endswith(".parquet")]
    terms: dict[str, int] = {}
    kept: dict[str, list[np.ndarray]] = {}
    for f in files:
        t = pq.ParquetFile(fs.open_input_file(f)).read(columns=["lang", "term"])
        number = _numbers(terms, t.column(1).to_pylist())
        lang, langs = _coded(t.column(0).combine_chunks())
        for k, name in enumerate(langs):
            kept.setdefault(name, []).append(number[lang == k])
    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for term, i in terms.items():
        made.add_word(f" {term} ", i)
    made.make_automaton()
    return made, pa.array(list(terms), pa.large_string()), {name: np.sort(np.concatenate(parts)) for name, parts in kept.items()}


def _occurrences(docs: DataFrame, path: str, shard: int) -> DataFrame:
    """(lang, source, term, count): occurrences of the terms of a shard, in parts to be summed."""

    def run(batches):
        made, terms, kept = _automaton(path, shard)
        counts, groups = _Counts(), {}

        def sent():
            lang, source = (pa.array([g[k] for g in groups], pa.string()) for k in (0, 1))
            for a, b, n in counts.sent():
                yield pa.RecordBatch.from_arrays([lang.take(a), source.take(a), terms.take(b).cast(pa.string()), n], names=["lang", "source", "term", "count"])
            groups.clear()

        for b in batches if kept else ():
            for s, k in slices_by_bytes(b.column(2), SLICE):
                piece = b.slice(s, k)
                (lang, langs), (source, sources) = _coded(piece.column(0)), _coded(piece.column(1))
                low, offsets = _folded(piece.column(2))
                raw, ends = low.tobytes(), offsets.tolist()
                group = lang * len(sources) + source
                order = np.argsort(group, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                    name, origin = langs[lang[own[0]]], sources[source[own[0]]]
                    if name not in kept:
                        continue
                    joined = b" ".join([b"", *(raw[ends[i] : ends[i + 1]] for i in own.tolist()), b""]).decode()
                    found, n = _runs(np.fromiter(map(itemgetter(1), made.iter(joined)), np.int64))
                    here = np.isin(found, kept[name], assume_unique=True)
                    counts.add(_numbers(groups, [(name, origin)]) << 40 | found[here], n[here])
                if counts.full():
                    yield from sent()
        yield from sent()
        give_back()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, count long")


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT else df


def _share(count: F.Column, total: F.Column, terms: F.Column) -> F.Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly; 0 where no term is kept."""
    most = "decimal(38,0)"
    floor = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + PRIOR).cast("decimal(20,0)"), (total + PRIOR * terms).cast(most))
    return F.when(terms > 0, floor.cast("long") + 1).otherwise(F.lit(0).cast("long"))


def _distances(group: pa.Table) -> pa.Table:
    """Parts of the distances of the sources that meet here: (lang, a, b, value), a before b.

    Rows without a term are the sources themselves. A source's value of a term that it does not hold is its least
    one, p0. Of terms that one of two sources holds, the sorted values of a source give sums against any p0; terms that both
    hold are corrected pair by pair along their postings. In bucket 0 all kept terms count as held by neither first.
    """
    group = group.combine_chunks()
    col = {c: group.column(c) for c in group.column_names}
    block, i, j = (col[c].to_numpy() for c in ("block", "i", "j"))
    head = group.filter(pc.is_null(col["term"]))
    sources = head.column("source").to_pylist()
    order = np.array(sorted(range(len(sources)), key=lambda k: sources[k].encode()), dtype=np.int64)
    head = head.take(pa.array(order))
    names = head.column("source")
    zero, own = head.column("p").to_numpy(), head.column("block").to_numpy()
    n = len(head)
    total = np.zeros((n, n), dtype=np.int64)
    base = np.abs(zero[:, None] - zero[None, :])
    if group.column("bucket")[0].as_py() == 0:
        total += base * head.column("kept").to_numpy()[:, None]
    rows = np.flatnonzero(pc.is_valid(col["term"]).to_numpy(zero_copy_only=False))
    if len(rows):
        src = pc.index_in(col["source"].take(pa.array(rows)), value_set=names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names).to_numpy().astype(np.int64)
        term = col["term"].take(pa.array(rows)).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
        p = col["p"].to_numpy()[rows]
        for g in range(n):
            v = np.sort(p[src == g])
            if len(v):
                low = np.concatenate([[0], np.cumsum(v)])
                k = np.searchsorted(v, zero)
                one = (low[-1] - low[k]) - zero * (len(v) - k) + zero * k - low[k] - len(v) * base[g]
                one[g] = 0
                total[g] += one
                total[:, g] += one
        at = np.lexsort([src, term])
        src, term, p = src[at], term[at], p[at]
        p0 = zero[src]
        for k in range(1, n):
            same = np.flatnonzero(term[:-k] == term[k:])
            if not len(same):
                break
            x, y = same, same + k
            more = np.abs(p[x] - p[y]) - np.abs(p[x] - p0[y]) - np.abs(p0[x] - p[y]) + np.abs(p0[x] - p0[y])
            np.add.at(total, (src[x], src[y]), more)
    meet = np.triu(np.ones((n, n), dtype=bool), 1)
    if i[0] != j[0]:
        meet &= own[:, None] != own[None, :]
    a, b = np.nonzero(meet)
    return pa.table({"lang": pa.array([group.column("lang")[0].as_py()] * len(a), pa.string()), "a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "value": pa.array(total[a, b])})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows (lang, source, part, item, value, rank): how a source's use of its language's terms differs from others'.

    A term is a run of ASCII letters (A-Z counts as a-z) and characters outside ASCII; a language keeps those in
    at least ``least_docs`` of its documents. A group's value of a term is its smoothed share in whole billionths. Part
    ``pair`` gives for every other source of the language the sum of differences over all kept terms, part ``term`` the
    ``top`` terms that the source uses more than its language. Larger values come first, ties by the item's UTF-8 bytes.

    Null texts, languages and sources count as empty strings; a source without a kept term, or of empty texts only, is
    a group like others; in a language without kept terms all distances are 0; repeated rows and ids count each; an empty
    table gives no rows; texts of any length are read whole; only the three named columns are read, whatever others are called.
    Counts are summed in tasks before they are dealt, so a frequent source or language costs a row for each term and task. The kept
    terms go to tasks as files of the shared folder, an automaton of at most ``AUTOMATON`` characters (or one
    longer term) at a time. Sources meet in blocks of ``BLOCK`` and buckets of terms; only sums by pair leave a task.
    """
    spark = docs.sparkSession
    read = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = _document_counts(read).groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = stage(kept.select("lang", "term"), "kept-terms")
    shards = max(1, -(-int(kept.agg(F.sum(F.length("term") + 2)).head()[0] or 0) // AUTOMATON))
    path = fresh_path(spark, "vocabulary")
    kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)).cast("int")).repartition(shards, "shard").write.partitionBy("shard").parquet(path)
    parts = _occurrences(read, path, 0)
    for s in range(1, shards):
        parts = parts.unionByName(_occurrences(read, path, s))
    postings = stage(parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count")), "postings")

    held = postings.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("terms"))
    groups = read.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("docs")).drop("docs").join(held, ["lang", "source"], "left")
    groups = stage(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("terms", F.lit(0)).alias("terms")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("terms").alias("postings"), F.count(F.lit(1)).alias("sources"))
    langs = langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    blocks = F.ceil(F.col("sources") / BLOCK)
    langs = stage(langs.select("lang", "all", "kept", blocks.alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("postings") / blocks / CELL)).alias("buckets")), "langs")
    n_langs, n_groups = langs.count(), groups.count()
    groups = groups.join(_sent(langs, n_langs), "lang")
    own = _share(F.col("count"), F.col("n"), F.col("kept"))
    valued = postings.join(_sent(groups, n_groups), ["lang", "source"]).withColumn("p", own)
    valued = stage(valued.select("lang", "source", "term", "count", "p", "all", "kept", "blocks", "buckets"), "valued")

    bucket = F.pmod(F.xxhash64("term"), F.col("buckets"))
    cols = ["lang", "source", "term", "p", "kept", "blocks", "bucket"]
    rows = valued.withColumn("bucket", bucket).select(*cols)
    rows = rows.unionByName(groups.select("lang", "source", F.lit(None).cast("string").alias("term"), _share(F.lit(0).cast("long"), F.col("n"), F.col("kept")).alias("p"), "kept", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)).alias("bucket")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "source"), F.col("blocks")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("o"))
    rows = rows.select("lang", "source", "term", "p", "kept", "bucket", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    met = rows.groupBy("lang", "bucket", "i", "j").applyInArrow(_distances, "lang string, a string, b string, value long")
    sums = met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))

    pairs = ranked(both.select("lang", "x.source", "x.item", "value"), "pair")
    q = _share(F.sum("count").over(Window.partitionBy("lang", "term")), F.col("all"), F.col("kept"))
    marks = valued.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.unionByName(ranked(marks, "term").where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


#: The same in SQL: every two sources of a language over all of its kept terms.
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}
), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
full_p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + ({SCALE}::HUGEINT * (coalesce(c.c, 0) + {PRIOR})) // (coalesce(n.n, 0) + {PRIOR} * v.v)::HUGEINT AS p
  FROM groups g JOIN kept k USING (lang) JOIN v USING (lang)
  LEFT JOIN n USING (lang, source) LEFT JOIN c USING (lang, source, term)
), lang_c AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term),
lang_n AS (SELECT lang, sum(c) AS n FROM lang_c GROUP BY lang),
q AS (
  SELECT lang, term, 1 + ({SCALE}::HUGEINT * (lang_c.c + {PRIOR})) // (lang_n.n + {PRIOR} * v.v)::HUGEINT AS q
  FROM lang_c JOIN lang_n USING (lang) JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum(abs(x.p - y.p)) FROM full_p x JOIN full_p y USING (lang, term)
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value
  FROM full_p JOIN q USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
