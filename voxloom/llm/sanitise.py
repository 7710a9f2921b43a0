"""Information-theoretic sanitisation of personal data (operator 10).

Only DataFrame functions. Patterns find the protected entities (mail addresses, IP addresses, card
and phone numbers). Over the whole corpus, documents in which an entity and a term occur together
are counted; a term reveals the share ``pmi(entity, term) / information(entity)`` of what the
entity's value holds. Terms that reveal more than a threshold are removed wherever they stand in a
document that holds the entity. Counts are smoothed, so that few documents weigh less than many.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import free_name, is_empty, stage, table

KINDS = ("email", "ip", "card", "phone")
#: The same matches as the plain forms; possessive and anchored, so that no run of characters is
#: scanned once for each of its characters and no group recurses.
_MAIL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these has no match that can pass.
_NEEDS = {
    "email": r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9][\x20().0-9-]",
}
PRIOR = 2.0  # documents of a term that are taken to hold an entity as often as the corpus does
DISCLOSURE = 0.8  # share of an entity's information that a term may reveal
HOT = 100_000  # a key with more than this part of the rows is joined by broadcast: at most so many keys
SENT = 200_000  # most terms of documents that are sent to every task; more are joined by a shuffle
RUN = 512  # matches that are placed together; arrays are grown by runs, so that long texts cost no square of their matches
_WORD = r"[\p{L}\p{M}\p{N}]++"
_NAMED = r"^\p{Lu}|\p{N}"  # a word that looks like a name or number
_SPAN = "array<struct<s:int,e:int,m:string>>"


def _luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.ascii(F.substr(digits, i, F.lit(1))) - 48
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _each(items: Column, make, kind: str) -> Column:
    return F.transform(items, lambda x: make(x, kind))


def _runs(items: Column) -> Column:
    """An array in runs of ``RUN`` elements."""
    last = F.greatest(F.ceil(F.size(items) / RUN).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * RUN + 1, F.lit(RUN)))


def _located(text: Column, pattern: str, keep) -> Column:
    """Array of (s, e, m) of the matches that ``keep``, s and e in code points: gaps and matches alternate."""
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(acc, x):
        s = acc["at"] + F.length(x["gap"])
        e = s + F.coalesce(F.length(x["hit"]), F.lit(0))
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["hit"].alias("m")))
        return F.struct(e.alias("at"), F.when(x["hit"].isNotNull() & keep(x["hit"], s, e), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def run(acc, xs):
        made = F.aggregate(xs, F.struct(acc["at"].alias("at"), F.array().cast(_SPAN).alias("out")), step)
        return F.transform(F.array(made), lambda m: F.struct(m["at"].alias("at"), F.concat(acc["out"], F.array(m["out"])).alias("out")))[0]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))
    return F.aggregate(_runs(pairs), start, run, lambda acc: F.flatten(acc["out"]))


def _rebuilt(text: Column, spans: Column, fill) -> Column:
    """The text with what ``fill(span, at)`` gives in place of every span; ``at`` is where the spans before it end.

    Spans are taken in order, in runs: each run works on its own stretch of the text.
    """
    none = F.array().cast("array<string>")

    def step(acc, x):
        gap = F.substr(acc["piece"], acc["at"] - acc["from"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        out = F.concat(acc["out"], F.array(gap, fill(x, acc["at"])))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"), acc["piece"].alias("piece"), acc["from"].alias("from"))

    def run(acc, xs):
        stop = F.greatest(acc["at"], F.coalesce(F.array_max(F.transform(xs, lambda x: x["e"])), F.lit(0)))
        begin = F.struct(acc["at"].alias("at"), none.alias("out"), F.substr(text, acc["at"] + 1, stop - acc["at"]).alias("piece"), acc["at"].alias("from"))
        made = F.aggregate(xs, begin, step, lambda m: F.struct(m["at"].alias("at"), F.array_join(m["out"], "").alias("out")))
        return F.transform(F.array(made), lambda m: F.struct(m["at"].alias("at"), F.concat(acc["out"], F.array(m["out"])).alias("out")))[0]

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(_runs(F.array_sort(spans)), start, run, end)).otherwise(text)


def find_entities(docs: DataFrame, text_col: str = "text", prefix: str = "_") -> DataFrame:
    """``docs`` with ``<prefix>text`` (null as empty) and for each kind an array of spans (s, e, m: the match), in code points."""
    text = F.col(f"{prefix}text")
    out = docs.withColumn(f"{prefix}text", F.coalesce(F.col(text_col), F.lit("")))
    for k in KINDS:
        found = _located(text, PATTERNS[k], lambda m, s, e, k=k: _passes(k, m))
        out = out.withColumn(f"{prefix}{k}", F.when(text.rlike(_NEEDS[k]), found).otherwise(F.array().cast(_SPAN)))
    return out


def _share(n_et: Column, n_e: Column, n_t: Column, n: int, prior: float = PRIOR) -> Column:
    """Share of an entity's information that a term reveals; its chance given the term is drawn to that in the corpus."""
    base = n_e / F.lit(float(n))
    given = (n_et + F.lit(prior) * base) / (n_t + F.lit(prior))
    return F.when(base < 1, F.log2(given / base) / -F.log2(base)).otherwise(F.lit(0.0))


def _may(text: Column) -> Column:
    """Whether a text can hold an entity at all."""
    may = F.lit(False)
    for k in KINDS:
        may = may | text.rlike(_NEEDS[k])
    return may


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower))


def _marked(found: DataFrame, id_col: str, prefix: str) -> DataFrame:
    """(id, h, entities, blank, terms, named) of the documents in which a pattern may find an entity.

    ``blank`` is the text with as many spaces in place of every entity: what is left of words is no entity's. ``named`` are
    the terms that somewhere begin with a capital or hold a digit.
    """
    text = F.col(f"{prefix}text")
    spans = [F.col(f"{prefix}{k}") for k in KINDS]
    named = F.concat(*(_each(c, lambda x, k: F.concat(F.lit(f"{k}:"), x["m"]), k) for k, c in zip(KINDS, spans, strict=True)))
    blank = _rebuilt(text, F.concat(*spans), lambda x, at: F.repeat(F.lit(" "), F.greatest(x["e"] - F.greatest(x["s"], at), F.lit(0))))
    rows = found.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("h"), F.array_distinct(named).alias("entities"), blank.alias("blank"))
    named = F.array_distinct(F.transform(F.regexp_extract_all("blank", F.lit(_WORD), F.lit(0)), lambda w: F.when(w.rlike(_NAMED), F.lower(w))))
    return stage(rows.withColumn("terms", _words(F.col("blank"))).withColumn("named", F.array_compact(named)), "marked")


def _keyed(rows: DataFrame, keys: DataFrame, on: list[str], count: str) -> DataFrame:
    """Join ``rows`` with its unique ``keys``, of which ``count`` says in how many rows each is.

    The most frequent are sent to every task, so no task gets all rows of one of them.
    """
    total = keys.agg(F.sum(count)).head()[0] or 0
    hot = keys.where(F.col(count) > total / HOT)
    cold = keys.where(F.col(count) <= total / HOT)
    if is_empty(cold):
        return rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))


def disclosive_terms(rest: DataFrame, marked: DataFrame, n: int, disclosure: float = DISCLOSURE) -> DataFrame:
    """(id, h, term): for each document with entities, its terms over the threshold for one of them.

    ``rest`` holds the text of all documents that are not ``marked``. Terms too frequent for any entity go before
    pairs are made, and entities of just the same documents count as one: with any term they have
    the same counts. Two different texts must hold the term and the entity together; one text alone, in however many copies, shares
    all its rare words with whatever else stands in it, so there only terms count that look like names or numbers.
    """
    doc = ["_id", "h"]
    owned = marked.select(*doc, F.explode("entities").alias("entity"))
    which = F.sum(F.xxhash64("_id", "h").cast("decimal(38,0)")).alias("docs")
    n_e = stage(owned.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), which), "entities")
    most = n_e.agg(F.max("n_e")).head()[0]
    words = rest.select(F.explode(_words(F.col("text"))).alias("term")).unionByName(marked.select(F.explode("terms").alias("term")))
    n_t = stage(words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")), "terms")  # summed before it is dealt out
    owners = stage(_keyed(owned, n_e, ["entity"], "n_e").select(*doc, "n_e", "docs").distinct(), "owners")
    could = _share(F.least("n_e", "n_t"), F.col("n_e"), F.col("n_t"), n) >= disclosure  # were the term always with the entity
    ever = F.log2((F.col("n_t") + PRIOR) / (F.least(F.lit(most), F.col("n_t")) + PRIOR * most / n)) <= (1 - disclosure) * math.log2(n) + 1e-9
    terms = _keyed(marked.where(F.size("entities") > 0).select(*doc, F.explode("terms").alias("term")), n_t, ["term"], "n_t").where(ever)
    same = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in doc]
    pairs = terms.join(owners.withColumnsRenamed({c: f"o_{c}" for c in doc}), same).where(could).select(*doc, "term", "docs", "n_e", "n_t")
    pairs = stage(pairs, "pairs")
    counted = pairs.groupBy("term", "docs", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n_et"), (F.min("h") != F.max("h")).alias("firm"))
    share = _share(F.col("n_et"), F.col("n_e"), F.col("n_t"), n)
    shown = stage(counted.where(share >= disclosure).select("term", "docs", "n_e", "n_et", "firm"), "disclosive")
    hits = stage(_keyed(pairs.drop("n_t"), shown, ["term", "docs", "n_e"], "n_et").select(*doc, "term", "firm").distinct(), "shown")
    named = marked.select(*(F.col(c).alias(f"n_{c}") for c in doc), F.explode("named").alias("n_term"))
    same = [F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in (*doc, "term")]
    weak = hits.where(~F.col("firm"))
    kept = named.join(F.broadcast(weak) if weak.count() <= SENT else weak, same, "left_semi").toDF(*doc, "term")
    return hits.where("firm").select(*doc, "term").unionByName(kept).distinct()


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, prefix: str = "_") -> DataFrame:
    """``docs`` with columns _text, _email, _ip, _card, _phone, _term: spans (s, e) in code points.

    A row in gives a row out; null texts count as empty and have no spans; rows that repeat get the
    same spans; a null id is a value like others; an empty table gives none; other columns pass through. A column that
    has one of these names already is replaced: choose another ``prefix`` (``free_prefix``) where it matters.
    A text may hold any number of entities: spans are placed by runs, and terms are joined, not searched in lists.
    Counts cover all documents: an entity's and a term's documents, and
    those that hold both. Terms are all words and numbers outside entities. Only the texts in which
    a pattern may find an entity are shuffled, where their terms are too many to send to every task.
    """
    made = [f"{prefix}{k}" for k in ("text", *KINDS, "term")]
    text, kept = F.col(made[0]), [F.col(f"`{c}`") for c in docs.columns if c.lower() not in map(str.lower, made)]
    read = docs.withColumn(made[0], F.coalesce(F.col(text_col), F.lit("")))
    none = F.array().cast("array<struct<s:int,e:int>>")
    found = find_entities(read.where(_may(text)), made[0], prefix)
    marked = _marked(found, id_col, prefix)
    plain = found.select(*kept, text, *(F.transform(F.col(c), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(c) for c in made[1:-1]))
    rest = read.where(~_may(text))
    bare = rest.select(*kept, text, *(none.alias(c) for c in made[1:]))
    if is_empty(marked.where(F.size("entities") > 0)):
        return plain.withColumn(made[-1], none).unionByName(bare)
    hits = stage(disclosive_terms(rest.select(text.alias("text")), marked, docs.count(), disclosure), "hits")
    # every place of a term that goes: the words of its documents, joined with their terms
    words = marked.where(F.size("entities") > 0).select("_id", "h", F.explode(_located(F.col("blank"), _WORD, lambda m, s, e: F.lit(True))).alias("x"))
    words = words.select("_id", "h", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.lower("x.m").alias("term")).distinct()
    gone = hits.withColumnsRenamed({"_id": "hit_id", "h": "hit_h", "term": "hit_term"})
    same = F.col("_id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")) & (F.col("term") == F.col("hit_term"))
    key, at, own = (free_name(n, docs, plain) for n in ("h", "at_id", "at_h"))
    spans = words.join(F.broadcast(gone) if hits.count() <= SENT else gone, same).groupBy(F.col("_id").alias(at), F.col("h").alias(own)).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias(made[-1]))
    spans = stage(spans, "term-spans")
    out = plain.withColumn(key, F.xxhash64(text)).join(spans, F.col(id_col).eqNullSafe(F.col(at)) & (F.col(key) == F.col(own)), "left")
    return out.select(*kept, *made[:-1], F.coalesce(made[-1], none).alias(made[-1])).unionByName(bare)


def redacted(spans: DataFrame, prefix: str = "_", generalise: bool = True) -> Column:
    """The text with every span generalised to its kind in brackets, or removed; overlapping spans become one."""
    kinds = (*KINDS, "term")
    label = lambda x, k: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"[{k.upper()}]" if generalise else "").alias("k"))
    every = F.concat(*(_each(F.col(f"{prefix}{k}"), label, k) for k in kinds))
    return _rebuilt(F.col(f"{prefix}text"), every, lambda x, at: F.when(x["s"] >= at, x["k"]).otherwise(F.lit("")))


def _listed(kinds) -> Column:
    def one(k):
        return F.transform(F.array_sort(F.col(f"_{k}")), lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))

    return F.array_join(F.concat(*(one(k) for k in kinds)), ",")


def op10_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(
        "doc_id",
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(_listed(KINDS), 256).alias("base_sha256"),
        _listed((*KINDS, "term")).alias("spans"),
        F.size("_term").cast("long").alias("n_term"),
    )
