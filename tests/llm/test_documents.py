import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import decontaminate, language_id, near_duplicates, quality, sanitise

DATA = "/root/testdata/sf0.01"


def _words(r, n, pool):
    return [r.choice(pool) for _ in range(n)]


def _shingles(text):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(11)
    pool = ["w%d" % k for k in range(4000)]
    texts = [" ".join(_words(r, r.randint(3, 120), pool)) for _ in range(120)]
    for k in range(0, 60):
        w = texts[k].split()
        for _ in range(len(w) // 60 + (k % 4)):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(9)
        texts.append(" ".join(w))
    texts += texts[:20] + ["", None, " ", "one", "one", "hot copy of a text that is here"] * 3
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "bands": F.lit("x"), "id": F.lit(2)})
    got = {x["doc_id"]: x for x in near_duplicates.near_duplicates(docs.repartition(5)).collect()}
    assert len(got) == len(rows)
    counts, n = near_duplicates.document_frequencies(docs)
    # far from the threshold the damped weights cannot decide otherwise than plain counts
    sh = [_shingles(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            both = sum((sh[a] & sh[b]).values())
            j = both / max(1, sum(sh[a].values()) + sum(sh[b].values()) - both)
            if j >= 0.83:
                assert got[a]["class_id"] == got[b]["class_id"], (a, b, j)
    members = collections.defaultdict(list)
    for i, x in got.items():
        members[x["class_id"]].append(i)
        assert x["kept"] == (i == x["class_id"])
    for c, m in members.items():
        assert c == min(m) and all(got[i]["n_class"] == len(m) for i in m)
        for i in m:  # every member has a partner that is at least somewhat alike
            if len(m) > 1:
                assert any(sum((sh[i] & sh[k]).values()) / max(1, sum((sh[i] | sh[k]).values())) > 0.7 for k in m if k != i)
    kept = sorted(x["doc_id"] for x in near_duplicates.deduplicated(docs).collect())
    assert kept == sorted(i for i, x in got.items() if x["kept"])
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_deduplicated_handles_repeats_and_nulls(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, ""), (2, None), (3, "x y"), (None, "x y"), (None, None)]
    got = near_duplicates.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, "a b c d e f g"), (2, ""), (2, None), (3, "x y"), (None, None)]))


def test_large_buckets_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    base = ["t%d" % k for k in range(300)]
    texts = [" ".join(base[:150] + ["own%d" % k] + base[150:]) for k in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["class_id"] for x in near_duplicates.near_duplicates(docs).collect()} == {0}


def test_consistent_samples_estimate_similarity():
    sampler = near_duplicates.Sampler(np.ones(4, dtype=np.float32))
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 1 << 48, 400, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:300], r.integers(0, 1 << 48, 100, dtype=np.uint64)]))
    ca, cb = np.ones(len(a), dtype=np.int64), np.ones(len(b), dtype=np.int64)
    same = [(sampler.bands(np.array([0]), a, ca) == sampler.bands(np.array([0]), a, ca)).all()]
    assert all(same)
    # chance that a band agrees is similarity ** ROWS; 300 of 500 here
    agree = (sampler.bands(np.array([0]), a, ca) == sampler.bands(np.array([0]), b, cb)).mean()
    assert abs(agree - 0.6**near_duplicates.ROWS) < 0.35


def _align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment_is_smith_waterman():
    r = np.random.default_rng(1)
    item, win = r.integers(0, 4, (30, 12)), r.integers(0, 4, (30, 25))
    size = r.integers(5, 13, 30)
    for k in range(30):
        item[k, size[k] :] = -3
    got, _ = decontaminate.smith_waterman(item, size, win)
    assert got.tolist() == [_align(item[k, : size[k]], win[k]) for k in range(30)]


def test_contamination_against_brute_force(spark):
    r = random.Random(2)
    pool = ["v%d" % k for k in range(300)]
    items = [(k, " ".join(_words(r, r.randint(8, 40), pool))) for k in range(12)] + [(90, None), (91, ""), (92, "too short"), (None, "no id but words enough here")]
    texts = [" ".join(_words(r, 150, pool)) for _ in range(40)] + [None, "", "x"]
    for k in range(12):
        w = items[k][1].split()
        for j in range(0, len(w), 7):  # edited copies
            w[j] = "changed"
        texts.append(" ".join(_words(r, 60, pool) + w + _words(r, 60, pool)))
        texts.append(items[k][1].upper() + " and more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: {y["item_id"] for y in x["_found"]} for x in decontaminate.contamination(docs, bench).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = decontaminate.item_words(t)
        want = {k for k, s in items[:12] if words and _align(decontaminate.item_words(s), words) >= decontaminate.THRESHOLD * len(s.split())}
        assert got[i] == want, (i, got[i], want)
    assert sum(map(bool, got.values())) == 24
    assert decontaminate.contamination(docs, bench.limit(0)).where("size(_found) > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def _base(t):
    digits = lambda s: re.sub(r"\D", "", s)
    return {
        "email": [m.span() for m in MAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15],
    }


def test_sanitisation_spans_against_patterns(spark, tmp_path):
    r = random.Random(3)
    bits = ["4111-1111 1111 1111", "+4930123456", "a.b@c.de", "10.0.0.1", "256.1.1.1", ".", "@", "x", " ", "7", "é", "\n", "-", "+", "😀"]
    texts = ["", None, "a@b.c_d@e.f x", "1.2.3.4.5.6.7.8", "9" * 3000, "x" * 2000 + "@a.b", "1.2.3.4@x.y"] + ["".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(120)]
    spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, h int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sanitise.op10_sanitisation(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for x in got:
        b = _base(texts[x["doc_id"]] or "")
        line = ",".join(f"{k}:{s}:{e}" for k in sanitise.KINDS for s, e in b[k])
        assert x["base_sha256"] == hashlib.sha256(line.encode()).hexdigest() and x["spans"] == line
        assert all(x[f"n_{k}"] == len(b[k]) for k in sanitise.KINDS)


def test_disclosive_terms_go_and_common_ones_stay(spark):
    rows = [(k, f"Contact Zorblax Quimby at bob@x.com today number{'abc'[k % 3]} w{k}") for k in range(6)] + [(10 + k, "some other plain words today at Contact") for k in range(50)] + [(70, None)]
    got = sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {x["doc_id"]: x["r"] for x in got.select("doc_id", sanitise.redacted(got).alias("r")).collect()}
    assert out[0] == "Contact [TERM] [TERM] at [EMAIL] today numbera w0" and out[10] == rows[6][1] and out[70] == ""
    assert sanitise.sanitise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_terms_of_entities_in_one_text_go(spark):
    rows = [(0, "Contact Zorblax today at zz@x.com"), *((k, "Ask Quimby today at qq@x.com") for k in range(1, 31))]
    rows += [(k, "Contact and ask them today at noon") for k in range(40, 1040)]
    got = sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {x["doc_id"]: x["r"] for x in got.select("doc_id", sanitise.redacted(got).alias("r")).collect()}
    assert out[0] == "Contact [TERM] today at [EMAIL]" and out[40] == rows[40][1]
    assert {out[k] for k in range(1, 31)} == {"Ask [TERM] today at [EMAIL]"}


def test_terms_go_everywhere_in_their_documents(spark):
    far = " and then more" * 40
    rows = [(0, f"Yu Zorblax 778120{far} me@x.com{far} signed yu ZORBLAX"), (1, f"and then more 2024 Nobody{far}")]
    rows += [(k, "and then more signed by all in 2024") for k in range(2, 602)]
    rows += [(None, "Uma writes: u@m.org, +49 30 123456"), (None, "Uma writes: u@m.org, +49 30 123456"), (7, None)]
    got = sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string"))
    out = collections.defaultdict(list)
    for x in got.select("doc_id", sanitise.redacted(got).alias("r")).collect():
        out[x["doc_id"]].append(x["r"])
    assert out[0] == [f"[TERM] [TERM] [TERM]{far} [EMAIL]{far} signed [TERM] [TERM]"] and out[1] == [rows[1][1]]
    assert out[None] == ["[TERM] writes: [EMAIL], [PHONE]"] * 2  # one text in two copies: only what looks like a name goes
    assert sorted(out[7]) == sorted([rows[7][1], ""])


def test_disclosure_against_brute_force(spark):
    r = random.Random(5)
    word = lambda k: f"w{k}" if k % 4 == 0 else "v" + "".join("abcdefghij"[int(c)] for c in str(k))
    pool = [word(int(300 * r.random() ** 3)) for _ in range(600)]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(1, 30))) + "".join(f" ; u{r.randrange(9)}@x.com" for _ in range(r.choice((0, 0, 0, 1, 2)))) for _ in range(800)]
    texts += [texts[k] for k in range(20)] * 3
    held = [(set(m[0] for m in MAIL.finditer(t)), set(re.findall(r"\w+", MAIL.sub(" ", t)))) for t in texts]
    n, n_e, n_t, n_et = len(texts), collections.Counter(), collections.Counter(), collections.Counter()
    together = collections.defaultdict(set)
    for text, (es, ts) in zip(texts, held, strict=True):
        for e in es:
            for t in ts:
                together[e, t].add(text)
        n_e.update(es)
        n_t.update(ts)
        n_et.update((e, t) for e in es for t in ts)

    def shown(e, t):
        base = n_e[e] / n
        return np.log2((n_et[e, t] + sanitise.PRIOR * base) / (n_t[t] + sanitise.PRIOR) / base) / -np.log2(base)

    got = sanitise.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), disclosure=0.5)
    seen = 0
    for x in got.select("doc_id", "_term").collect():
        t, (es, ts) = texts[x["doc_id"]], held[x["doc_id"]]
        want = {w for w in ts if any(shown(e, w) >= 0.5 and (w[0] == "w" or len(together[e, w]) > 1) for e in es)}
        assert {t[y["s"] : y["e"]] for y in x["_term"]} == want
        seen += len(want)
    assert seen


def test_forward_backward_is_exact():
    r = np.random.default_rng(4)
    m = language_id.Crf(["a", "b", "c"], np.zeros(0, dtype=np.uint64))
    m.move, m.start = r.normal(size=(3, 3)), r.normal(size=3)
    e, lens = r.normal(size=(9, 3)), np.array([4, 2, 3])
    p, _, log_z = m.posteriors(e, lens)
    at, total = 0, 0.0
    for n in lens:
        mass = np.zeros((n, 3))
        for path in np.ndindex(*(3,) * n):
            s = m.start[path[0]] + sum(e[at + t, y] for t, y in enumerate(path)) + sum(m.move[a, b] for a, b in zip(path, path[1:], strict=False))
            for t, y in enumerate(path):
                mass[t, y] += np.exp(s)
        total += np.log(mass[0].sum())
        np.testing.assert_allclose(p[at : at + n], mass / mass.sum(axis=1, keepdims=True), atol=1e-9)
        at += n
    assert abs(log_z - total) < 1e-6


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.op1_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98 and got["score"].between(0, 1).all()
    model = language_id.fit(language_id.training_rows(docs))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (None, "the and of"), (5, "the " * 5000 + "\n")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    out = {x["doc_id"]: x for x in language_id.identify(odd, model).collect()}
    assert [out[k]["_lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and out[None]["_lang_pred"] == out[5]["_lang_pred"] == "en"
    assert {x["_lang_pred"] for x in language_id.identify(odd, None).collect()} == {"und"}
    assert language_id.fit([]) is None


@pytest.fixture(scope="module")
def quality_models(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    targets = ["quality", "toxic"]
    rows = quality.training_rows(docs.where(fold != 2), labels.where(fold != 2), targets)
    return docs, labels.where(fold == 2), quality.learn(rows, targets)


def test_quality_held_out(quality_models):
    docs, held, models = quality_models
    got = quality.score(docs, models).join(held, "doc_id").toPandas()
    assert ((got["quality_score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.97
    assert ((got["toxic_score"] >= 0.5) == (got["toxic"] == 1)).mean() > 0.95


def test_quality_odd_rows(spark, quality_models):
    models = quality_models[2]
    schema = "doc_id long, text string, source string, lang string, n_chars long, extra string"
    odd = spark.createDataFrame([(None, None, None, None, None, "e"), (1, "", "src0", "en", 0, None), (1, "", "src0", "en", 0, None), (2, "word " * 9000, "", "", -5, "")], schema)
    got = quality.score(odd, models).collect()
    assert len(got) == 4 and all(0 <= x["quality_score"] <= 1 for x in got)
    assert quality.score(odd.limit(0), models).count() == 0
    none = quality.training_rows(odd.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"), ["quality", "toxic"])
    assert quality.score(odd, quality.learn(none, ["quality"])).count() == 4
