import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = [w.translate(LOWER) for w in TERM.findall(text or "")]
        docs[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
        groups[lang or ""].add(source or "")
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        own = {s: {t: counts[lang, s][t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in (own | {None: whole}).items()}
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            term = [(p[None][t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)}
    return out


def _rows(n=400):
    r = random.Random(3)
    words = ["the", "The", "É", "été", "日本", "a", "bb", "naïve", "x1y", "ZZ"] + [f"w{chr(97 + i)}" for i in range(26)]
    langs, sources = ["en", "en", "de", None, ""], ["s1", "s1", "s1", "s2", "é", None, "", "s3"]
    return [(r.choice([", ", " ", "\n", "\x00", "'", "1"]).join(r.choices(words[: r.choice([4, 36])], k=r.randint(0, 30))), r.choice(langs), r.choice(sources)) for _ in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"p": F.lit("x"), "Term": F.lit(1), "bucket": F.lit(None).cast("string")})


@pytest.mark.parametrize("least", [1, 30, 10_000])
def test_equals_the_plain_version(spark, least):
    rows = [*_rows(), (None, "xx", "empty"), (None, "xx", "other"), ("", None, None), ("ab " * 50_000 + "long" * 5000, "en", "s1")] * (1 if least > 1 else 2)
    got = D.divergence(_frame(spark, rows).repartition(3), least, 4).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == plain(rows, least, 4)


def test_blocks_buckets_and_automata_change_nothing(spark, monkeypatch):
    rows = [(t, "en", f"s{i % 23}") for i, (t, *_) in enumerate(_rows(300))]
    want = plain(rows, 5, 50)
    for name, value in (("BLOCK", 5), ("CELL", 20), ("AUTOMATON", 30), ("SENT", 0), ("HELD", 3), ("SLICE", 50)):
        monkeypatch.setattr(D, name, value)
    assert set(map(tuple, D.divergence(_frame(spark, rows), 5).collect())) == want


def test_empty_table(spark):
    assert D.divergence(_frame(spark, [])).collect() == []


def test_a_task_sums_counts_as_numbers_before_they_leave(monkeypatch):
    """Equal keys are held once, however often they come; all leave in bounded batches, none twice."""
    monkeypatch.setattr(D, "HELD", 100)
    monkeypatch.setattr(D, "SENT_ROWS", 7)
    c = D._Counts()
    for _ in range(1000):
        c.add(np.arange(20, dtype=np.int64) << 40 | 3, np.full(20, 2))
        assert not c.full() and c.size <= 120
    got = [tuple(col.to_pylist() for col in b) for b in c.sent()]
    assert [len(a) for a, _, _ in got] == [7, 7, 6] and list(c.sent()) == []
    assert [x for a, b, n in got for x in zip(a, b, n, strict=True)] == [(k, 3, 2000) for k in range(20)]
    c.add(np.arange(101, dtype=np.int64), np.ones(101, dtype=np.int64))
    assert c.full() and sum(len(a) for a, _, _ in c.sent()) == 101
