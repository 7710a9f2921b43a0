import html
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from voxloom.llm import embedding_links, html_text
from voxloom.llm.decontaminate import item_words

DATA = "/root/testdata/sf0.01"


def _article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner)]
    return "\n".join(p for p in parts if p)


def test_articles_whole(spark):
    pages = {x["page_id"]: x for x in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = html_text.op4_main_text(spark, DATA).collect()
    assert len(got) == len(pages)
    for x in got:
        assert x["text"] == _article(pages[x["page_id"]]["html"]) and x["n_chars"] == len(x["text"]) and x["url"] == pages[x["page_id"]]["url"]


PAGE = """<html><body class="has-sidebar"><div id="top" class="site-header"><a>Home</a></div><div class="cookie-notice">We use cookies %s</div><div class="wrap"><div class="sidebar">side %s</div>
<div class="content"><h2>Title %s</h2><p>Para one &amp; %s with <b>bold</b>  text</p><ul><li>point %s<li>last</ul><div class="note">Always here</div><div class="comments"><p>reader says %s</p></div><form>Mail <input></form></div></div>
<footer>Copyright %s</footer></body>"""


def test_slots_without_semantic_markup(spark):
    pages = [PAGE % ((k,) * 7) for k in "abcdef"]
    w = html_text.induce(pages)
    assert html_text.extract(pages[1], w) == "Title b\nPara one & b with bold text\npoint b"  # "last" and the note stand on every page
    assert "reader" not in html_text.extract(pages[1], None) and "Para one & b" in html_text.extract(pages[1], None)


TEASED = """<html><body><div class="c1"><p>Long body text %s that goes on for a while, %s after %s</p><p>and more %s of it, as an article of a page has, with many words in each of its paragraphs</p></div>
<div class="c2"><article class="card"><p>See %.1s</p></article></div></body>"""
THREAD = """<html><body><article class="first"><h1>T%s</h1><p>question %s and a long explanation of it, %s</p></article><div>Ad</div><article class="reply"><p>yes %s</p><div>Read more</div></article>
<div class="c3"><p>summary of the whole matter %s in a sentence</p></div></body>"""


def test_slots_by_variation_not_by_tag():
    for page, want in (
        (TEASED, "Long body text b that goes on for a while, b after b\nand more b of it, as an article of a page has, with many words in each of its paragraphs"),
        (THREAD, "Tb\nquestion b and a long explanation of it, b\nyes b\nsummary of the whole matter b in a sentence"),
    ):
        pages = [page % ((k,) * 5) for k in ("a" * 40, "b", "c" * 30, "d" * 50)]
        assert html_text.extract(pages[1], html_text.induce(pages)) == want
    alone = html_text.extract(TEASED % (("b",) * 5), None)
    assert alone == "Long body text b that goes on for a while, b after b\nand more b of it, as an article of a page has, with many words in each of its paragraphs"


def test_pages_odd_rows(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://h/a", "<p>a&lt;b<p>c"), (3, "http://h/a", "<p>a&lt;b<p>c"), (4, "http://h/b", "<div>" * 3000 + "deep"), (5, "http://h/c", "plain &amp; <script>no()</script> text"), (None, "http://h/d", "<!-- <p>no</p> --><article><h1>T</h1>x<br>y</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "wrapper": F.lit("w"), "text": F.lit("t")})
    got = sorted(((x["page_id"] or 0, x["text"]) for x in html_text.main_text(df).collect()))
    assert got == [(0, "T\nx y"), (1, ""), (2, ""), (3, "a<b\nc"), (3, "a<b\nc"), (4, "deep"), (5, "plain & text")]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_tree_matching_counts_pairs():
    a = html_text.grouped(html_text.parse("<div><p>1</p><ul><li>x</ul><table></table></div>"))
    b = html_text.grouped(html_text.parse("<div><p>1</p><table></table></div>"))
    assert html_text.tree_match(a, b)[0] == 4  # root, div, p, table


def _brute(ids, vectors, cosine):
    good = {}
    for i, v in zip(ids, vectors, strict=True):
        x = None if v is None or any(c is None for c in v) else np.array(v, dtype=float)
        if x is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0:
            good[i] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    links = {i: set() for i in ids}
    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
                links[a].add(b)
    comp = {}
    for i in sorted(ids):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = i
                    todo += links[x]
    return {i: (len(links[i]), comp[i]) for i in ids}


def test_embedding_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_links, "BLOCK", 8)
    r = np.random.default_rng(8)
    base = r.normal(size=(30, 16))
    vectors = [list(map(float, b + s * r.normal(size=16))) for s in (0.0, 0.1, 0.25, 0.4) for b in base for _ in range(2)]
    vectors += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, None] * 8, [1e300] * 16, [1e-300] * 16, [1.0] * 8, [1.0] * 8]
    ids = list(range(100, 100 + len(vectors)))
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "n": F.lit(1), "v": F.lit(2)})
    got = {x["vec_id"]: x for x in embedding_links.embedding_links(df).collect()}
    want = _brute(ids, vectors, 0.9)
    assert {i: (x["n_links"], x["component_id"]) for i, x in got.items()} == want
    assert all(x["kept"] == (i == x["component_id"]) for i, x in got.items())
    assert embedding_links.embedding_links(df.limit(0)).count() == 0


def test_estimates_are_unbiased():
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:50] + 0.3 * r.normal(size=(50, 64)) / 8
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    both = embedding_links.Codes.of(np.concatenate([x, q]))
    est, dev = both.by_sign(slice(0, len(x)), slice(len(x), None))
    err = est - x @ q.T
    assert (np.abs(err.mean(axis=0)) < 0.01).all() and (np.abs(err) <= embedding_links.SURE * dev).all()
    a, b = np.repeat(np.arange(50), 50), len(x) + np.tile(np.arange(50), 50)
    est, dev = both.by_levels(a, b)
    err = est - np.einsum("ij,ij->i", x[a], q[b - len(x)])
    assert abs(err.mean()) < 0.005 and (np.abs(err) <= embedding_links.SURE * dev).all()


def test_pipeline_stages_hold(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "1234 !!", "en", "s", 7), (None, "the and of that", "en", None, 15)], src.schema)
    src.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(step(spark, docs, str(tmp_path)), f"test-{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == src.columns
    at = lambda n: {x["doc_id"]: x["text"] for x in seen[n]}
    a, b, c, d = (at(n) for n in ("language_id", "near_dedup", "decontamination", "sanitisation"))
    assert len(a) == src.count() + 1 and not {9001, 9002, 9003} & set(a)
    texts = [x for x in a.values()]
    assert len(set(b.values())) == len(b) and set(b) <= set(a) and set(b.values()) <= set(texts)
    items = [" ".join(item_words(x["text"])) for x in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()]
    holds = lambda t: any(i in " ".join(item_words(t)) for i in items)
    assert not any(map(holds, c.values())) and all(i in c or holds(b[i]) for i in b)
    assert set(d) == set(c) and not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[a-z]", t) for t in d.values())
    assert {x["doc_id"] for x in seen["packing"]} == set(d)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])
