"""Names of classes against how texts vary, template counts without slots, and comment threads that no name gives away."""

import random

import pytest

from voxloom.llm import html_text

WORDS = "river stone cloud paper green window seven music garden bread silver north wheel candle summer letter".split()


def _sentence(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)) + "."


def _page(r, k, body):
    return f'<html><body><div class="top"><a href="/">Start</a> Menu</div>{body}<div class="bottom">All rights kept</div></body></html>'


def _run(spark, bodies):
    """Pages of one host through the Spark job, in order."""
    r = random.Random(1)
    rows = [(k, f"https://h.org/{k}", _page(r, k, b)) for k, b in enumerate(bodies)]
    return [x["text"] for x in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


@pytest.mark.parametrize("name", ["post promo-story", "page comment-policy-article", "related-work", "search-results-section"])
def test_class_words_do_not_drop_what_varies(spark, name):
    r = random.Random(2)
    paras = [[_sentence(r, 25) for _ in range(4)] for _ in range(6)]
    got = _run(spark, [f'<div class="{name}">' + "".join(f"<p>{p}</p>" for p in ps) + "</div>" for ps in paras])
    assert got == ["\n".join(ps) for ps in paras]


def test_sections_of_an_article_stay(spark):
    r = random.Random(3)
    parts = [[_sentence(r, 20) for _ in range(3)] for _ in range(5)]
    got = _run(spark, [f'<article><p>{a}</p><section class="related-work"><p>{b}</p></section><div class="search-results-section"><p>{c}</p></div></article>' for a, b, c in parts])
    assert got == ["\n".join(p) for p in parts]


def test_names_that_only_name_such_parts_drop(spark):
    r = random.Random(4)
    body = [[_sentence(r, 20) for _ in range(4)] for _ in range(5)]
    junk = lambda: "".join(f'<div class="{c}"><p>{_sentence(r, 9)}</p></div>' for c in ("ad-slot-3", "related-posts", "sidebarBox", "comment-list", "site-cookie-banner"))
    got = _run(spark, ["<article>" + "".join(f"<p>{p}</p>" for p in ps) + junk() + f'<article class="comment"><p>{_sentence(r, 8)}</p></article></article>' for ps in body])
    assert got == ["\n".join(ps) for ps in body]


def _thread(r, n, tag="div"):
    names = ["Anna", "Bo Lind", "carl77", "Dee", "Eva", "finn", "Gus", "Hal"]
    r.shuffle(names)
    return "".join(f"<{tag}><b>{names[k % 8]}</b><p>{_sentence(r, r.randint(6, 30))}</p></{tag}>" for k in range(n))


@pytest.mark.parametrize("inside", [True, False])
def test_unnamed_comments_go(spark, inside):
    r = random.Random(5)
    body = [[_sentence(r, 25) for _ in range(3)] for _ in range(6)]
    text = lambda ps: "".join(f"<p>{p}</p>" for p in ps)
    pages = [f"<article>{text(ps)}<div>{_thread(r, 5)}</div></article>" if inside else f"<article>{text(ps)}</article><div>{_thread(r, 14)}</div>" for ps in body]
    assert _run(spark, pages) == ["\n".join(ps) for ps in body]


def test_lists_steps_and_sections_are_no_threads():
    r = random.Random(6)
    lead = "".join(f"<p>{_sentence(r, 30)}</p>" for _ in range(2))
    for items in (
        "".join(f"<li><b>{w}</b> {_sentence(r, 9)}</li>" for w in WORDS[:5]),
        "".join(f"<section><h3>{w}</h3><p>{_sentence(r, 9)}</p></section>" for w in WORDS[:5]),
        "".join(f"<div><span>Step {k}</span><p>{_sentence(r, 9)}</p></div>" for k in range(5)),
        "".join(f"<div><p>{_sentence(r, 30)}</p><p>{_sentence(r, 30)}</p></div>" for _ in range(5)),
    ):
        got = html_text.extract(f"<body><article>{lead}<div>{items}</div></article></body>", None)
        assert len(got.split("\n")) > 6


def test_many_siblings_take_linear_time():
    page = "<article><p>" + "word " * 100 + "</p>" + "<div><p>a</p><p>b c</p></div>" * 20_000 + "</article>"
    assert html_text.extract(page, None).count("\n") == 40_000


@pytest.mark.parametrize("sent", [True, False])
def test_all_shapes_of_a_host_are_learnt(spark, monkeypatch, sent):
    """A host with many layouts: the rare ones have slots and template of their own, and those of the frequent ones stay."""
    if not sent:
        for name in ("SENT", "SENT_BYTES", "SENT_HOSTS"):
            monkeypatch.setattr(html_text, name, 0)
    r = random.Random(9)
    rows, want = [], {}

    def add(paras, body):
        rows.append((len(rows), f"https://h.org/{len(rows)}", _page(r, 0, f"<main>{body}</main>")))
        want[rows[-1][0]] = paras

    for layout in "abcdefghijklmnopqrst":
        for _ in range(9 if layout < "m" else 4):  # 12 frequent shapes and 8 others
            paras = [_sentence(r, 25) for _ in range(3)]
            text = "".join(f"<p>{p}</p>" for p in paras)
            add(paras, f'<article class="kind-{layout}">{text}<table class="{layout}-tail"><tr><td>Write to the desk of {layout} at any time</td></tr></table></article>')
    got = {x["page_id"]: x["text"] for x in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for k, paras in want.items():
        assert got[k] == "\n".join(paras)
