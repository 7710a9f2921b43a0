from pyspark.sql import functions as F

from voxloom.llm import language_id, quality


def test_every_language_is_learned_from_and_none_beyond_the_bound(spark):
    few = "lorem ipsum dolor sit amet " * 3000  # 81,000 code points
    small = [(k, f"the word and {k} of it", "en") for k in range(1000, 1400)]
    for at in range(20):
        rows = [*small, *((at * 40 + 4 * k, few, "la") for k in range(4)), (7, None, "xx"), (8, "no language", None)]
        got = language_id.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2), chars=20_000)
        by = {lang: [t for t, g in got if g == lang] for lang in ("en", "la", "xx")}
        assert by["la"] and all(0 < len(t) <= 20_000 and set(t.split()) <= set(few.split()) for t in by["la"]) and not by["xx"]
        assert sum(map(len, by["la"])) <= 40_000 and by["en"] and set(by["en"]) <= {t for _, t, _ in small}
    assert language_id.training_rows(spark.createDataFrame([], "doc_id long, text string, lang string")) == []


def test_the_sample_is_bounded_over_all_languages(spark):
    rows = [(k, f"{'abc def ' * 50}{k}", f"l{k % 40}") for k in range(4000)]
    got = language_id.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars=10_000, total=40_000)
    assert {g for _, g in got} == {f"l{k}" for k in range(40)} and sum(len(t) for t, _ in got) <= 40 * 1500


def test_documents_without_labels_score_one_half(spark):
    docs = spark.createDataFrame([(k, f"some words {k}", "s", "en", 12) for k in range(50)], "doc_id long, text string, source string, lang string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.learn(quality.training_rows(docs, none, ["quality", "toxic"]), ["quality", "toxic"]))
    assert got.where((F.col("quality_score") != 0.5) | (F.col("toxic_score") != 0.5)).count() == 0 and got.count() == 50
