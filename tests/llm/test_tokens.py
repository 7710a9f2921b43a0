import os
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxloom.llm import token_counts, tokens

TEXTS = ["", None, " ", "two  spaces", "trailing ", "▁ mark", "<s> </s>", "日本語 text é́", "a" * 3000, "\n\n a\tb", "it's <|endoftext|> THE end.", "x" * 300 + "ß" * 300, "Ünï-cödé 1234 !!", "same", "same"]


def _docs(spark, texts, clash=False):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"start": F.lit("x"), "part": F.lit(1), "n_tokens": F.lit(None).cast("string")}) if clash else df


def _random_texts(n, alphabet):
    r = random.Random(5)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(1, 400))) for _ in range(n)]


def test_counts_are_the_librarys(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    texts = TEXTS + _random_texts(60, "aabtheion  \n日é▁<s>/")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(_docs(spark, texts, True)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["n_tokens"] == len(sp.encode(t or "")) and got[i]["n_bytes"] == len((t or "").encode())
        assert got[i]["over_limit"] == (got[i]["n_tokens"] > 4096)


def test_long_pretokens_merge_alike():
    m = token_counts.merge_table(token_counts.default_model())
    words = ["▁" + w for w in _random_texts(40, "aabtheioné")]
    assert m.count(words).tolist() == [m.count_long(w) for w in words]


def _ids(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return [np.array([*e.ids, end], dtype="<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_packing_cuts_every_id_once(spark):
    texts = TEXTS + _random_texts(60, "aAbtheion' .,!\n日é<|>0") + ["the end " * 6000]
    docs = _docs(spark, texts, True)
    got = tokens.pack(docs.repartition(3), size=64).collect()
    ids = _ids(texts, 2)
    by, fill = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, x in enumerate(ids):
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(x)
            assert r["ids_crc32"] == zlib.crc32(x[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(x)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(fill) == list(range(len(fill))) and sum(v < 64 for v in fill.values()) <= 1
    assert tokens.pack(docs.limit(0)).count() == 0
    seq = tokens.sequences(tokens.pack(docs, size=64, with_ids=True), size=64).collect()
    assert {len(r["ids"]) for r in seq} == {256}


def test_files_read_back(spark, tmp_path):
    texts = TEXTS + _random_texts(40, "aAbtheion' .,!\n日é0")
    docs = _docs(spark, texts, True).repartition(4)
    path = f"file://{tmp_path}/ids"
    made = tokens.write_token_files(docs, path)
    got = sorted(tokens.read_token_files(made, path, with_ids=True).collect())
    at = 0
    for r, x in zip(got, _ids(texts, 1), strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (at, len(x), zlib.crc32(x.tobytes()), x.tobytes())
        at += len(x)
    assert any(f.endswith(".bin") for f in os.listdir(tmp_path / "ids"))
    empty = f"file://{tmp_path}/none"
    assert tokens.read_token_files(tokens.write_token_files(docs.limit(0), empty), empty).count() == 0


def test_whole_words_as_the_library():
    coder = tokens.word_ids(tokens.default_tokenizer())
    words = ["Straße", "École.", "don't", "a.b", "x\u0085y", "é", "I'M", "№5", "...", "ÀÉ!!", "ﬁn"]
    flat, n = coder.encode(pa.array(words), None)
    assert [len(x) - 1 for x in _ids(words, 0)] == n.tolist()
    assert np.concatenate([x[:-1] for x in _ids(words, 0)]).tolist() == flat.tolist()


def test_counts_of_an_empty_table_and_one_long_text(spark):
    import sentencepiece

    assert token_counts.count_tokens(_docs(spark, ["x"]).limit(0)).collect() == []
    text = "naïve words, " * 60_000
    got = token_counts.count_tokens(_docs(spark, [text])).head()
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    assert got["n_tokens"] == len(sp.encode(text)) and got["n_bytes"] == len(text.encode()) and got["over_limit"]
