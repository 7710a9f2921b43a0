"""From raw documents to packed training sequences: five stages, each applied to what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm.common import free_name, free_prefix, stage, table
from voxloom.llm.decontaminate import contamination
from voxloom.llm.language_id import fit, identify, training_rows
from voxloom.llm.near_duplicates import deduplicated
from voxloom.llm.sanitise import redacted, sanitise
from voxloom.llm.tokens import pack

SURE = 0.5  # least part of a text's letters that its language must have


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a recognised language.

    Null and empty texts, texts without letters, and those of which no language has half of the letters go; if no row has a
    language to learn from, all go. Repeated rows and null ids are rows like others, texts of any length are read whole,
    an empty table stays empty, and all columns pass through, whatever their names.
    """
    prefix = free_prefix("_lang_", docs)
    got = identify(docs, fit(training_rows(docs)), prefix=prefix)
    return got.where((F.col(f"{prefix}pred") != "und") & (F.col(f"{prefix}score") >= SURE)).select(*_own(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates: the one of the smallest id.

    Rows without words (null, empty, blank) all stay; rows that repeat both id and text become one; a null id stays only
    where its class has no other; texts of any length are compared whole, an empty table stays empty, and all columns pass through, whatever their names.
    """
    return deduplicated(docs).select(*_own(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a test item, copied or edited.

    Null and empty texts hold none and stay; repeated rows share their fate; with an empty benchmark or table nothing goes;
    texts of any length are searched whole, and all columns pass through, whatever their names.
    """
    found = free_name("_found", docs)
    return contamination(docs, table(spark, sf_dir, "benchmark"), found_col=found).where(F.size(found) == 0).select(*_own(docs))


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and disclosive terms; n_chars, if there, follows the new text.

    Every row stays; a null text stays null and an empty one empty; repeated rows are treated alike; texts of any length
    are read whole, an empty table stays empty, and all other columns pass through, whatever their names.
    """
    prefix = free_prefix("_", docs)
    got = sanitise(docs, prefix=prefix)
    text = F.when(F.col("text").isNotNull(), redacted(got, prefix))
    made = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return got.select(*(made[c].alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Concatenate what is left and cut it into fixed windows: a row for each piece.

    Null and empty texts are one end id; repeated rows are packed each; a text of any length is cut as often as needed; an
    empty table gives no rows; only id and text are read, so other columns do not matter.
    """
    return pack(docs)


def _own(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sanitisation", sanitisation),
    ("packing", packing),
]

ORACLE_SQL = None  # models, sampling and alignment are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
