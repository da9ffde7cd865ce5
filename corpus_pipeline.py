"""The corpus pipeline: quality rules, language, near-duplicates, source mix, tokens.

Each stage reads what its predecessor wrote. The first four return rows of documents with all their columns, of any
names; the last returns the digests of the encoded texts. A document that the mix repeats is encoded once for each copy.
A null doc_id is an id like any other; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import langid, mixing, pieces, rules, simhash
from lodestone.llm.common import held_out
from lodestone.llm.queries import MODEL, tokenizer_path
from lodestone.operators.durable import drop_written, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands.

    Null and empty texts have no words and go; very long texts are judged whole and in chunks; repeated rows stay or go
    together.
    """
    return rules.keep_documents(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, by a model that is fitted on this stage's own input.

    Null texts, texts without a letter and, where no row has a lang, all texts go; a null lang only keeps a row out of
    the fitting. A text goes if no language holds half of its letters; ties go to the language that sorts first.
    """
    return langid.keep_identified(docs, langid.fit(docs, ~held_out("doc_id", 3)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id.

    Null texts and texts without words are one group, whose first stays; of rows that repeat id and text one stays; a
    row without an id stays only where its whole group has none.
    """
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight: some documents go, some repeat up to three times.

    Texts without words are never taken; a null source is a source of its own; rows that repeat id and text are taken or
    left together.
    """
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row; null and empty texts have the begin and end ids alone."""
    return pieces.encode_documents(docs, tokenizer_path(MODEL))


STAGES = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("encode", encode),
]

#: Compression ratios, learned language scores and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if k:
            drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
