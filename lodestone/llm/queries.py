"""The thin opN_ queries over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, html, langid, lm, mixing, pieces, quality, rules, simhash, urls
from .common import held_out, table

#: The folder of public tokenizer files on every machine.
TOKENIZERS = "/opt/tokenizers"
MODEL = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    if (spec := importlib.util.find_spec("public_tokenizers")) and spec.submodule_search_locations:
        return os.path.join(spec.submodule_search_locations[0], name)
    return os.path.join(TOKENIZERS, name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3))
    found = quality.score_documents(docs, net)
    return found.select("doc_id", held_out("doc_id", 3).alias("held_out"), "score", "predicted")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents")).drop("source")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(MODEL))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm.score_documents(table(spark, sf_dir, "documents"), ~held_out("doc_id", 5))
    return found.withColumn("held_out", held_out("doc_id", 5))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge_documents(table(spark, sf_dir, "documents"))


#: (host and path, block).
URL_RULES = [("com/en/", True), ("example.com/en/7", False), ("net/de/", False), ("example.net/de/8", True), ("org/es/", True)]


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs, ~held_out("doc_id", 3)))
    return found.select("doc_id", held_out("doc_id", 3).alias("held_out"), "lang_pred", "score", "n_spans")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors["vec_id"] % 20 == 0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """None has an SQL form: they learn, draw, compress, hash with XXH64 or approximate; their tests count by brute force."""
    return {}
