"""The registered queries of this package, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embeddings, language, licenses, mixing, nearest, prefix_trie, quality, secrets, simhash, spelling, tokens, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn
    return wrap


@query("op1_decontamination")
def op1(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op2_secret_scan", secrets.oracle())
def op2(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return toxicity.classify(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


@query("op4_quality")
def op4(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return quality.classify(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


@query("op5_language")
def op5(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return language.identify(documents, language.fit(documents))


@query("op6_simhash")
def op6(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_embedding_caps")
def op7(spark, sf_dir):
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op8_source_mix", mixing.ORACLE)
def op8(spark, sf_dir):
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


@query("op9_license_scan", licenses.oracle())
def op9(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op10_token_counts")
def op10(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op11_spelling_variants", spelling.ORACLE)
def op11(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op12_prefix_trie", prefix_trie.ORACLE)
def op12(spark, sf_dir):
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


@query("op13_nearest_neighbours")
def op13(spark, sf_dir):
    return nearest.nearest(table(spark, sf_dir, "embeddings"))
