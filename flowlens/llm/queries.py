"""Registered queries of the operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import (align, embedup, fim, fstcount, langid, neardup, packing, quality, secrets, suffixdedup, tokenfiles,
                          urlfilter, wordbpe)

try:
    import public_tokenizers
except ModuleNotFoundError:  # the vocabulary files are a parameter of the operators
    public_tokenizers = None

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file, the same on every node: the package's, or below FLOWLENS_TOKENIZERS."""
    folder = os.environ.get("FLOWLENS_TOKENIZERS")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.removed(_table(spark, sf_dir, "documents"), digests=True)


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfiles.write(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)
    return tokenfiles.read(manifest, digests=True)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    model = langid.fit(docs, ~F.coalesce(held_out, F.lit(False)))
    return langid.predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"),
                                              "lang_pred", "score", "ambiguous")


@query
def op5_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


ORACLE["op6_secret_scan"] = secrets.oracle_sql()


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fstcount.count(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


@query
def op8_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0,
                                  cap=packing.Capacity(tokens=2048), with_ids=False)


@query
def op10_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.encode(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), digests=True)


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"),
                       vocabulary("piece_bpe_32k.model"), digests=True)


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(_table(spark, sf_dir, "documents")))


ORACLE["op12_fill_in_middle"] = fim.oracle_sql()


@query
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.verdicts(_table(spark, sf_dir, "pages"))


ORACLE["op13_url_filter"] = urlfilter.oracle_sql()
