"""Queries of problems 8, 9 and 10: packing, leaked evaluation texts, and splitting of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strophe.llm.leakage import find_leaks
from strophe.llm.packing import pack_documents
from strophe.llm.pieces import split_documents
from strophe.llm.readings import Readings
from strophe.llm.tokens import VOCABULARIES
from strophe.session import cut

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def p8_packed(spark: SparkSession, d: str, folder: str = VOCABULARIES) -> DataFrame:
    """All documents in containers of 2,048 tokens, a document divided only where it alone exceeds one."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return pack_documents(docs, "doc_id", "text", 2048, VOCABULARY, folder)


def p8_waste(spark: SparkSession, d: str, folder: str = VOCABULARIES) -> DataFrame:
    """One row: containers, tokens, and the share of room left over."""
    p = p8_packed(spark, d, folder)
    c = p.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return c.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), (1 - F.sum("tokens") / (F.count("*") * 2048)).alias("waste"))


def _leaks(spark: SparkSession, d: str, offsets: bool) -> DataFrame:
    readings = Readings.load(spark.read.parquet(f"{d}/char_forms.parquet"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return find_leaks(docs, "doc_id", "text", spark.read.parquet(f"{d}/eval_items.parquet"), "item_id", "text", readings.simplified, offsets=offsets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Each document with each evaluation item of which it carries at least 20 words or 40 ideographs on end."""
    return _leaks(spark, d, offsets=False)


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """As p9_found, with the length of the stretch and where it stands in the original text."""
    return _leaks(spark, d, offsets=True)


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Every evaluation item with the number of documents that carry it; items that leaked nowhere have 0."""
    n = cut(_leaks(spark, d, offsets=False)).groupBy("item_id").agg(F.count("*").alias("documents"))
    items = spark.read.parquet(f"{d}/eval_items.parquet").select("item_id", "task").distinct()
    return items.join(n, "item_id", "left").select("item_id", "task", F.coalesce("documents", F.lit(0)).alias("documents"))


def p10_pieces(spark: SparkSession, d: str, folder: str = VOCABULARIES) -> DataFrame:
    """Documents above 512 tokens as ordered pieces of at most 512, each repeating the last 64 tokens of the one before."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return split_documents(docs, "doc_id", "text", 512, 64, VOCABULARY, folder)


QUERIES = {"p8_packed": p8_packed, "p8_waste": p8_waste, "p9_found": p9_found, "p9_leaks": p9_leaks, "p9_items": p9_items, "p10_pieces": p10_pieces}
SQL: dict[str, str] = {}
