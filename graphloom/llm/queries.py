"""Queries of the text operators, by the names that the driver runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.docpairs import documented_functions, source_functions
from graphloom.llm.leak import find_leaks
from graphloom.llm.origin import label_files
from graphloom.llm.repair import broken_rates, broken_sources
from graphloom.llm.split import split_texts
from graphloom.llm.tokenize import encode_corpus
from graphloom.sources.tables import read


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return broken_sources(read(spark, folder, "files"), read(spark, folder, "file_types")).filter("broken").select("path")


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return broken_rates(read(spark, folder, "files"), read(spark, folder, "file_types"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return documented_functions(read(spark, folder, "nodes")).select("node_id")


def p3_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return documented_functions(read(spark, folder, "nodes"))


def p3_source_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Documented functions in the source texts of documents."""
    return source_functions(read(spark, folder, "documents").filter("doc_kind = 'source'"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return label_files(read(spark, folder, "files")).filter("NOT handwritten").select("path")


def p4_labels(spark: SparkSession, folder: str) -> DataFrame:
    return label_files(read(spark, folder, "files")).groupBy(F.substring_index("path", "/", 1).alias("repository"), "label").agg(F.count("*").alias("files"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(read(spark, folder, "documents"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(read(spark, folder, "documents"), read(spark, folder, "eval_items")).select("doc_id", "item_id").distinct()


def p7_leaked_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which test items leaked, into how many documents, and how much of each at most."""
    found = find_leaks(read(spark, folder, "documents"), read(spark, folder, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("span_words").alias("most_words"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(read(spark, folder, "documents"), with_text=False).filter("piece = 0").select("doc_id")


def p8_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(read(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p2_found, p2_rates, p3_found, p3_pairs, p3_source_pairs, p4_found, p4_labels, p6_ids, p7_found, p7_leaked_items, p8_found, p8_pieces)}
#: Whole-table SQL cannot express these operators; tests hold them against brute force, round trips and fixtures.
ORACLES: dict[str, str] = {}
