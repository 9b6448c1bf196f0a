"""Queries over the problems tagged for language-model data, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.llm import encode, leakage, names, nearrecords, skeleton, spam, survivorship
from bibspark.runtime import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_pairs(table(spark, d, "publication_authors"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.survivors(table(spark, d, "publications"), table(spark, d, "links"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nearrecords.record_pairs(table(spark, d, "publications"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with a near copy: its group and the group's size."""
    g = nearrecords.groups(table(spark, d, "publications"))
    return g.join(g.groupBy("component").agg(F.count("*").alias("members")), "component").select("id", "component", "members")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "publications").select(F.col("id").alias("publication_id"), F.col("title").alias("text"))
    names = table(spark, d, "publication_authors").select("publication_id", F.col("name").alias("text"))
    title = skeleton.inconsistent_rows(titles, "text").select(F.lit("title").alias("field"), "publication_id")
    name = skeleton.inconsistent_rows(names, "text").select(F.lit("name").alias("field"), "publication_id")
    return title.unionByName(name).distinct()


def p5_name_groups(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.skeleton_groups(table(spark, d, "publication_authors"), "name").filter("variants > 1")


def p5_title_groups(spark: SparkSession, d: str) -> DataFrame:
    return skeleton.skeleton_groups(table(spark, d, "publications"), "title").filter("variants > 1")


def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per spelling and entity it belongs to, with the entity's number of spellings."""
    e = cut(names.entities(table(spark, d, "publication_authors")))
    return e.join(e.groupBy("entity").agg(F.count("*").alias("spellings")), "entity").select("name", "entity", "spellings")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("item_id", "doc_id")


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Every post, the passages of test items cut out."""
    return leakage.without_leaking_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_posts(table(spark, d, "documents")).select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_entities, p2_found, p4_found, p4_groups, p5_found, p5_name_groups, p5_title_groups, p7_ids, p8_found, p8_cleaned, p9_found)}


def oracle_sql() -> dict[str, str]:
    from bibspark.llm import oracle

    return oracle.oracle_sql()
