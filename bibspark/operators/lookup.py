"""Records by key: one, many in the order asked for, and their BibTeX."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.operators.search import FIELDS, labelled

MAX_KEYS = 1000


def validated_keys(keys) -> list[str]:
    if not isinstance(keys, list) or not 1 <= len(keys) <= MAX_KEYS:
        raise ValueError(f"1 to {MAX_KEYS} keys are needed")
    if not all(isinstance(k, str) and 1 <= len(k) <= 300 for k in keys):
        raise ValueError("a key is a text of 1 to 300 characters")
    if len(set(keys)) < len(keys):
        raise ValueError("a key occurs twice")
    return keys


def key_table(publications: DataFrame, keys: list[str]) -> DataFrame:
    return publications.sparkSession.createDataFrame(list(enumerate(keys)), "ord int, dblp_key string")


def records(publications: DataFrame, keys: DataFrame) -> DataFrame:
    """keys(ord, dblp_key) with their records; found is false and the rest null where there is none.

    The keys are at most MAX_KEYS, so they are broadcast and the corpus is only scanned."""
    wanted = F.broadcast(keys)
    rows = labelled(publications.join(wanted.select("dblp_key"), "dblp_key", "left_semi").select(*FIELDS))
    return keys.join(rows.withColumn("found", F.lit(True)), "dblp_key", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def bibliography(publications: DataFrame, keys: DataFrame) -> DataFrame:
    """ord, key (with its prefix), bibtex; bibtex null where the record is missing."""
    rows = publications.join(F.broadcast(keys.select("dblp_key")), "dblp_key", "left_semi").select("dblp_key", "bibtex")
    return keys.join(rows, "dblp_key", "left").select("ord", F.concat(F.lit("DBLP:"), F.col("dblp_key")).alias("key"), "bibtex")


def people(publications: DataFrame, key: str) -> DataFrame:
    """position, name, pid of a record's people in order."""
    one = publications.filter(F.col("dblp_key") == key).select(F.posexplode("people").alias("position", "p"))
    return one.select("position", "p.name", "p.pid").filter("name <> ''")
