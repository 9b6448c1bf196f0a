"""Raw records to bibliography tables, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions.bibtex import FIELD_ORDER, entry
from bibspark.functions.text import casefold
from bibspark.functions.venues import aliases

NOT_COPIED = ("author", "editor", "url")


def _first(name: str) -> Column:
    """The first value of a field; null if the field is missing."""
    return F.try_element_at(F.try_element_at(F.col("fields"), F.lit(name)), F.lit(1))["text"]


def _all(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("fields"), F.lit(name)), F.array().cast("array<struct<text:string,pid:string>>"))


def publications(raw: DataFrame) -> DataFrame:
    """raw(ordinal, tag, key, mdate, fields) -> the publications table; ids are the ordinals."""
    people = F.transform(F.concat(_all("author"), _all("editor")), lambda p: F.struct(p["text"].alias("name"), p["pid"].alias("pid")))
    named = F.coalesce(_first("booktitle"), _first("journal"), F.lit(""))
    title = F.coalesce(_first("title"), F.lit(""))
    searchable = F.when(named != "", named).when(F.col("tag") == "proceedings", title).otherwise("")
    school = F.coalesce(_first("school"), F.lit(""))
    fallback = F.when(F.col("tag") == "data", F.coalesce(_first("series"), _first("publisher"), F.lit("Data artifact"))).otherwise("")
    venue = F.when(searchable != "", searchable).when(school != "", school).otherwise(fallback)
    year = F.when(_first("year").rlike("^[0-9]{4}$"), _first("year").cast("int"))
    ee = F.coalesce(_first("ee"), F.lit(""))
    doi = F.coalesce(F.try_element_at(F.filter(_all("ee"), lambda e: e["text"].contains("doi.org/")), F.lit(1))["text"], F.lit(""))

    def names(role: str) -> Column:
        joined = F.array_join(F.transform(_all(role), lambda p: F.regexp_replace(p["text"], r" [0-9]{4}$", "")), " and ")
        return F.when(F.size(_all(role)) > 0, joined)

    fields = {f: _first(f) for f in FIELD_ORDER if f not in NOT_COPIED} | {r: names(r) for r in ("author", "editor")}
    return raw.select(
        F.col("ordinal").alias("id"),
        F.col("key").alias("dblp_key"),
        F.col("tag").alias("record_type"),
        title.alias("title"),
        people.alias("people"),
        F.array_join(F.transform(people, lambda p: p["name"]), ", ").alias("authors"),
        year.alias("year"),
        venue.alias("venue"),
        F.when(searchable != "", aliases(searchable)).otherwise("").alias("venue_aliases"),
        doi.alias("doi"),
        ee.alias("ee"),
        "mdate",
        entry(F.col("key"), F.col("tag"), fields, ee).alias("bibtex"),
    )


def publication_authors(pubs: DataFrame) -> DataFrame:
    """One row per named person of a record, blank names dropped."""
    rows = pubs.select(F.col("id").alias("publication_id"), F.explode("people").alias("p")).filter("p.name <> ''")
    return rows.select("publication_id", "p.name", "p.pid", casefold(F.col("p.name")).alias("name_norm"))


def duplicate_keys(pubs: DataFrame) -> DataFrame:
    """Keys that occur more than once; a build with any is refused."""
    return pubs.groupBy("dblp_key").agg(F.count("*").alias("n")).filter("n > 1")


def insert_or_ignore(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and those rows of new whose key old does not have, once each."""
    fresh = new.join(old.select("dblp_key"), "dblp_key", "left_anti").dropDuplicates(["dblp_key"])
    return old.unionByName(fresh.select(*old.columns))
