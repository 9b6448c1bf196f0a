"""One surviving record per group of duplicates, chosen field by field.

A single aggregation takes, for each attribute, the maximum of a composite
struct (usable, source priority, recency, key, value). All attributes are
answered by the same hash aggregate with map-side partial results, so a group
holding a third of all rows costs one small struct per map task and no group
is ever collected.

Defined results: repeated links count once; links without a record are
ignored (a group of only such links gives no row); null keys and null groups
give no row; where no record has a usable value the field's id is null; full
ties on the order are broken by the smaller id. Columns are selected by name
first, so extra columns with clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions.records import reference_type

# The order of the project's types, best first.
TYPE_ORDER = ("journal", "conference", "monograph", "artifact", "other", "preprint")
# What stands in for a venue nobody knows yet.
VENUE_STAND_INS = (
    "unknown", "unknown venue", "n/a", "n.a.", "na", "none", "null", "nil", "tba", "t.b.a.", "tbd", "tbc", "to appear", "to be announced",
    "to be determined", "to be published", "forthcoming", "in press", "in preparation", "submitted", "under review", "accepted", "no venue",
    "not available", "unspecified", "not specified", "undefined", "missing", "venue", "various", "misc", "other", "xxx",
)


def usable_doi(doi: Column) -> Column:
    return F.coalesce(doi.rlike(r"(?i)doi\.org/10\.[0-9]{4,}/\S"), F.lit(False))


def usable_year(year: Column, low: int = 1900, high: int = 2026) -> Column:
    return F.coalesce(year.between(low, high), F.lit(False))


def usable_venue(venue: Column, stand_ins: tuple[str, ...] = VENUE_STAND_INS) -> Column:
    """A name holds a letter and, brackets and case aside, is no stand-in."""
    bare = F.lower(F.regexp_replace(venue, r"^[\s(\[<{]+|[\s)\]>}.?!…]+$", ""))
    return F.coalesce(venue.rlike(r"\p{L}") & ~bare.isin(*stand_ins), F.lit(False))


def survivors(records: DataFrame, groups: DataFrame, first_year: int = 1900, last_year: int = 2026) -> DataFrame:
    """records(id, dblp_key, record_type, doi, year, venue) x groups(key, group_id)
    -> group_id, survivor_id, doi_id, year_id, venue_id."""
    r = records.select("id", "dblp_key", "record_type", "doi", "year", "venue")
    members = groups.select(F.col("key").alias("dblp_key"), "group_id").filter("dblp_key IS NOT NULL AND group_id IS NOT NULL").distinct()
    kind = reference_type(F.lower(F.trim(F.regexp_replace("record_type", r"^\s+|\s+$", ""))), F.col("venue"), F.col("dblp_key"))
    order = F.create_map(*[x for i, t in enumerate(TYPE_ORDER) for x in (F.lit(t), F.lit(len(TYPE_ORDER) - i))])
    year_ok = usable_year(F.col("year"), first_year, last_year)
    valued = r.join(members, "dblp_key").select(
        "group_id",
        "id",
        F.lower("dblp_key").alias("key"),
        order[kind].alias("priority"),
        usable_doi(F.col("doi")).alias("doi_ok"),
        year_ok.alias("year_ok"),
        F.when(year_ok, F.col("year")).otherwise(F.lit(-1)).alias("recency"),
        usable_venue(F.col("venue")).alias("venue_ok"),
    )
    # min_by on an ascending key is the same as the maximum of the composite struct;
    # the text key is the one component that has to run the other way.
    rank = F.struct(-F.col("priority"), ~F.col("doi_ok"), -F.col("recency"), F.col("key"), F.col("id"))

    def best(usable: Column) -> Column:
        return F.min(F.when(usable, F.struct(rank.alias("rank"), F.col("id").alias("value"))))["value"]

    return valued.groupBy("group_id").agg(
        best(F.lit(True)).alias("survivor_id"),
        best(F.col("doi_ok")).alias("doi_id"),
        best(F.col("year_ok")).alias("year_id"),
        best(F.col("venue_ok")).alias("venue_id"),
    )
