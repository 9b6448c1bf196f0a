"""Labels derived from a record: reference type, filter class, version rank, URL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key prefixes of preprint servers, those a rules file may replace first.
RULED_PREFIXES = ("journals/corr/", "journals/eccc/", "journals/iacr/")
PREPRINT_PREFIXES = ("journals/hal/", "journals/ssrn/", "journals/biorxiv/", "journals/medrxiv/")
# Venues that are preprint servers, those a rules file may replace first.
RULED_VENUES = ("corr", "electron. colloquium comput. complex.", "iacr cryptol. eprint arch.")
PREPRINT_VENUES = ("arxiv", "ssrn", "biorxiv", "medrxiv", "hal", "openreview")
# Words in a venue that tell a preprint.
PREPRINT_WORDS = ("preprint", "arxiv", "research square", "chemrxiv", "techrxiv")
# Short labels of venues.
DISPLAY_VENUES = {"CoRR": "arXiv", "Electron. Colloquium Comput. Complex.": "ECCC", "IACR Cryptol. ePrint Arch.": "IACR"}
# The order of reference types, the categories, where a record's page is.
TYPE_RANK = {"journal": 0, "conference": 1, "monograph": 2, "artifact": 3, "other": 4, "preprint": 5}
CATEGORIES = ("journal", "conference", "monograph", "artifact", "informal", "other")
RECORD_URL = "https://dblp.org/rec/"


@dataclass(frozen=True)
class Rules:
    """What venues and key prefixes mean: which are preprint servers, and the labels venues are shown by."""

    venues: tuple[str, ...] = RULED_VENUES + PREPRINT_VENUES
    prefixes: tuple[str, ...] = RULED_PREFIXES + PREPRINT_PREFIXES
    labels: tuple[tuple[str, str], ...] = tuple(DISPLAY_VENUES.items())
    prefix_labels: tuple[tuple[str, str], ...] = ()

    @classmethod
    def of(cls, overrides: dict) -> Rules:
        """The rules of a checked overrides file; the servers it does not name stay preprint servers."""
        flagged = lambda section: tuple(name.casefold() for name, rule in overrides[section].items() if rule.get("preprint"))
        labelled = lambda section: tuple((name, rule["label"]) for name, rule in overrides[section].items() if "label" in rule)
        return cls(flagged("venues") + PREPRINT_VENUES, flagged("key_prefixes") + PREPRINT_PREFIXES, labelled("venues"), labelled("key_prefixes"))


STANDARD = Rules()


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def reference_type(record_type: Column, venue: Column, key: Column, rules: Rules = STANDARD) -> Column:
    """The label of a record. Preprint is tested before conference, and by words in
    the venue too, which the search filter does not do (see filter_class)."""
    v = F.lower(F.coalesce(venue, F.lit("")))
    preprint = preprint_filter(venue, key, rules) | _any([v.contains(w) for w in PREPRINT_WORDS])
    return (
        F.when(record_type == "data", "artifact")
        .when(record_type.isin("book", "phdthesis", "mastersthesis"), "monograph")
        .when(preprint, "preprint")
        .when(record_type == "article", "journal")
        .when(record_type == "inproceedings", "conference")
        .otherwise("other")
    )


def preprint_filter(venue: Column, key: Column, rules: Rules = STANDARD) -> Column:
    """The search filter's notion of a preprint: key prefixes and exact venues only."""
    v, k = F.lower(F.coalesce(venue, F.lit(""))), F.lower(key)
    return _any([k.startswith(p) for p in rules.prefixes]) | v.isin(*rules.venues)


def filter_class(record_type: Column, venue: Column, key: Column, rules: Rules = STANDARD) -> Column:
    """The category a record is filtered by; null for record types outside the six."""
    return (
        F.when((record_type == "article") & preprint_filter(venue, key, rules), "informal")
        .when(record_type == "article", "journal")
        .when(record_type == "inproceedings", "conference")
        .when(record_type.isin("book", "phdthesis", "mastersthesis"), "monograph")
        .when(record_type == "data", "artifact")
        .when(record_type.isin("proceedings", "incollection", "www"), "other")
    )


def version_rank(kind: Column, doi: Column, year: Column, key: Column) -> Column:
    """Ascending: journal first, then those with a DOI, the later year, the smaller key."""
    order = F.create_map(*[x for t, i in TYPE_RANK.items() for x in (F.lit(t), F.lit(i))])
    return F.struct(
        order[kind].alias("kind"), (F.coalesce(doi, F.lit("")) == "").alias("no_doi"), (-F.coalesce(year, F.lit(0))).alias("age"), F.lower(key).alias("key")
    )


def record_url(key: Column) -> Column:
    return F.concat(F.lit(RECORD_URL), key)


def display_venue(venue: Column, key: Column | None = None, rules: Rules = STANDARD) -> Column:
    """The venue's label, else (with the key given) that of the key's prefix, else the venue itself."""
    shown = venue
    for prefix, label in rules.prefix_labels if key is not None else ():
        shown = F.when(F.lower(key).startswith(prefix.casefold()), F.lit(label)).otherwise(shown)
    for name, label in rules.labels:
        shown = F.when(venue == name, F.lit(label)).otherwise(shown)
    return shown


def display_title(title: Column) -> Column:
    return F.regexp_replace(title, r"\.$", "")


def display_name(name: Column) -> Column:
    return F.regexp_replace(name, r" [0-9]{4}$", "")
