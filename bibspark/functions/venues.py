"""Searchable short names of venues, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count, organisations that may be left off, curated short names.
STOP_WORDS = ("a", "an", "and", "at", "for", "in", "of", "on", "the", "to", "with")
ORGANIZATIONS = ("ACM", "IEEE", "IFIP", "SIAM")
CURATED = {
    "acm trans. database syst.": "TODS",
    "acm trans. comput. syst.": "TOCS",
    "acm trans. graph.": "TOG",
    "acm trans. inf. syst.": "TOIS",
    "acm trans. internet techn.": "TOIT",
    "acm trans. math. softw.": "TOMS",
    "acm trans. program. lang. syst.": "TOPLAS",
    "acm trans. softw. eng. methodol.": "TOSEM",
    "acm comput. surv.": "CSUR",
    "proc. vldb endow.": "PVLDB",
}


def _upper_word(w: Column) -> Column:
    return (w == F.upper(w)) & w.rlike("[A-Z]")


def aliases(venue: Column) -> Column:
    """Acronyms a venue is looked up by: its own capitals, initials with and without
    a leading organisation, and the curated name; sorted and joined by blanks."""
    venue = F.coalesce(venue, F.lit(""))
    tokens = F.filter(F.regexp_extract_all(venue, F.lit("([A-Za-z][A-Za-z0-9]*)"), 1), lambda w: ~F.lower(w).isin(*STOP_WORDS))
    capitals = F.filter(tokens, lambda w: _upper_word(w) & F.length(w).between(2, 12))
    first = F.try_element_at(tokens, F.lit(1))
    rest = F.when(F.coalesce(F.upper(first).isin(*ORGANIZATIONS), F.lit(False)), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(
        F.array().cast("array<string>")
    )

    def initials(ws: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w: F.upper(F.substring(w, 1, 1))), "")

    def compact(ws: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w: F.when(_upper_word(w) & (F.length(w) <= 8), F.upper(w)).otherwise(F.upper(F.substring(w, 1, 1)))), "")

    formed = F.array(*[F.when(F.size(ws) > 1, f(ws)) for ws in (tokens, rest) for f in (initials, compact)])
    known = F.create_map(*[F.lit(x) for kv in CURATED.items() for x in kv])[F.lower(F.trim(venue))]
    found = F.array_compact(F.concat(capitals, formed, F.array(known)))
    return F.when(F.size(tokens) > 0, F.array_join(F.array_sort(F.array_distinct(found)), " ")).otherwise("")
