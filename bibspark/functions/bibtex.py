"""BibTeX entries from record fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bibspark.functions.records import RECORD_URL

# The order of fields in an entry and the escapes of special characters.
FIELD_ORDER = (
    "author", "editor", "title", "journal", "booktitle", "series", "volume",
    "number", "pages", "year", "month", "publisher", "school", "address",
    "isbn", "doi", "url",
)
ESCAPES = {
    "\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$",
    "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}",
    "~": r"\textasciitilde{}", "^": r"\textasciicircum{}",
}
DOI_LINK = r"(?i)^https?://(?:dx\.)?doi\.org/(.+)"


def escape(value: Column) -> Column:
    """Every special character replaced once; what a replacement brings is left alone.

    Text without any special character, nearly all of it, is passed through."""
    table = F.create_map(*[F.lit(x) for kv in ESCAPES.items() for x in kv])
    spelled = F.array_join(F.transform(F.split(value, ""), lambda c: F.coalesce(table[c], c)), "")
    return F.when(value.rlike(r"[\\&%$#_{}~^]"), spelled).otherwise(value)


def doi_suffix(link: Column) -> Column:
    """What follows the resolver in a DOI link, else null."""
    found = F.regexp_extract(link, DOI_LINK, 1)
    return F.when(found != "", found)


def entry(key: Column, record_type: Column, fields: dict[str, Column], ee: Column) -> Column:
    """The entry of a record; fields by BibTeX name (escaped here), ee its first link."""
    linked = F.coalesce(ee, F.lit("")) != ""
    values = dict(fields)
    values["doi"] = F.coalesce(F.when(linked, doi_suffix(ee)), values.get("doi", F.lit(None).cast("string")))
    values["url"] = F.when(linked, ee).otherwise(F.concat(F.lit(RECORD_URL), key))
    kind = F.when(record_type.isin("www", "data"), "misc").otherwise(record_type)
    lines = [
        F.when(F.coalesce(values[f], F.lit("")) != "", F.concat(F.lit(f"  {f} = {{"), escape(values[f]), F.lit("},")))
        for f in FIELD_ORDER
        if f in values
    ]
    head = F.concat(F.lit("@"), kind, F.lit("{DBLP:"), key, F.lit(","))
    return F.concat(F.array_join(F.array_compact(F.array(head, *lines, F.lit("}"))), "\n"), F.lit("\n"))
