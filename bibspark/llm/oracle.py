"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

from bibspark.llm.survivorship import TYPE_ORDER, VENUE_STAND_INS
from bibspark.queries.oracle import kind, listed


def oracle_sql() -> dict[str, str]:
    ranks = " ".join(f"WHEN '{t}' THEN {n}" for n, t in enumerate(TYPE_ORDER))
    bare = r"lower(regexp_replace(regexp_replace(venue, '^[\s(\[<{]+', ''), '[\s)\]>}.?!…]+$', ''))"
    usable_venue = f"coalesce(regexp_matches(venue, '\\p{{L}}') AND {bare} NOT IN {listed(VENUE_STAND_INS)}, false)"
    first = "first(id ORDER BY rank, NOT doi_ok, recency DESC, k, id)"
    found = f"""WITH m AS (SELECT DISTINCT key AS dblp_key, group_id FROM links WHERE key IS NOT NULL AND group_id IS NOT NULL),
r AS (SELECT id, group_id, dblp_key, lower(trim(record_type)) AS t, doi, year, venue FROM publications JOIN m USING (dblp_key)),
v AS (SELECT id, group_id, lower(dblp_key) AS k, CASE {kind('t')} {ranks} END AS rank,
 coalesce(regexp_matches(doi, '(?i)doi\\.org/10\\.[0-9]{{4,}}/\\S'), false) AS doi_ok, coalesce(year BETWEEN 1900 AND 2026, false) AS year_ok,
 CASE WHEN year BETWEEN 1900 AND 2026 THEN year ELSE -1 END AS recency, {usable_venue} AS venue_ok FROM r)
SELECT group_id, {first} AS survivor_id, {first} FILTER (doi_ok) AS doi_id, {first} FILTER (year_ok) AS year_id, {first} FILTER (venue_ok) AS venue_id FROM v GROUP BY group_id"""
    return {"p2_found": found}
