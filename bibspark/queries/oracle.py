"""The same results in SQL, for engines that read the same tables."""

from __future__ import annotations

from bibspark.functions.bibtex import ESCAPES, FIELD_ORDER
from bibspark.functions.records import CATEGORIES, DISPLAY_VENUES, PREPRINT_WORDS, RECORD_URL
from bibspark.functions.venues import CURATED, ORGANIZATIONS, STOP_WORDS
from bibspark.plans.query import SEARCH_WEIGHTS, TITLE_WEIGHTS, Phrase, plan
from bibspark.queries import core

# Fixed values, written out again so that a slip in the engine's own shows: what tells a preprint.
PREPRINT_PREFIXES = ("journals/corr/", "journals/eccc/", "journals/iacr/", "journals/hal/", "journals/ssrn/", "journals/biorxiv/", "journals/medrxiv/")
PREPRINT_VENUES = ("corr", "electron. colloquium comput. complex.", "iacr cryptol. eprint arch.", "arxiv", "ssrn", "biorxiv", "medrxiv", "hal", "openreview")

# Nodes of the payload that counts per key, arrays left out: their document order, depth and the number of nodes below give the labels.
NODES = r"""latest AS (SELECT key, payload FROM bib_raw WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY mdate DESC NULLS LAST, ordinal DESC) = 1),
whole AS (SELECT publication_id, CASE WHEN json_type(payload, '$.record') = 'VARCHAR' AND json_valid(payload ->> '$.record') THEN '{"record": ' || (payload ->> '$.record') || '}' ELSE payload END AS payload FROM (
  SELECT p.id AS publication_id, CASE WHEN json_type(l.payload) = 'VARCHAR' THEN l.payload ->> '$' ELSE l.payload END AS payload
  FROM (SELECT key, trim(payload, chr(65279) || ' ' || chr(9) || chr(10) || chr(13)) AS payload FROM latest) l JOIN publications p ON p.dblp_key = l.key WHERE json_valid(l.payload))),
raw_nodes AS (SELECT publication_id, t.fullkey AS fk, t.type, t.id, json_extract_string(payload, t.fullkey) AS value FROM whole, LATERAL json_tree(payload) t WHERE t.type <> 'ARRAY'),
nodes AS (SELECT *, replace(regexp_replace(fk, '\[[0-9]+\]', '', 'g'), '$.', '') AS path, row_number() OVER (PARTITION BY publication_id ORDER BY id) AS pre,
  (SELECT count(*) FROM raw_nodes b WHERE b.publication_id = a.publication_id AND (starts_with(b.fk, a.fk || '.') OR starts_with(b.fk, a.fk || '['))) AS below,
  (SELECT count(*) FROM raw_nodes b WHERE b.publication_id = a.publication_id AND (starts_with(a.fk, b.fk || '.') OR starts_with(a.fk, b.fk || '['))) AS depth FROM raw_nodes a),
said AS (SELECT *, pre + below - depth AS post FROM nodes WHERE type <> 'NULL' AND (type <> 'VARCHAR' OR trim(value) <> '')),
persons AS (SELECT *, row_number() OVER (PARTITION BY publication_id ORDER BY pre) AS person_no FROM said WHERE path = 'record.groups.members'),
affs AS (SELECT a.*, p.person_no, p.pre AS parent_pre, row_number() OVER (PARTITION BY a.publication_id, p.pre ORDER BY a.pre) AS affiliation_no
  FROM said a JOIN persons p ON p.publication_id = a.publication_id AND starts_with(a.fk, p.fk || '.') WHERE a.path = 'record.groups.members.affiliations')"""


def first_below(above: str, path: str, text_only: bool = False) -> str:
    """The first value of a type below a node, in document order."""
    kind = " AND n.type = 'VARCHAR'" if text_only else ""
    return f"(SELECT n.value FROM said n WHERE n.publication_id = {above}.publication_id AND starts_with(n.fk, {above}.fk || '.') AND n.path = '{path}'{kind} ORDER BY n.pre LIMIT 1)"


def nested_sql() -> dict[str, str]:
    person, venue = "record.groups.members", "record.venue"
    first = lambda path, kind="": f"(SELECT n.value FROM said n WHERE n.publication_id = w.publication_id AND n.path = '{path}'{kind} ORDER BY n.pre LIMIT 1)"
    out = {}
    out["p3_people"] = (
        f"WITH {NODES} SELECT publication_id, person_no, CASE WHEN type = 'VARCHAR' THEN value ELSE coalesce({first_below('p', person + '.name.text')}, {first_below('p', person + '.name', True)}) END AS name, "
        f"{first_below('p', person + '.name.pid')} AS pid, pre, post FROM persons p"
    )
    out["p3_affiliations"] = (
        f"WITH {NODES} SELECT publication_id, person_no, affiliation_no, CASE WHEN type = 'VARCHAR' THEN value ELSE {first_below('a', person + '.affiliations.org')} END AS org, "
        f"try_cast({first_below('a', person + '.affiliations.from')} AS INTEGER) AS from_year, {first_below('a', person + '.affiliations.unit.name')} AS unit FROM affs a"
    )
    text = " AND n.type = 'VARCHAR'"
    out["p3_venues"] = (
        f"WITH {NODES}, v AS (SELECT publication_id, coalesce({first(venue, text)}, {first(venue + '.name')}) AS venue, {first(venue + '.series.title')} AS series, "
        f"try_cast({first(venue + '.series.volumes.no')} AS INTEGER) AS volume FROM whole w) SELECT * FROM v WHERE venue IS NOT NULL OR series IS NOT NULL OR volume IS NOT NULL"
    )
    out["p3_volumes"] = (
        f"WITH {NODES}, v AS (SELECT *, row_number() OVER (PARTITION BY publication_id ORDER BY pre) AS volume_no FROM said WHERE path = '{venue}.series.volumes') "
        f"SELECT publication_id, volume_no, {first_below('v', venue + '.series.volumes.no')} AS no FROM v"
    )
    out["p3_linked"] = f"WITH {NODES} SELECT publication_id, parent_pre, pre, post FROM affs"
    return out

# Compatibility forms met in the tables: full-width letters, special blanks, the unbreakable hyphen.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)).lower() + "\u00a0\u2007\u2009\u202f\u3000\u2011"
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).lower() + "     \u2010"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


def fold(x: str) -> str:
    y = f"translate(lower({x}), {quoted(_WIDE)}, {quoted(_NARROW)})"
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬀ", "ff"), ("ß", "ss"), ("ς", "σ")):
        y = f"replace({y}, '{a}', '{b}')"
    return f"strip_accents({y})"


def tokens(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({x}, ''))), '[\\p{{L}}\\p{{N}}]+')"


def preprint(words: bool) -> str:
    tests = [f"starts_with(lower(dblp_key), {quoted(p)})" for p in PREPRINT_PREFIXES] + [f"lower(coalesce(venue, '')) IN {listed(PREPRINT_VENUES)}"]
    if words:
        tests += [f"contains(lower(coalesce(venue, '')), {quoted(w)})" for w in PREPRINT_WORDS]
    return "(" + " OR ".join(tests) + ")"


def kind(record_type: str = "record_type") -> str:
    return (
        f"CASE WHEN {record_type} = 'data' THEN 'artifact' WHEN {record_type} IN ('book', 'phdthesis', 'mastersthesis') THEN 'monograph' "
        f"WHEN {preprint(True)} THEN 'preprint' WHEN {record_type} = 'article' THEN 'journal' WHEN {record_type} = 'inproceedings' THEN 'conference' ELSE 'other' END"
    )


CATEGORY = (
    f"CASE WHEN record_type = 'article' AND {preprint(False)} THEN 'informal' WHEN record_type = 'article' THEN 'journal' "
    "WHEN record_type = 'inproceedings' THEN 'conference' WHEN record_type IN ('book', 'phdthesis', 'mastersthesis') THEN 'monograph' "
    "WHEN record_type = 'data' THEN 'artifact' WHEN record_type IN ('proceedings', 'incollection', 'www') THEN 'other' END"
)
TYPE_RANK = "CASE {k} WHEN 'journal' THEN 0 WHEN 'conference' THEN 1 WHEN 'monograph' THEN 2 WHEN 'artifact' THEN 3 WHEN 'other' THEN 4 ELSE 5 END"

DOCS = f"docs AS (SELECT id, {tokens('title')} AS c0, {tokens('authors')} AS c1, {tokens('venue')} AS c2, {tokens('venue_aliases')} AS c3 FROM publications)"
POST = "post AS (" + " UNION ALL ".join(f"SELECT id, {k} AS col, unnest(c{k}) AS term, generate_subscripts(c{k}, 1) - 1 AS pos FROM docs" for k in range(4)) + ")"
LENGTHS = "lens AS (SELECT id, len(c0) + len(c1) + len(c2) + len(c3) AS n_tokens FROM docs)"


def scored(phrases: tuple[Phrase, ...], weights: tuple[float, ...] = SEARCH_WEIGHTS) -> str:
    """CTEs that end in hits(id, score)."""
    rows = ", ".join(f"({n}, {quoted(p.tokens[0])}, {str(p.prefix).lower()}, {p.clause}, {list(p.columns)})" for n, p in enumerate(phrases))
    weight = "CASE col " + " ".join(f"WHEN {k} THEN {w}::DOUBLE" for k, w in enumerate(weights)) + " END"
    clauses = len({p.clause for p in phrases})
    return f"""WITH {DOCS}, {POST}, {LENGTHS},
ph(phrase, token, pre, clause, cols) AS (VALUES {rows}),
corpus AS (SELECT count(*) AS n_docs, avg(n_tokens) AS avgdl FROM lens),
per AS (SELECT phrase, clause, id, sum({weight}) AS f FROM post JOIN ph ON (term = token OR (pre AND starts_with(term, token))) AND list_contains(cols, col) GROUP BY ALL),
freq AS (SELECT phrase, count(*) AS n_i FROM per GROUP BY phrase),
idf AS (SELECT phrase, avgdl, CASE WHEN ln((n_docs - n_i + 0.5) / (n_i + 0.5)) > 0 THEN ln((n_docs - n_i + 0.5) / (n_i + 0.5)) ELSE 1e-6 END AS idf FROM freq, corpus),
hits AS (SELECT id, -sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_tokens / avgdl))) AS score
  FROM per JOIN idf USING (phrase) JOIN lens USING (id) GROUP BY id HAVING count(DISTINCT clause) = {clauses})"""


AUTHOR_NAMES = "names AS (SELECT name_norm, min(name) AS name, count(*) AS publications FROM publication_authors GROUP BY name_norm)"


def suffixes(x: str) -> str:
    parts = f"list_filter(regexp_split_to_array(trim(regexp_replace({x}, '\\s+[0-9]{{4}}$', '')), '\\s+'), lambda p: p <> '')"
    return f"parts AS (SELECT name_norm, {parts} AS ps FROM names), sfx AS (SELECT DISTINCT array_to_string(list_slice(ps, i, len(ps)), ' ') AS suffix_folded, name_norm FROM (SELECT name_norm, ps, unnest(range(2, len(ps) + 1)) AS i FROM parts))"


def by_author(author: str) -> str:
    return f"""SELECT publication_id FROM publication_authors WHERE starts_with(name_norm, {quoted(author)})
UNION SELECT publication_id FROM publication_authors WHERE name_norm IN (SELECT name_norm FROM sfx WHERE starts_with(suffix_folded, {quoted(author)}))"""


IDENTITY = """CASE WHEN len(ids) > 0 THEN array_to_string(ids, '|') ELSE 'key:' || dblp_key END"""
WITH_IDS = """ident AS (SELECT *, list_sort(list_filter(list_transform(string_split(<low>, ', '), lambda n: trim(regexp_replace(n, '\\s+', ' ', 'g'))), lambda n: n <> '')) AS ids FROM publications)"""


def casefold(x: str) -> str:
    return f"replace(replace(replace(replace(replace(lower({x}), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ß', 'ss'), 'ς', 'σ')"


def norm_title(x: str = "title") -> str:
    y = f"regexp_replace({fold(f'coalesce({x}, chr(32))')}, '\\((preliminary version|extended abstract|abstract)\\)', ' ', 'g')"
    for _ in range(2):
        y = f"regexp_replace({y}, '([\\p{{L}}\\p{{N}}_])[''’]([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    return f"array_to_string(regexp_extract_all({y}, '[\\p{{L}}\\p{{N}}_]+'), ' ')"


RANKED = f"""{WITH_IDS.replace("<low>", casefold("coalesce(authors, '')"))},
lab AS (SELECT *, {IDENTITY} AS identity, {kind()} AS k, {norm_title()} AS nt FROM ident),
ranked AS (SELECT *, {TYPE_RANK.format(k='k')} AS r1, coalesce(doi, '') = '' AS r2, -coalesce(year, 0) AS r3, lower(dblp_key) AS r4 FROM lab)"""


def aliases(head: str = "WITH", source: str = "publications", name: str = "aliases") -> str:
    stop = listed(STOP_WORDS)
    ups = "(w = upper(w) AND regexp_matches(w, '[A-Z]'))"

    def initials(ws: str) -> str:
        return f"CASE WHEN len({ws}) > 1 THEN array_to_string(list_transform({ws}, lambda w: upper(w[1])), '') END"

    def compact(ws: str) -> str:
        return f"CASE WHEN len({ws}) > 1 THEN array_to_string(list_transform({ws}, lambda w: CASE WHEN {ups} AND length(w) <= 8 THEN upper(w) ELSE upper(w[1]) END), '') END"

    curated = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in CURATED.items())
    return f"""{head} t AS (SELECT id, venue, list_filter(regexp_extract_all(coalesce(venue, ''), '[A-Za-z][A-Za-z0-9]*'), lambda w: lower(w) NOT IN {stop}) AS ws FROM {source}),
u AS (SELECT *, CASE WHEN len(ws) > 0 AND upper(ws[1]) IN {listed(ORGANIZATIONS)} THEN ws[2:] ELSE []::VARCHAR[] END AS rs FROM t)
SELECT id, CASE WHEN len(ws) = 0 THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter(list_concat(list_filter(ws, lambda w: {ups} AND length(w) BETWEEN 2 AND 12),
[{initials('ws')}, {compact('ws')}, {initials('rs')}, {compact('rs')}, CASE lower(trim(coalesce(venue, ''))) {curated} END]), lambda w: w IS NOT NULL))), ' ') END AS {name} FROM u"""


def escaped(x: str) -> str:
    cases = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in ESCAPES.items())
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE array_to_string(list_transform(string_split({x}, ''), lambda c: CASE c {cases} ELSE c END), '') END"


def raw(name: str) -> str:
    return f"fields['{name}'][1].text"


def raw_all(name: str) -> str:
    return f"coalesce(fields['{name}'], [])"


ETL = f"""e AS (SELECT *, coalesce({raw('title')}, '') AS title, list_concat({raw_all('author')}, {raw_all('editor')}) AS people,
 coalesce({raw('booktitle')}, {raw('journal')}, '') AS named, coalesce({raw('school')}, '') AS school, coalesce({raw('ee')}, '') AS ee,
 coalesce({raw('series')}, {raw('publisher')}, 'Data artifact') AS stand_in FROM bib_raw),
s AS (SELECT *, CASE WHEN named <> '' THEN named WHEN tag = 'proceedings' THEN title ELSE '' END AS searchable FROM e)"""


def entry_sql() -> str:
    def people(role: str) -> str:
        return f"CASE WHEN len({raw_all(role)}) > 0 THEN array_to_string(list_transform({raw_all(role)}, lambda p: regexp_replace(p.text, ' [0-9]{{4}}$', '')), ' and ') END"

    doi = f"coalesce(CASE WHEN ee <> '' THEN nullif(regexp_extract(ee, '(?i)^https?://(?:dx\\.)?doi\\.org/(.+)', 1), '') END, {raw('doi')})"
    values = {f: raw(f) for f in FIELD_ORDER} | {"author": people("author"), "editor": people("editor"), "doi": doi, "url": f"CASE WHEN ee <> '' THEN ee ELSE {quoted(RECORD_URL)} || key END", "title": raw("title")}
    lines = ", ".join(f"CASE WHEN coalesce({v}, '') <> '' THEN '  {f} = {{' || {escaped(v)} || '}},' END" for f, v in values.items())
    head = "'@' || CASE WHEN tag IN ('www', 'data') THEN 'misc' ELSE tag END || '{DBLP:' || key || ','"
    return f"WITH {ETL} SELECT ordinal AS id, array_to_string(list_filter([{head}, {lines}, '}}'], lambda x: x IS NOT NULL), chr(10)) || chr(10) AS bibtex FROM s"


def closest_sql() -> str:
    from bibspark.operators.complete import closest_phrases

    phrases = closest_phrases(core.MISTYPED)
    rows = ", ".join(f"({n}, {quoted(p.tokens[0])})" for n, p in enumerate(phrases))
    k = len(phrases)
    return f"""WITH {DOCS}, {POST}, ph(phrase, token) AS (VALUES {rows}),
have AS (SELECT DISTINCT id, phrase FROM post JOIN ph ON col = 0 AND starts_with(term, token)),
n AS (SELECT id, count(*) AS c, {k * (k - 1) // 2} - sum(phrase) AS gap FROM have GROUP BY id HAVING count(*) >= {k - 1 if k > 1 else k}),
m AS (SELECT id, CASE WHEN c = {k} THEN -1 ELSE gap END::INT AS missing FROM n)
SELECT id, missing FROM m WHERE missing = (SELECT min(missing) FROM m) ORDER BY id LIMIT 5000"""


KEYS = f"linked AS (SELECT DISTINCT key FROM links ORDER BY key LIMIT {core.KEYS}), cart AS (SELECT 0 AS ord, 'x/unknown' AS dblp_key UNION ALL SELECT (row_number() OVER (ORDER BY key))::INT, key FROM linked)"

SNAPSHOTS = """told AS (SELECT snapshot_id, min(try_cast(value AS TIMESTAMPTZ)) FILTER (key = 'downloaded_at') AS told FROM metadata WHERE snapshot_id IS NOT NULL GROUP BY 1),
loaded AS (SELECT snapshot_id, min(loaded_at) AS loaded FROM publication_snapshots WHERE snapshot_id IS NOT NULL GROUP BY 1),
steps AS (SELECT snapshot_id, row_number() OVER (ORDER BY coalesce(told, loaded) NULLS FIRST, snapshot_id) AS pos FROM told FULL JOIN loaded USING (snapshot_id)),
pubs AS (SELECT 'publications' AS entity, dblp_key AS item_key, pos, coalesce(record_type, '') AS f1, coalesce(title, '') AS f2, coalesce(year::VARCHAR, '') AS f3, coalesce(venue, '') AS f4, coalesce(doi, '') AS f5
  FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, dblp_key ORDER BY loaded_at DESC NULLS LAST, record_type DESC NULLS LAST, title DESC NULLS LAST, year DESC NULLS LAST, venue DESC NULLS LAST, doi DESC NULLS LAST) AS rn
    FROM publication_snapshots WHERE dblp_key IS NOT NULL AND snapshot_id IS NOT NULL) JOIN steps USING (snapshot_id) WHERE rn = 1),
meta AS (SELECT 'metadata' AS entity, key AS item_key, pos, coalesce(max(value), '') AS f1, '' AS f2, '' AS f3, '' AS f4, '' AS f5 FROM metadata JOIN steps USING (snapshot_id) WHERE key IS NOT NULL GROUP BY ALL),
everything AS (SELECT * FROM pubs UNION ALL SELECT * FROM meta),
diff AS (SELECT coalesce(b.entity, a.entity) AS entity, coalesce(b.item_key, a.item_key) AS item_key, coalesce(b.pos, a.pos + 1) AS pos,
  CASE WHEN a.pos IS NULL THEN 'added' WHEN b.pos IS NULL THEN 'removed' ELSE 'changed' END AS change,
  array_to_string(list_filter([CASE WHEN a.f5 <> b.f5 THEN 'doi' END, CASE WHEN a.f1 <> b.f1 THEN 'record_type' END, CASE WHEN a.f2 <> b.f2 THEN 'title' END, CASE WHEN a.f4 <> b.f4 THEN 'venue' END, CASE WHEN a.f3 <> b.f3 THEN 'year' END], lambda x: x IS NOT NULL), ',') AS fields
  FROM everything a FULL JOIN everything b ON a.entity = b.entity AND a.item_key = b.item_key AND b.pos = a.pos + 1
  WHERE a.pos IS NULL OR b.pos IS NULL OR a.f1 <> b.f1 OR a.f2 <> b.f2 OR a.f3 <> b.f3 OR a.f4 <> b.f4 OR a.f5 <> b.f5)"""


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = nested_sql()
    text, broad = plan(q=core.TEXT).phrases, plan(q=core.BROAD).phrases
    p = "publications"
    out["bm25_relevance"] = f"{scored(text)} SELECT id, round(score, 6) AS score FROM hits ORDER BY hits.score, id LIMIT 21"
    out["bm25_all_scores"] = f"{scored(broad)} SELECT id, round(score, 6) AS score FROM hits"
    out["fts_and_prefix"] = f"{scored(text)} SELECT h.id, p.dblp_key, p.title FROM hits h JOIN {p} p ON p.id = h.id"
    out["venue_or_alias"] = f"{scored(plan(venue=core.VENUE).phrases)} SELECT h.id, p.venue, round(h.score, 6) AS score FROM hits h JOIN {p} p ON p.id = h.id"
    sfx = f"WITH {AUTHOR_NAMES}, {suffixes(fold('name'))}"
    out["author_prefix_semi"] = f"{sfx} SELECT id, authors FROM {p} WHERE id IN ({by_author(core.AUTHOR)})"
    out["author_exact_semi"] = f"SELECT id FROM {p} WHERE id IN (SELECT publication_id FROM publication_authors WHERE name_norm = 'heliograph survey collaboration')"
    out["author_page"] = f"{sfx} SELECT id, year FROM {p} WHERE id IN ({by_author(core.AUTHOR)}) ORDER BY year DESC NULLS LAST, id DESC LIMIT 301"
    out["year_range"] = f"SELECT id, year FROM {p} WHERE year BETWEEN 2001 AND 2010"
    out["type_filter"] = f"SELECT id, record_type FROM {p} WHERE record_type = 'inproceedings'"
    for c in CATEGORIES:
        out[f"category_{c}"] = f"SELECT id, record_type, venue FROM {p} WHERE {CATEGORY} = '{c}'"
    out["category_set"] = f"SELECT id FROM {p} WHERE {CATEGORY} IN ('journal', 'artifact')"
    by_year = f"{scored(broad)} SELECT p.id, p.year FROM hits h JOIN {p} p ON p.id = h.id ORDER BY "
    out["sort_year_desc_page"] = by_year + "p.year DESC NULLS LAST, p.id DESC LIMIT 21 OFFSET 20"
    out["sort_year_asc_page"] = by_year + "p.year ASC NULLS FIRST, p.id ASC LIMIT 21"
    combined = scored(plan(q="lessons").phrases).removeprefix("WITH ")
    out["search_combined"] = (
        f"{sfx}, {combined} SELECT h.id, round(h.score, 6) AS score FROM hits h JOIN {p} ON {p}.id = h.id "
        f"WHERE year >= 1990 AND {CATEGORY} IN ('journal', 'conference') AND h.id IN ({by_author('heliograph')})"
    )
    out["facet_counts"] = f"{scored(broad)} SELECT {kind()} AS reference_type, count(*) AS n FROM hits JOIN {p} USING (id) GROUP BY 1"
    out["reference_type"] = f"SELECT id, {quoted(RECORD_URL)} || dblp_key AS url, {kind()} AS reference_type FROM {p}"
    out["filter_class"] = f"SELECT id, {CATEGORY} AS category FROM {p}"
    labels = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in DISPLAY_VENUES.items())
    out["display_labels"] = f"SELECT id, regexp_replace(title, '\\.$', '') AS title, CASE venue {labels} ELSE venue END AS venue FROM {p}"
    out["author_identity"] = f"WITH {RANKED} SELECT id, identity FROM lab"
    out["normalized_title"] = f"SELECT id, {norm_title()} AS norm_title FROM {p}"
    out["exact_works"] = (
        f"WITH {RANKED}, w AS (SELECT *, CASE WHEN coalesce(authors, '') = '' OR nt = '' THEN 'key:' || dblp_key ELSE identity || chr(1) || nt END AS work FROM ranked) "
        "SELECT 'group:' || min(dblp_key) AS group_key, first(id ORDER BY r1, r2, r3, r4) AS best_id, count(*) AS versions FROM w GROUP BY work"
    )
    out["version_rank_best"] = f"WITH {RANKED} SELECT identity, first(id ORDER BY r1, r2, r3, r4) AS best_id, count(*) AS n FROM ranked WHERE coalesce(authors, '') <> '' GROUP BY identity"
    out["near_title_pairs"] = (
        f"WITH {RANKED}, t AS (SELECT identity, nt, min(id) AS id, length(nt) AS n FROM lab WHERE coalesce(authors, '') <> '' AND length(nt) >= 24 GROUP BY identity, nt) "
        "SELECT a.id AS id_a, b.id AS id_b FROM t a JOIN t b ON a.identity = b.identity AND a.id < b.id AND abs(a.n - b.n) <= greatest(3, 0.03 * greatest(a.n, b.n)) "
        "AND levenshtein(a.nt, b.nt) <= floor(0.03 * (a.n + b.n) + 1e-9)"
    )
    out["author_names_agg"] = f"WITH {AUTHOR_NAMES} SELECT name_norm, name, publications FROM names"
    out["author_folded"] = f"WITH {AUTHOR_NAMES} SELECT {fold('name')} AS name_folded, name, publications FROM names"
    out["author_suffixes"] = f"{sfx} SELECT suffix_folded, name_norm FROM sfx"
    out["author_rows"] = f"SELECT id AS publication_id, p.name AS name, p.pid AS pid FROM (SELECT id, unnest(people) AS p FROM {p}) WHERE p.name <> ''"
    out["incremental_author_merge"] = f"SELECT name_norm, min(name) AS name, count(*) AS publications FROM publication_authors JOIN {p} ON id = publication_id WHERE record_type IS NOT NULL GROUP BY name_norm"
    out["insert_or_ignore"] = f"SELECT dblp_key, 'old' AS origin FROM {p} UNION ALL SELECT DISTINCT key, 'new' FROM bib_raw WHERE key NOT IN (SELECT dblp_key FROM {p})"
    index = f"WITH {DOCS}, {POST}, {LENGTHS}"
    out["postings_by_column"] = f"{index} SELECT col, count(*) AS tokens, count(DISTINCT term) AS terms, max(pos) AS last_pos FROM post GROUP BY col"
    out["term_frequencies"] = f"{index} SELECT term, count(*) AS tokens, count(DISTINCT id) AS n_docs FROM post GROUP BY term"
    out["doc_lengths"] = f"{index} SELECT id, n_tokens FROM lens"
    out["corpus_stats"] = f"{index} SELECT count(*) AS n_docs, round(avg(n_tokens), 9) AS avgdl FROM lens"
    folded = fold("coalesce(title, '')")
    out["title_grams"] = (
        f"WITH f AS (SELECT id, {folded} AS t FROM {p}), g AS (SELECT DISTINCT id, substring(t, i, 3) AS gram FROM (SELECT id, t, unnest(range(1, (length(t) - 1)::BIGINT)) AS i FROM f)) "
        "SELECT gram, count(*) AS n FROM g GROUP BY gram"
    )
    out["autocomplete_author"] = (
        f"{sfx}, hit AS (SELECT name, publications FROM names WHERE starts_with({fold('name')}, '{core.SUGGEST}') UNION ALL "
        f"SELECT name, publications FROM names WHERE name_norm IN (SELECT name_norm FROM sfx WHERE starts_with(suffix_folded, '{core.SUGGEST}'))) "
        f"SELECT name, max(publications) AS publications FROM hit GROUP BY name ORDER BY publications DESC, {fold('name')}, name LIMIT 25"
    )
    out["autocomplete_title"] = (
        f"{scored(plan(q='lower bounds for spa').phrases, TITLE_WEIGHTS)} SELECT p.dblp_key, p.title, p.year FROM hits h JOIN {p} p ON p.id = h.id WHERE p.title <> '' ORDER BY h.score, p.id LIMIT 25"
    )
    out |= {f"built_{name}": out[name] for name in ("bm25_relevance", "venue_or_alias", "autocomplete_title", "autocomplete_author")}
    out["closest_candidates"] = closest_sql()
    out["key_lookup_missing"] = f"WITH {KEYS} SELECT ord, c.dblp_key, p.id IS NOT NULL AS found, title, {quoted(RECORD_URL)} || p.dblp_key AS url, CASE WHEN p.id IS NOT NULL THEN {kind().replace('dblp_key', 'p.dblp_key')} END AS reference_type FROM cart c LEFT JOIN {p} p ON p.dblp_key = c.dblp_key"
    out["bibliography"] = f"WITH {KEYS} SELECT ord, 'DBLP:' || c.dblp_key AS key, bibtex FROM cart c LEFT JOIN {p} p ON p.dblp_key = c.dblp_key"
    out["record_people"] = f"SELECT id, (i - 1)::INT AS position, people[i].name AS name, people[i].pid AS pid FROM (SELECT id, people, unnest(range(1, len(people) + 1)) AS i FROM {p}) WHERE people[i].name <> ''"
    out["metadata_values"] = "SELECT snapshot_id, count(*) AS entries, max(CASE WHEN key = 'records' THEN try_cast(value AS BIGINT) END) AS records FROM (SELECT DISTINCT * FROM metadata) GROUP BY snapshot_id"
    out["venue_aliases"] = aliases()
    out["bibtex_escape"] = f"SELECT id, {escaped('title')} AS title FROM {p}"
    out["etl_publications"] = (
        f"WITH {ETL} SELECT ordinal AS id, key AS dblp_key, title, array_to_string(list_transform(people, lambda p: p.text), ', ') AS authors, "
        f"CASE WHEN regexp_full_match({raw('year')}, '[0-9]{{4}}') THEN {raw('year')}::INT END AS year, "
        "CASE WHEN searchable <> '' THEN searchable WHEN school <> '' THEN school WHEN tag = 'data' THEN stand_in ELSE '' END AS venue, "
        f"coalesce(list_filter({raw_all('ee')}, lambda x: contains(x.text, 'doi.org/'))[1].text, '') AS doi, ee, mdate FROM s"
    )
    out["etl_venue_aliases"] = aliases(f"WITH {ETL}, src AS (SELECT ordinal AS id, searchable AS venue FROM s),", "src", "venue_aliases")
    out["etl_bibtex"] = entry_sql()
    out["duplicate_keys"] = "SELECT key AS dblp_key, count(*) AS n FROM bib_raw GROUP BY key HAVING count(*) > 1"
    changed = "FROM diff JOIN steps USING (pos) WHERE pos > 1"
    out["p6_found"] = f"WITH {SNAPSHOTS} SELECT entity, item_key, snapshot_id, change {changed}"
    out["p6_fields"] = f"WITH {SNAPSHOTS} SELECT item_key, snapshot_id, fields {changed} AND change = 'changed' AND entity = 'publications'"
    return out
