"""Queries over the whole tables for every operator of the core."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark.engine import Engine
from bibspark.functions import bibtex, records, text, venues
from bibspark.operators import complete, etl, grouping, index, lookup, nested, search, snapshot_diff
from bibspark.plans.query import plan
from bibspark.runtime import cut, ensure_checkpoint_dir, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

# The requests the search queries run.
TEXT = "lessons from tra"
BROAD = "evidence from"
VENUE = "ICDX"
AUTHOR = "wag"
SUGGEST = "jov"
MISTYPED = "comparng approximte ledger"
KEYS = 25


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _pubs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "publications")


def _authors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "publication_authors")


def _engine(spark: SparkSession, d: str) -> Engine:
    return Engine.over(_pubs(spark, d), _authors(spark, d), table(spark, d, "links"))


_BUILT: dict[tuple[str, str], str] = {}


def _built(spark: SparkSession, d: str) -> Engine:
    """Over an index built from the tables, once per application, in the shared folder for intermediate data."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        target = f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
        index.write_index(_pubs(spark, d), _authors(spark, d), target)
        _BUILT[key] = target
    return Engine.at(spark, _BUILT[key], table(spark, d, "links"))


def _found(spark: SparkSession, d: str, **request) -> DataFrame:
    e = _engine(spark, d)
    return e.matches(plan(**request))


# -- nested records and snapshots (problems 3 and 6) ---------------------------


@query
def p3_found(spark, d):
    return nested.nested_people(_pubs(spark, d), table(spark, d, "bib_raw"))


def _tree(spark, d):
    return nested.deliveries(table(spark, d, "bib_raw").select("ordinal", "key", "mdate", "payload"), _pubs(spark, d).select("id", "dblp_key"))


@query
def p3_people(spark, d):
    return nested.people_of_payload(_tree(spark, d)).select("publication_id", "person_no", "name", "pid", "pre", "post")


@query
def p3_affiliations(spark, d):
    return nested.affiliations_of_payload(_tree(spark, d))


@query
def p3_venues(spark, d):
    return nested.venues_of_payload(_tree(spark, d))


@query
def p3_volumes(spark, d):
    return nested.volumes_of_payload(_tree(spark, d))


@query
def p3_linked(spark, d):
    """Affiliations tied to their person by interval containment of two node tables."""
    nodes = nested.node_table(_tree(spark, d), "nodes", "publication_id")
    people = nodes.filter((F.col("path") == nested.PERSON) & (F.col("kind") != "null"))
    affiliations = nodes.filter((F.col("path") == nested.AFFILIATION) & (F.col("kind") != "null"))
    return nested.link(people, affiliations, "publication_id").select("publication_id", "parent_pre", "pre", "post")


@query
def p6_found(spark, d):
    changes = snapshot_diff.snapshot_changes(table(spark, d, "publication_snapshots"), table(spark, d, "metadata"))
    return changes.select("entity", "item_key", "snapshot_id", "change")


@query
def p6_fields(spark, d):
    changes = snapshot_diff.snapshot_changes(table(spark, d, "publication_snapshots"), table(spark, d, "metadata"))
    return changes.filter("change = 'changed' AND entity = 'publications'").select("item_key", "snapshot_id", F.array_join("fields", ",").alias("fields"))


# -- search ---------------------------------------------------------------------


@query
def bm25_relevance(spark, d):
    spec = plan(q=TEXT)
    return search.page(_found(spark, d, q=TEXT), spec).select("id", F.round("score", 6).alias("score"))


@query
def built_bm25_relevance(spark, d):
    """The same over a built index."""
    spec = plan(q=TEXT)
    return search.page(_built(spark, d).matches(spec), spec).select("id", F.round("score", 6).alias("score"))


@query
def built_venue_or_alias(spark, d):
    return _built(spark, d).matches(plan(venue=VENUE)).select("id", "venue", F.round("score", 6).alias("score"))


@query
def built_autocomplete_title(spark, d):
    return _built(spark, d).autocomplete("lower bounds for spa", "title", 25)


@query
def built_autocomplete_author(spark, d):
    return _built(spark, d).autocomplete(SUGGEST, "author", 25)


@query
def built_hit_versions(spark, d):
    """The works of a page of hits, from the stored identities and titles."""
    e, spec = _built(spark, d), plan(q=TEXT, limit=300)
    hits = search.page(e.matches(spec), spec).limit(spec.limit)
    hits = cut(hits.select("id", (F.row_number().over(Window.orderBy("score", "id")) - 1).alias("hit_rank")))
    return grouping.group_hits(hits, e.works).select("hit_rank", "group_key", "best_id", "version_count")


@query
def bm25_all_scores(spark, d):
    return _found(spark, d, q=BROAD).select("id", F.round("score", 6).alias("score"))


@query
def fts_and_prefix(spark, d):
    return _found(spark, d, q=TEXT).select("id", "dblp_key", "title")


@query
def venue_or_alias(spark, d):
    return _found(spark, d, venue=VENUE).select("id", "venue", F.round("score", 6).alias("score"))


@query
def author_prefix_semi(spark, d):
    return _found(spark, d, author=AUTHOR).select("id", "authors")


@query
def author_exact_semi(spark, d):
    return _found(spark, d, author="Heliograph Survey Collaboration", author_exact=True).select("id")


@query
def year_range(spark, d):
    return _found(spark, d, year_from=2001, year_to=2010).select("id", "year")


@query
def type_filter(spark, d):
    return _found(spark, d, record_type="inproceedings").select("id", "record_type")


def _category(kind: str) -> None:
    def run(spark, d):
        return _found(spark, d, category=kind).select("id", "record_type", "venue")

    run.__name__ = f"category_{kind}"
    query(run)


for _kind in records.CATEGORIES:
    _category(_kind)


@query
def category_set(spark, d):
    return _found(spark, d, category="journal, artifact").select("id")


@query
def sort_year_desc_page(spark, d):
    spec = plan(q=BROAD, sort="year_desc", limit=20, offset=20)
    return search.page(_found(spark, d, q=BROAD, sort="year_desc"), spec).select("id", "year")


@query
def sort_year_asc_page(spark, d):
    spec = plan(q=BROAD, sort="year_asc", limit=20)
    return search.page(_found(spark, d, q=BROAD, sort="year_asc"), spec).select("id", "year")


@query
def author_page(spark, d):
    spec = plan(author=AUTHOR, limit=300)
    return search.page(_found(spark, d, author=AUTHOR), spec).select("id", "year")


@query
def search_combined(spark, d):
    request = {"q": "lessons", "author": "heliograph", "year_from": 1990, "category": "journal,conference"}
    return _found(spark, d, **request).select("id", F.round("score", 6).alias("score"))


@query
def facet_counts(spark, d):
    return search.facet_counts(_found(spark, d, q=BROAD))


@query
def reference_type(spark, d):
    return search.labelled(_pubs(spark, d)).select("id", "url", "reference_type")


@query
def filter_class(spark, d):
    return _pubs(spark, d).select("id", records.filter_class(F.col("record_type"), F.col("venue"), F.col("dblp_key")).alias("category"))


@query
def display_labels(spark, d):
    return _pubs(spark, d).select("id", records.display_title(F.col("title")).alias("title"), records.display_venue(F.col("venue")).alias("venue"))


# -- works ------------------------------------------------------------------------


@query
def author_identity(spark, d):
    return _pubs(spark, d).select("id", F.array_join(text.author_identity(F.col("authors"), F.col("dblp_key")), "|").alias("identity"))


@query
def normalized_title(spark, d):
    return _pubs(spark, d).select("id", text.normalized_title(F.col("title")).alias("norm_title"))


@query
def exact_works(spark, d):
    return grouping.exact_works(_pubs(spark, d)).select("group_key", "best_id", "versions")


@query
def version_rank_best(spark, d):
    """The preferred version of each identity's records."""
    r = grouping.resolved(_pubs(spark, d)).filter("authored")
    return r.groupBy(F.array_join("identity", "|").alias("identity")).agg(F.min_by("id", "rank").alias("best_id"), F.count("*").alias("n"))


@query
def near_title_pairs(spark, d):
    return grouping.near_title_pairs(_pubs(spark, d)).select("id_a", "id_b")


@query
def fuzzy_title_links(spark, d):
    """Pairs left by the gates whose exact ratio is high enough."""
    pairs = grouping.near_title_pairs(_pubs(spark, d))
    same = F.pandas_udf(lambda a, b: a.combine(b, grouping.same_work_title), "boolean")
    return pairs.filter(same("ta", "tb")).select("id_a", "id_b")


def _ranked_hits(spark, d, **request):
    spec = plan(**request)
    hits = search.page(_found(spark, d, **request), spec).limit(spec.limit)
    return hits.select("id", (F.row_number().over(Window.orderBy(*search.order_of(spec))) - 1).alias("hit_rank")) if not spec.phrases else hits.select(
        "id", (F.row_number().over(Window.orderBy("score", "id")) - 1).alias("hit_rank")
    )


@query
def hit_versions(spark, d):
    """The works of a page of hits; versions come from the whole corpus."""
    hits = cut(_ranked_hits(spark, d, q=TEXT, limit=300))
    g = grouping.group_hits(hits, _pubs(spark, d))
    return g.select("hit_rank", "group_key", "best_id", "version_count")


@query
def linked_works(spark, d):
    """The same with explicit links between records."""
    hits = cut(_ranked_hits(spark, d, author=AUTHOR, limit=300))
    g = grouping.group_hits(hits, _pubs(spark, d), table(spark, d, "links"))
    return g.select("hit_rank", "group_key", "best_id", "version_count")


# -- index tables -------------------------------------------------------------------


@query
def author_names_agg(spark, d):
    return index.author_names(_authors(spark, d))


@query
def author_folded(spark, d):
    return index.author_folded(index.author_names(_authors(spark, d)))


@query
def author_suffixes(spark, d):
    return index.author_suffixes(index.author_names(_authors(spark, d)))


@query
def author_rows(spark, d):
    return etl.publication_authors(_pubs(spark, d)).select("publication_id", "name", "pid")


@query
def incremental_author_merge(spark, d):
    """Counts of the records before the artifacts, merged with the artifacts' author rows."""
    kinds = _pubs(spark, d).select(F.col("id").alias("publication_id"), "record_type")
    rows = _authors(spark, d).join(kinds, "publication_id")
    return index.merge_author_names(index.author_names(rows.filter("record_type <> 'data'")), rows.filter("record_type = 'data'"))


@query
def insert_or_ignore(spark, d):
    """Keys of the publications and of deliveries without one."""
    old = _pubs(spark, d).select("dblp_key", F.lit("old").alias("origin"))
    new = table(spark, d, "bib_raw").select(F.col("key").alias("dblp_key"), F.lit("new").alias("origin"))
    return etl.insert_or_ignore(old, new)


@query
def postings_by_column(spark, d):
    p = index.postings(_pubs(spark, d))
    return p.groupBy("col").agg(F.count("*").alias("tokens"), F.count_distinct("term").alias("terms"), F.max("pos").alias("last_pos"))


@query
def term_frequencies(spark, d):
    p = index.postings(_pubs(spark, d))
    return p.groupBy("term").agg(F.count("*").alias("tokens"), F.count_distinct("id").alias("n_docs"))


@query
def doc_lengths(spark, d):
    return index.doc_stats(_pubs(spark, d))


@query
def corpus_stats(spark, d):
    return index.corpus_stats(index.doc_stats(_pubs(spark, d))).select("n_docs", F.round("avgdl", 9).alias("avgdl"))


@query
def title_grams(spark, d):
    return index.title_grams(_pubs(spark, d)).groupBy("gram").agg(F.count("*").alias("n"))


# -- suggestions and lookups -----------------------------------------------------------


@query
def autocomplete_author(spark, d):
    return _engine(spark, d).autocomplete(SUGGEST, "author", 25)


@query
def autocomplete_title(spark, d):
    return _engine(spark, d).autocomplete("lower bounds for spa", "title", 25)


@query
def closest_candidates(spark, d):
    return complete.closest_candidates(index.postings(_pubs(spark, d)), MISTYPED)


@query
def closest_ranked(spark, d):
    e = _engine(spark, d)
    return complete.closest(e.publications, e.postings, MISTYPED, 10)


def _keys(spark, d):
    """A cart: keys of linked records, in order, one of them unknown."""
    linked = table(spark, d, "links").select(F.col("key").alias("dblp_key")).distinct().orderBy("dblp_key").limit(KEYS)
    keys = ["x/unknown"] + [r["dblp_key"] for r in linked.collect()]
    return lookup.key_table(_pubs(spark, d), keys)


@query
def key_lookup_missing(spark, d):
    return lookup.records(_pubs(spark, d), _keys(spark, d)).select("ord", "dblp_key", "found", "title", "url", "reference_type")


@query
def bibliography(spark, d):
    return lookup.bibliography(_pubs(spark, d), _keys(spark, d))


@query
def record_people(spark, d):
    """All people of all records in order, as record lookups give them."""
    rows = _pubs(spark, d).select("id", F.posexplode("people").alias("position", "p"))
    return rows.select("id", "position", "p.name", "p.pid").filter("name <> ''")


@query
def metadata_values(spark, d):
    m = table(spark, d, "metadata").distinct()
    return m.groupBy("snapshot_id").agg(F.count("*").alias("entries"), F.max(F.when(F.col("key") == "records", F.col("value").try_cast("long"))).alias("records"))


# -- record derivation --------------------------------------------------------------------


@query
def venue_aliases(spark, d):
    return _pubs(spark, d).select("id", venues.aliases(F.col("venue")).alias("aliases"))


@query
def bibtex_escape(spark, d):
    return _pubs(spark, d).select("id", bibtex.escape(F.col("title")).alias("title"))


@query
def etl_publications(spark, d):
    raw = table(spark, d, "bib_raw")
    return etl.publications(raw).select("id", "dblp_key", "title", "authors", "year", "venue", "doi", "ee", "mdate")


@query
def etl_venue_aliases(spark, d):
    return etl.publications(table(spark, d, "bib_raw")).select("id", "venue_aliases")


@query
def etl_bibtex(spark, d):
    return etl.publications(table(spark, d, "bib_raw")).select("id", "bibtex")


@query
def duplicate_keys(spark, d):
    raw = table(spark, d, "bib_raw").select(F.col("key").alias("dblp_key"))
    return etl.duplicate_keys(raw)


# ------------------------------------------------------------------------------------------


def oracle_sql() -> dict[str, str]:
    from bibspark.queries import oracle

    return oracle.oracle_sql()


