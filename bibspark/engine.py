"""The query surface: search, grouping, suggestions, closest titles, lookups.

    engine = Engine.open(spark, "/data/index")      # a built version
    engine = Engine.over(publications, authors)     # or tables as they are
"""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark.functions.records import STANDARD, Rules
from bibspark.operators import complete, grouping, index, lookup, search
from bibspark.plans.query import QuerySpec, checked_length, number, plan
from bibspark.refresh import current_version, status


@dataclass
class SearchPage:
    """One page: hits in order, works grouped from them, and where the next page starts."""

    hits: DataFrame
    groups: DataFrame
    has_more: bool
    next_offset: int | None


@dataclass
class Engine:
    publications: DataFrame
    authors: DataFrame
    postings: DataFrame
    corpus: DataFrame
    names: DataFrame
    folded: DataFrame
    suffixes: DataFrame
    works: DataFrame
    links: DataFrame | None = None
    root: Path | None = None
    rules: Rules = STANDARD

    @classmethod
    def open(cls, spark: SparkSession, root: str | Path, links: DataFrame | None = None, rules: Rules = STANDARD) -> Engine:
        version = current_version(Path(root))
        if version is None:
            raise FileNotFoundError(f"no index below {root}")
        return cls.at(spark, str(version), links, Path(root), rules)

    @classmethod
    def at(cls, spark: SparkSession, version: str, links: DataFrame | None = None, root: Path | None = None, rules: Rules = STANDARD) -> Engine:
        """Over the tables of one version's folder."""
        read = lambda name: spark.read.parquet(f"{version}/{name}")
        return cls(
            read("publications"), read("publication_authors"), read("postings"), read("corpus_stats"),
            read("author_names"), read("author_folded"), read("author_suffixes"), read("works"), links, root, rules,
        )

    @classmethod
    def over(cls, publications: DataFrame, authors: DataFrame, links: DataFrame | None = None, rules: Rules = STANDARD) -> Engine:
        names = index.author_names(authors)
        return cls(
            publications, authors, index.postings(publications), index.corpus_stats(index.doc_stats(publications)),
            names, index.author_folded(names), index.author_suffixes(names), grouping.works_table(publications), links, rules=rules,
        )

    def spec(self, q="", author="", venue="", year_from=None, year_to=None, type="", limit=None, offset=0, sort="relevance", category="", author_exact=False) -> QuerySpec:
        """A request's plan after the checks of the interface: lengths, ranges, categories."""
        for value, name in ((q, "q"), (author, "author"), (venue, "venue")):
            checked_length(value, name)
        size = number(limit, "limit", 1, 300) or (300 if author else 20)
        return plan(q, author, venue, number(year_from, "year_from", 0, 9999), number(year_to, "year_to", 0, 9999), type, size, number(offset, "offset", 0, 1_000_000) or 0, sort, category, author_exact)

    def matches(self, spec: QuerySpec) -> DataFrame:
        return search.matches(self.publications, self.postings, self.corpus, self.authors, self.suffixes, spec, self.rules)

    def search(self, **request) -> SearchPage:
        spec = self.spec(**request)
        rows = search.page(self.matches(spec), spec).collect()  # at most limit + 1 rows
        spark = self.publications.sparkSession
        schema = self.matches(spec).schema
        kept = rows[: spec.limit]
        hits = search.labelled(spark.createDataFrame(kept, schema), self.rules)
        ranks = spark.createDataFrame([(r["id"], k) for k, r in enumerate(kept)], "id long, hit_rank int")
        groups = self.groups(ranks)
        return SearchPage(hits, groups, len(rows) > spec.limit, None if spec.empty else spec.offset + len(kept))

    def groups(self, hits: DataFrame) -> DataFrame:
        """Works of hits(id, hit_rank) in the order of their first hit, with the preferred version's fields."""
        g = grouping.group_hits(hits, self.works, self.links, self.rules)
        best = search.labelled(self.publications.select("id", *search.FIELDS), self.rules)
        return g.join(best.withColumnRenamed("id", "best_id"), "best_id").orderBy("hit_rank")

    def autocomplete(self, q: str, kind: str = "title", limit: int | None = None) -> DataFrame:
        checked_length(q, "q")
        size = number(limit, "limit", 1, 25) or 10
        if kind == "author":
            return complete.suggest_authors(self.folded, self.suffixes, self.names, q, size)
        if kind != "title":
            raise ValueError("kind is title or author")
        return complete.suggest_titles(self.publications, self.postings, self.corpus, q, size)

    def closest(self, q: str, limit: int | None = None, exact: bool = False) -> DataFrame:
        """Closest titles, grouped into works; exact ranks all candidates, not the first 5,000."""
        checked_length(q, "q")
        found = complete.closest(self.publications, self.postings, q, number(limit, "limit", 1, 25) or 10, None if exact else 5000)
        order = Window.orderBy(F.desc("similarity"), "id")  # over a page of results
        return self.groups(found.select("id", (F.row_number().over(order) - 1).alias("hit_rank")))

    def record(self, key: str) -> dict | None:
        checked_length(key, "key")
        row = search.labelled(self.publications.filter(F.col("dblp_key") == key).select(*search.FIELDS), self.rules).first()
        if row is None:
            return None
        people = lookup.people(self.publications, key).orderBy("position").collect()
        return row.asDict() | {"people": [{"name": p["name"], "pid": p["pid"]} for p in people]}

    def records(self, keys: list[str]) -> dict:
        rows = lookup.records(self.publications, lookup.key_table(self.publications, lookup.validated_keys(keys))).orderBy("ord").collect()
        return {
            "records": [{k: v for k, v in r.asDict().items() if k not in ("ord", "found")} for r in rows if r["found"]],
            "missing": [r["dblp_key"] for r in rows if not r["found"]],
        }

    def bibliography(self, keys: list[str]) -> dict:
        rows = lookup.bibliography(self.publications, lookup.key_table(self.publications, lookup.validated_keys(keys))).orderBy("ord").collect()
        return {
            "entries": [{"key": r["key"], "bibtex": r["bibtex"]} for r in rows if r["bibtex"] is not None],
            "missing": [r["key"].removeprefix("DBLP:") for r in rows if r["bibtex"] is None],
        }

    def status(self, state_path: str | Path) -> dict:
        return status(self.root, Path(state_path)) if self.root else {"ready": True, "metadata": {}, "refresh": {}}
