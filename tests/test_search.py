import math
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from bibspark.engine import Engine
from bibspark.operators import etl, grouping
from bibspark.plans.query import SEARCH_WEIGHTS, plan

FIELDS = "id long, dblp_key string, record_type string, title string, people array<struct<name:string,pid:string>>, authors string, year int, venue string, venue_aliases string, doi string, ee string, mdate string, bibtex string"


def record(i, key, kind, title, names, year, venue, aliases="", doi=""):
    people = [(n, None) for n in names]
    return (i, key, kind, title, people, ", ".join(names), year, venue, aliases, doi, doi, "2020-01-01", f"@{kind}{{DBLP:{key},\n}}\n")


LONG = "A remarkably long title about counting sparrows in harbour towns"
ROWS = [
    record(1, "conf/a/Lo01", "inproceedings", "Sparse maps of rivers", ["Ada Lo", "Bea Ng"], 2001, "Intl. Conf. on Maps", "ICM"),
    record(2, "journals/a/Lo02", "article", "Sparse maps of rivers.", ["Bea Ng", "Ada Lo"], 2002, "J. Maps", "JM", "https://doi.org/10.1/x"),
    record(3, "journals/corr/Lo00", "article", "Sparse maps of rivers (extended abstract)", ["Ada Lo", "Bea Ng"], 2000, "CoRR"),
    record(4, "journals/a/Oz03", "article", "Sparse maps of rivers", ["Zoë Øz"], 2003, "J. Maps", "JM"),
    record(5, "books/b/X", "book", "Rivers", ["Ada Lo"], None, "", ""),
    record(6, "data/d/Y", "data", "River_data dump", [], 2010, "Data artifact"),
    record(7, "conf/o/Z", "inproceedings", "Open reviewing of maps", ["Märta Núñez 0002"], 2011, "openreview"),
    record(8, "journals/a/L1", "article", LONG, ["Cy Dee"], 2012, "J. Maps", "JM"),
    record(9, "journals/a/L2", "article", LONG.replace("sparrows", "sparows"), ["Cy Dee"], 2013, "J. Maps", "JM"),
    record(10, "www/h/1", "www", "", ["Cy Dee"], 2014, None),
    record(11, "journals/a/L3", "article", "Renamed work on something else entirely", ["Cy Dee"], 2014, "J. Maps", "JM"),
]


@pytest.fixture(scope="module")
def engine(spark):
    pubs = spark.createDataFrame(ROWS, FIELDS).cache()
    links = spark.createDataFrame([("journals/a/L3", 1), ("journals/a/L1", 1), ("journals/a/L3", 1)], "key string, group_id int")
    return Engine.over(pubs, etl.publication_authors(pubs).cache(), links)


def ids(engine, **request):
    spec = engine.spec(**request)
    return {r["id"] for r in engine.matches(spec).select("id").collect()}


def bm25(phrases):
    """The published formula over the fixture, in plain Python."""
    fold = lambda s: re.findall(r"[^\W_]+", (s or "").lower().replace("ö", "o").replace("ë", "e").replace("ä", "a").replace("ú", "u").replace("ñ", "n"))
    docs = {r[0]: [fold(r[3]), fold(r[5]), fold(r[7]), fold(r[8])] for r in ROWS}
    lengths = {i: sum(map(len, d)) for i, d in docs.items()}
    mean = sum(lengths.values()) / len(docs)
    total = dict.fromkeys(docs, 0.0)
    clauses = {i: set() for i in docs}
    for p in phrases:
        f = {}
        for i, d in docs.items():
            for c in p.columns:
                for at in range(len(d[c]) - len(p.tokens) + 1):
                    part = d[c][at : at + len(p.tokens)]
                    if part[:-1] == list(p.tokens[:-1]) and (part[-1].startswith(p.tokens[-1]) if p.prefix else part[-1] == p.tokens[-1]):
                        f[i] = f.get(i, 0) + SEARCH_WEIGHTS[c]
        idf = math.log((len(docs) - len(f) + 0.5) / (len(f) + 0.5)) if f else 0
        for i, w in f.items():
            total[i] -= max(idf, 1e-6) * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * lengths[i] / mean))
            clauses[i].add(p.clause)
    every = {p.clause for p in phrases}
    return {i: s for i, s in total.items() if clauses[i] == every}


@pytest.mark.parametrize("request_", [{"q": "sparse ma"}, {"q": "rivers lo"}, {"venue": "jm"}, {"q": "maps", "venue": "ICM"}, {"q": "river_da"}, {"q": "river_dump"}, {"q": "zoe"}])
def test_bm25(engine, request_):
    spec = plan(**request_)
    got = {r["id"]: r["score"] for r in engine.matches(spec).collect()}
    want = bm25(spec.phrases)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)


def test_filters(engine):
    assert ids(engine, q="!!!") == set() and ids(engine, q="_ maps") == set() and ids(engine) == set()
    assert ids(engine, author="ada") == {1, 2, 3, 5} and ids(engine, author="ng") == {1, 2, 3}
    assert ids(engine, author="nunez") == {7} and ids(engine, author="Núñez") == {7}
    assert ids(engine, author="ada lo", author_exact=True) == {1, 2, 3, 5} and ids(engine, author="lo", author_exact=True) == set()
    assert ids(engine, year_from=2011) == {7, 8, 9, 10, 11} and ids(engine, year_to=2000) == {3}
    assert ids(engine, type="book") == {5}
    assert ids(engine, category="informal") == {3} and ids(engine, category="conference") == {1, 7}
    assert ids(engine, category="journal,artifact") == {2, 4, 6, 8, 9, 11} and ids(engine, category="other") == {10}
    with pytest.raises(ValueError):
        engine.spec(category="poem")
    for bad in ({"limit": 0}, {"limit": 301}, {"limit": "x"}, {"year_from": -1}, {"offset": 1_000_001}, {"q": "x" * 201}):
        with pytest.raises(ValueError):
            engine.spec(**bad)
    assert engine.spec().limit == 20 and engine.spec(author="x").limit == 300


def test_labels_differ_from_filters(engine):
    page = engine.search(category="conference")
    kinds = {r["id"]: r["reference_type"] for r in page.hits.collect()}
    assert kinds == {1: "conference", 7: "preprint"}


def test_order_and_paging(engine):
    first = engine.search(author="ada", sort="year_asc", limit=2)
    assert [r["id"] for r in first.hits.collect()] == [5, 3] and first.has_more and first.next_offset == 2
    rest = engine.search(author="ada", sort="year_asc", limit=2, offset=2)
    assert [r["id"] for r in rest.hits.collect()] == [1, 2] and not rest.has_more and rest.next_offset == 4
    assert [r["id"] for r in engine.search(author="ada").hits.collect()] == [2, 1, 3, 5]
    assert "bibtex" not in first.hits.columns


def test_groups(engine):
    page = engine.search(category="conference", q="rivers")
    groups = page.groups.collect()
    assert [(g["version_count"], g["best_id"], g["group_key"], list(g["versions"])) for g in groups] == [(3, 2, "group:conf/a/Lo01", [2, 1, 3])]
    by_hit = {tuple(g["versions"]) for g in engine.search(author="cy dee").groups.collect()}
    # The link joins the renamed work, and the misspelled title of the linked one comes along.
    assert by_hit == {(11, 9, 8), (10,)}
    alone = engine.search(q="dump").groups.collect()
    assert [(g["best_id"], g["version_count"]) for g in alone] == [(6, 1)]
    assert {tuple(g["versions"]) for g in engine.search(q="sparse", type="article").groups.collect()} == {(2, 1, 3), (4,)}


def test_exact_works_and_gates(spark, engine):
    works = {r["group_key"]: r["versions"] for r in grouping.exact_works(engine.publications).collect()}
    assert works["group:conf/a/Lo01"] == 3 and works["group:journals/a/Oz03"] == 1 and len(works) == 9
    assert [tuple(r)[:2] for r in grouping.near_title_pairs(engine.publications).collect()] == [(8, 9)]
    for a, b in (("x" * 23, "x" * 22 + "y"), (LONG.lower(), LONG.lower().replace("sparrows", "sparows")), (LONG, LONG + " and more"), ("", "")):
        if grouping.same_work_title(a, b) and a != b:
            t = len(a) + len(b)
            assert SequenceMatcher(None, a, b).ratio() >= 0.97
            assert spark.range(1).select(F.levenshtein(F.lit(a), F.lit(b))).first()[0] <= math.floor(0.03 * t + 1e-9)


def test_suggestions(engine):
    assert [r["name"] for r in engine.autocomplete("ada", "author").collect()] == ["Ada Lo"]
    assert [tuple(r) for r in engine.autocomplete("d", "author").collect()] == [("Cy Dee", 4)]
    assert [r["name"] for r in engine.autocomplete("øz", "author").collect()] == ["Zoë Øz"]
    assert engine.autocomplete("  ", "author").count() == 0 == engine.autocomplete("..").count()
    assert [r["dblp_key"] for r in engine.autocomplete("sparse m").collect()][:2] == ["journals/a/Oz03", "journals/a/Lo02"]
    with pytest.raises(ValueError):
        engine.autocomplete("x", "venue")
    with pytest.raises(ValueError):
        engine.autocomplete("x", "title", 26)


def test_closest(engine):
    assert engine.closest("xy").count() == 0
    best = engine.closest("sprase maps of rivers").collect()
    assert best[0]["version_count"] == 3 and {g["best_id"] for g in best} == {2, 4}
    # One word has no counterpart: the search is relaxed by leaving out one word.
    assert engine.closest("rivers zzzz").collect()[0]["title"] == "Rivers"
    assert engine.closest("dump river_data").collect()[0]["best_id"] == 6


def test_lookups(engine):
    assert engine.record("nope") is None
    one = engine.record("conf/a/Lo01")
    assert [p["name"] for p in one["people"]] == ["Ada Lo", "Bea Ng"] and one["reference_type"] == "conference" and one["url"].endswith("/rec/conf/a/Lo01")
    got = engine.records(["books/b/X", "nope", "conf/a/Lo01"])
    assert [r["dblp_key"] for r in got["records"]] == ["books/b/X", "conf/a/Lo01"] and got["missing"] == ["nope"]
    bib = engine.bibliography(["nope", "books/b/X"])
    assert bib == {"entries": [{"key": "DBLP:books/b/X", "bibtex": "@book{DBLP:books/b/X,\n}\n"}], "missing": ["nope"]}
    for bad in ([], ["a", "a"], [""], ["x" * 301], "a", [1], [str(i) for i in range(1001)]):
        with pytest.raises(ValueError):
            engine.records(bad)
