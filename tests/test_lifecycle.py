import gzip
import hashlib
import io
import json
import time
from datetime import UTC, datetime

import pytest

from pyspark.sql import functions as F

from bibspark import refresh, rules
from bibspark.__main__ import main
from bibspark.engine import Engine
from bibspark.functions import records
from bibspark.operators import complete, etl, index
from bibspark.sources.bibxml import parse
from bibspark.streaming import landing

HEAD = b'<?xml version="1.0" encoding="ISO-8859-1"?>\n<!DOCTYPE bib SYSTEM "bib.dtd">\n<bib>\n'
BODY = """<article key="journals/x/1" mdate="2020-01-02"><author pid="9/1">M&auml;rta Lo 0001</author><author>Bea Ng</author><title>On <i>H</i><sub>2</sub>O &amp; ice.</title>
<journal>ACM Comput. Surv.</journal><year>1999</year><ee>https://x.example/1</ee><ee>https://doi.org/10.1/a_b</ee><doi>10.9/own</doi><pages>1-2</pages></article>
<proceedings key="conf/p/1"><editor>Cy Dee</editor><title>Proc. of Odd Things</title><year>99</year></proceedings>
<phdthesis key="phd/1"><author>Cy Dee</author><author></author><title>Thesis</title><school>Tarn College</school><year>2001</year></phdthesis>
<data key="data/1"><title>Numbers</title><series>Openshelf</series></data>
<data key="data/2"><title>More</title></data>
<inproceedings key="conf/i/1"><author>Bea Ng</author><title>Both</title><booktitle></booktitle><journal>Ignored</journal></inproceedings>
<www key=""><title>no key</title></www><note key="n/1"><title>unknown tag</title></note>
</bib>"""
XML = HEAD + BODY.encode("latin-1")


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "bib.xml.gz"
    path.write_bytes(gzip.compress(XML, mtime=0))
    return path


def test_source(spark, archive):
    rows = refresh.read_archive(spark, archive).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["tag"], r["key"]) for r in rows] == [
        (1, "article", "journals/x/1"), (2, "proceedings", "conf/p/1"), (3, "phdthesis", "phd/1"), (4, "data", "data/1"), (5, "data", "data/2"), (6, "inproceedings", "conf/i/1"),
    ]
    assert rows[0]["fields"]["title"][0]["text"] == "On H2O & ice." and rows[0]["fields"]["author"][0].asDict() == {"text": "Märta Lo 0001", "pid": "9/1"}
    assert refresh.read_archive(spark, archive, limit=2).count() == 2
    with pytest.raises(ValueError):
        list(parse(io.BytesIO(b"<bib></bib>")))


def test_etl(spark, archive):
    rows = {r["dblp_key"]: r for r in etl.publications(refresh.read_archive(spark, archive)).collect()}
    a = rows["journals/x/1"]
    assert (a["authors"], a["year"], a["venue"], a["ee"], a["doi"]) == ("Märta Lo 0001, Bea Ng", 1999, "ACM Comput. Surv.", "https://x.example/1", "https://doi.org/10.1/a_b")
    assert "CSUR" in a["venue_aliases"].split()
    assert a["bibtex"] == (
        "@article{DBLP:journals/x/1,\n  author = {Märta Lo and Bea Ng},\n  title = {On H2O \\& ice.},\n  journal = {ACM Comput. Surv.},\n"
        "  pages = {1-2},\n  year = {1999},\n  doi = {10.9/own},\n  url = {https://x.example/1},\n}\n"
    )
    assert (rows["conf/p/1"]["venue"], rows["conf/p/1"]["year"]) == ("Proc. of Odd Things", None) and rows["conf/p/1"]["venue_aliases"]
    assert (rows["phd/1"]["venue"], rows["phd/1"]["venue_aliases"]) == ("Tarn College", "")
    assert rows["data/1"]["venue"] == "Openshelf" and rows["data/2"]["venue"] == "Data artifact"
    assert rows["conf/i/1"]["venue"] == ""  # a present but empty booktitle wins over the journal
    names = etl.publication_authors(etl.publications(refresh.read_archive(spark, archive))).collect()
    assert sorted(r["name_norm"] for r in names) == ["bea ng", "bea ng", "cy dee", "cy dee", "märta lo 0001"]


class Reply(io.BytesIO):
    def __init__(self, data, length=None):
        super().__init__(data)
        self.headers = {} if length is None else {"Content-Length": str(length)}


def test_refresh_cycle(spark, archive, tmp_path):
    data, root, state_path, state = archive.read_bytes(), tmp_path / "index", tmp_path / "state.json", {}
    go = lambda body, length=None, least=10: refresh.refresh(spark, state, root, state_path, "https://x.example/{year}/{date}.gz", UTC, least, lambda *a, **k: Reply(body, length))
    assert not go(b"no gzip") and state["phase"] == "error" and state["retry_at"] and refresh.current_version(root) is None
    assert go(data) and state["phase"] == "idle" and state["last_error"] is None
    first = refresh.current_version(root)
    meta = refresh.read_metadata(root)
    assert meta["records"] == "6" and meta["source_sha256"] == hashlib.sha256(data).hexdigest()
    assert refresh.status(root, state_path)["ready"] and not list(root.glob("*.gz"))
    assert go(data) and refresh.current_version(root) == first  # unchanged archive: kept
    assert not go(data, len(data) + 1) and not go(data, least=10**6) and refresh.current_version(root) == first
    engine = Engine.open(spark, root)
    assert [r["dblp_key"] for r in engine.autocomplete("on h2").collect()] == ["journals/x/1"]
    assert engine.bibliography(["phd/1"])["missing"] == [] and engine.status(state_path)["ready"]
    # An index of the version before lacks the artifacts; the same archive then only adds them.
    old = refresh._fresh(root)
    raw = refresh.read_archive(spark, archive)
    refresh.build(spark, raw.filter("tag <> 'data'"), root, {"source_sha256": meta["source_sha256"]})
    refresh.save_state(refresh.read_metadata(root) | {"schema_version": "2"}, old / "metadata.json")
    kept = {f.name: f.read_bytes() for f in (old / "postings").glob("*.parquet")}
    assert go(data) and refresh.read_metadata(root)["records"] == "6" and refresh.read_metadata(root)["schema_version"] == "3"
    merged = Engine.open(spark, root)
    now = {f.name: f.read_bytes() for f in (refresh.current_version(root) / "postings").glob("*.parquet")}
    assert kept.items() < now.items(), "files of the version before stay as they are"
    fresh = Engine.over(merged.publications, merged.authors)
    for name in ("names", "suffixes", "folded", "corpus", "postings"):
        a, b = getattr(merged, name), getattr(fresh, name)
        assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect())), name
    assert merged.publications.count() == 6 and merged.publications.select("id").distinct().count() == 6
    with pytest.raises(ValueError):
        refresh.merge(spark, raw, root)
    with pytest.raises(ValueError):
        refresh.build(spark, raw.unionByName(raw), root)
    assert merged.publications.count() == 6 and not [p for p in root.iterdir() if p.is_dir() and not (p / "metadata.json").exists()]


def test_schedule_and_state(tmp_path):
    at = datetime(2026, 12, 31, 23, 5, tzinfo=UTC)
    assert refresh.next_slot(at, lambda n: n - 1) == datetime(2027, 1, 3, 3, 59, 59, tzinfo=UTC) and refresh.next_slot(at, lambda n: 0) == datetime(2027, 1, 1, 1, tzinfo=UTC)
    assert refresh.next_slot(datetime(2026, 1, 31, tzinfo=UTC), lambda n: 3 * 3600) == datetime(2026, 2, 2, 1, tzinfo=UTC)
    assert refresh.source_url("a/{year}/{month}/{date}", datetime(2026, 4, 9)) == "a/2026/04/2026-04-01"
    state = refresh.settled(datetime(2026, 12, 31, 23, tzinfo=UTC), UTC)
    assert state["last_success_month"] == "2026-12" and state["next_update_at"].startswith("2027-01-0")
    assert refresh.due_at({"next_update_at": "2026-01-01T00:00:00+00:00", "retry_at": "2026-01-02T00:00:00+00:00"}).day == 2
    broken = tmp_path / "state.json"
    broken.write_text("{")
    assert refresh.load_state(broken) == {} == refresh.load_state(tmp_path / "none.json")
    assert refresh.read_metadata(tmp_path) == {}


def test_rules(spark, tmp_path):
    good = tmp_path / "links.json"
    good.write_text(json.dumps({"groups": [{"keys": ["a", "b"], "note": "n"}, {"keys": ["c", "d", "e"]}]}))
    assert sorted(tuple(r) for r in rules.load_links(spark, good).collect()) == [("a", 1), ("b", 1), ("c", 2), ("d", 2), ("e", 2)]
    for bad in ([], {"groups": {}}, {"groups": [{"keys": ["a"]}]}, {"groups": [{"keys": ["a", "a"]}]}, {"groups": [{"keys": ["a", "b"]}, {"keys": ["b", "c"]}]}, {"groups": [{"keys": ["a", ""]}]}, {"groups": [{"keys": ["a", "b"], "note": 1}]}, {"groups": [], "x": 1}):
        with pytest.raises(ValueError):
            rules.checked_links(bad)
    for bad in ({}, {"venues": [], "key_prefixes": {}}, {"venues": {"": {"label": "x"}}, "key_prefixes": {}}, {"venues": {"v": {}}, "key_prefixes": {}}, {"venues": {"v": {"preprint": 1}}, "key_prefixes": {}}, {"venues": {"v": {"label": ""}}, "key_prefixes": {}}):
        with pytest.raises(ValueError):
            rules.checked_overrides(bad)


def test_rules_take_effect(spark, archive, tmp_path):
    file = tmp_path / "rules.json"
    file.write_text(json.dumps({"venues": {"ACM Comput. Surv.": {"label": "Surveys", "preprint": True}, "Openshelf": {"label": "OS"}}, "key_prefixes": {"phd/": {"label": "Theses"}}}))
    mine = rules.load_rules(file)
    pubs = etl.publications(refresh.read_archive(spark, archive))
    kinds = lambda r: {x["dblp_key"]: x["k"] for x in pubs.select("dblp_key", records.reference_type(F.col("record_type"), F.col("venue"), F.col("dblp_key"), r).alias("k")).collect()}
    assert kinds(records.STANDARD)["journals/x/1"] == "journal" and kinds(mine)["journals/x/1"] == "preprint" and kinds(mine)["phd/1"] == "monograph"
    shown = {x["dblp_key"]: x["v"] for x in pubs.select("dblp_key", records.display_venue(F.col("venue"), F.col("dblp_key"), mine).alias("v")).collect()}
    assert shown["journals/x/1"] == "Surveys" and shown["data/1"] == "OS" and shown["phd/1"] == "Theses" and shown["conf/p/1"] == "Proc. of Odd Things"
    engine = Engine.over(pubs, etl.publication_authors(pubs), rules=mine)
    assert [r["reference_type"] for r in engine.search(q="ice").hits.collect()] == ["preprint"] and engine.search(q="ice", category="informal").hits.count() == 1


def test_files_have_ids_of_their_own(spark, archive, tmp_path):
    for n, name in enumerate(("a.xml", "b.xml.gz")):
        text = XML.replace(b'key="', b'key="%d/' % n).replace(b'key="%d/"' % n, b'key=""').replace(b"Bea Ng", b"Bea Ng%d" % n)
        (tmp_path / name).write_bytes(gzip.compress(text) if name.endswith("gz") else text)
    raw = refresh.read_archive(spark, tmp_path)
    pubs = etl.publications(raw).cache()
    assert pubs.count() == 12 == pubs.select("id").distinct().count()
    assert [r["key"][0] for r in refresh.read_archive(spark, tmp_path, limit=8).orderBy("ordinal").collect()] == ["0"] * 6 + ["1"] * 2
    named = etl.publication_authors(pubs).join(pubs.selectExpr("id AS publication_id", "dblp_key"), "publication_id").filter("name LIKE 'Bea%'").collect()
    assert len(named) == 4 and all(r["dblp_key"][0] == r["name"][-1] for r in named)


def test_commands(spark, archive, tmp_path):
    root, out = tmp_path / "index", io.StringIO()
    assert main(["build", str(archive), "--root", str(root)], spark, out) == 0
    first = refresh.current_version(root)
    meta = refresh.read_metadata(root)
    assert meta["source"] == "bib.xml.gz" and meta["source_size"] == str(archive.stat().st_size) and meta["source_mtime_ns"] == str(archive.stat().st_mtime_ns)
    assert main(["build", str(archive), "--root", str(root)], spark, out) == 0 and refresh.current_version(root) == first  # same size and time: kept
    assert main(["build", str(archive), "--root", str(root), "--force"], spark, out) == 0 and refresh.current_version(root) != first
    out.truncate(0)
    assert main(["search", "--root", str(root), "--q", "ice"], spark, out) == 0 and '"journals/x/1"' in out.getvalue()
    assert main(["merge", str(archive), "--root", str(root)], spark, out) == 1 and main(["build", "--root", str(root)], spark, out) == 2
    assert main(["status", "--root", str(root)], spark, out) == 0 and {p.name for p in refresh.current_version(root).iterdir()} >= {"title_grams", "corpus_stats", "postings"}


def test_rounds_until_ready(spark, archive, tmp_path):
    naps, replies = [], iter([b"no gzip", archive.read_bytes()])
    rounds = refresh.Rounds(spark, tmp_path / "index", tmp_path / "state.json", "https://x.example/{date}", UTC, 10, lambda *a, **k: Reply(next(replies)))
    rounds.work(naps.append, rounds=2)
    assert naps == [refresh.RETRY_SECONDS] and rounds.state["phase"] == "idle" and refresh.current_version(tmp_path / "index")
    later = refresh.Rounds(spark, tmp_path / "index", tmp_path / "state.json", "https://x.example/{date}", UTC, 10, lambda *a, **k: Reply(archive.read_bytes()))
    later.state["next_update_at"] = "2020-01-01T00:00:00+00:00"
    refresh.save_state(later.state, tmp_path / "state.json")
    later.work(naps.append, rounds=1)
    assert len(naps) == 1 and refresh.due_at(later.state) > datetime.now(UTC)


def test_closest_without_cap(spark, archive):
    pubs = etl.publications(refresh.read_archive(spark, archive))
    posts = index.postings(pubs)
    assert complete.closest_candidates(posts, "on ice", cap=None).count() == 1 == complete.closest(pubs, posts, "on ice", cap=None).count()


def test_stream_takes_every_record_once(spark, archive, tmp_path):
    pubs = etl.publications(refresh.read_archive(spark, archive))
    drop, target, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    pubs.filter("id <= 3").coalesce(1).write.parquet(drop)
    for more in (None, pubs.filter("id >= 2")):
        if more is not None:
            time.sleep(0.01)
            more.coalesce(1).write.mode("append").parquet(drop)
        landing.ingest(spark, drop, pubs.schema, target, mark).awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(f"{target}/publications")
    assert sorted(r["dblp_key"] for r in got.select("dblp_key").collect()) == sorted(r["dblp_key"] for r in pubs.select("dblp_key").collect())
    names = spark.read.parquet(f"{target}/author_names/batch=1")
    assert {r["name_norm"]: r["publications"] for r in names.collect()}["cy dee"] == 2
