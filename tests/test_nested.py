import json

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibspark.operators import nested

trees = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab", max_size=3),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text("xyz", min_size=1, max_size=2), inner, max_size=3),
    max_leaves=20,
)


@given(trees)
def test_intervals_contain_exactly_the_descendants(tree):
    nodes = nested.json_nodes(json.dumps(tree))
    assert sorted(n[3] for n in nodes) == list(range(1, len(nodes) + 1)) == sorted(n[4] for n in nodes)
    for k, a in enumerate(nodes):
        below = []
        for b in nodes[k + 1 :]:  # in pre-order the descendants follow until the depth falls back
            if b[5] <= a[5]:
                break
            below.append(b)
        assert below == [b for b in nodes if b[3] > a[3] and b[4] < a[4]]


def test_json_oddities():
    assert nested.json_nodes(None) == nested.json_nodes("") == nested.json_nodes("  ") == []
    assert nested.json_nodes('{"a": [1, 2') == []
    assert nested.json_nodes('﻿  {"a": null}')[1][:3] == ["a", "null", None]
    inside = nested.json_nodes(json.dumps({"record": json.dumps({"k": [1]})}))
    assert [n[0] for n in inside] == ["", "record", "record.k"]
    assert nested.json_nodes("[" * 200_000) == []
    assert len(nested.json_nodes('{"a":' * 500 + "1" + "}" * 500)) == 501


def people(text):
    nodes = nested.bibtex_nodes(text)
    return [(n[0].split(".")[1], n[2]) for n in nodes if n[0].endswith(".person")]


def test_bibtex_styles():
    assert people('@article{k,\n author = "Ada {\\"o} Lo and Bea Ng",\n}') == [("author", 'Ada {\\"o} Lo'), ("author", "Bea Ng")]
    assert people("@BOOK(k, EDITOR = {A B and\n   {Works and Sons} and others}, author={C})") == [("editor", "A B"), ("editor", "{Works and Sons}"), ("author", "C")]
    assert people("@misc{k, note = {by {author = {Nobody and Noone}}}, author = {Ann} # { and } # {Bob}}") == [("author", "Ann"), ("author", "Bob")]
    assert people("@misc{k, title = {brother and sister}, author = {Anders Sand and Andy Brand}}") == [("author", "Anders Sand"), ("author", "Andy Brand")]
    assert people("@misc{k, author = {Ann and Bob") == [("author", "Ann"), ("author", "Bob")]
    assert people(None) == people("") == people("no entry") == people("@comment{ @misc{x, author={A}} }") == []
    many = nested.bibtex_nodes("@string{a = {x}}\n@a{k, author={P},}\n\n@b{l, editor={Q}}")
    assert [n[2] for n in many if n[0] == "entry"] == ["k", "l"]


RAW = "ordinal long, tag string, key string, mdate string, fields map<string,array<struct<text:string,pid:string>>>, payload string, id long"
PUBS = "id long, dblp_key string, bibtex string, key string"


def payload(members, groups_as_list=True, extra=None):
    group = {"role": "author", "members": members}
    return json.dumps({"record": {"groups": [group] if groups_as_list else group, "venue": {"name": "V", "series": {"title": "S", "volumes": [{"no": 3}]}}} | (extra or {})})


def test_people_and_affiliations(spark):
    members = [{"name": "A", "affiliations": ["X", {"org": "Y", "from": 2001}, None]}, {"name": {"text": "B", "pid": "1"}, "affiliations": None}, "C"]
    raw = spark.createDataFrame(
        [
            (1, "t", "k1", "2020-01-01", None, payload([{"name": "Old"}]), 0),
            (2, "t", "k1", "2021-01-01", None, payload(members, extra={"cites": [{"members": ["no person"]}]}), 0),
            (3, "t", "k1", "2021-01-01", None, None, 0),
            (4, "t", "k2", None, None, payload({"name": "D", "affiliations": {"org": "Z"}}, False), 0),
            (5, "t", "k9", "2022-01-01", None, payload([{"name": "E"}]), 0),
            (6, "t", None, "2022-01-01", None, payload([{"name": "F"}]), 0),
        ],
        RAW,
    )
    pubs = spark.createDataFrame([(10, "k1", None, "clash"), (20, "k2", "@m{x, author={Q and R}}", "clash"), (30, "k3", "", None)], PUBS)
    rows = sorted(tuple(r) for r in nested.nested_people(pubs, raw).collect())
    # The latest delivery of k1 is null (equal dates: the higher ordinal), so k1 has none.
    assert rows == [("bibtex", 20, 1, 1), ("bibtex", 20, 1, 2), ("raw", 20, 1, 1)]
    rows = sorted(tuple(r) for r in nested.nested_people(pubs, raw.filter("ordinal <> 3")).collect())
    assert [r[2:] for r in rows if r[1] == 10] == [(1, 1), (1, 2), (2, 0), (3, 0)]
    tree = nested.deliveries(raw.filter("ordinal <> 3"), pubs)
    assert sorted(tuple(r) for r in nested.affiliations_of_payload(tree).filter("publication_id = 10").collect()) == [(10, 1, 1, "X", None, None), (10, 1, 2, "Y", 2001, None)]
    assert [tuple(r) for r in nested.venues_of_payload(tree).filter("publication_id = 10").collect()] == [(10, "V", "S", 3)]
    assert [tuple(r)[2:4] for r in nested.people_of_payload(tree).filter("publication_id = 10").orderBy("person_no").collect()] == [("A", None), ("B", "1"), ("C", None)]
    linked = nested.link(*[nested.node_table(tree, "nodes", "publication_id").filter((F.col("path") == p) & (F.col("kind") != "null")) for p in (nested.PERSON, nested.AFFILIATION)], "publication_id")
    assert linked.count() == 3
    assert nested.nested_people(pubs.limit(0), raw.limit(0)).count() == 0
