"""Deeply nested records as flat tables tied together by interval labels.

A depth-first walk gives every node of a record a pre-order number on entry and
a post-order number on exit. Node b lies below node a exactly if
a.pre < b.pre and b.post < a.post, at whatever depth and through whatever
optional levels. Node tables of a type (a path of field names, arrays being
repetition of their field) are therefore linked by interval containment.

A record's nodes travel as one array in the record's own row, so labelling and
linking need no shuffle; only the choice of the delivery that counts does. The
linking is one pass over the nodes in pre-order with the intervals still open, so a
record takes time in proportion to its nodes however many of them are people.

Defined results: null, empty or cut-off text has no nodes; a leading byte-order
mark or blanks are ignored; text that is itself a JSON object or array is
walked as that object or array; nulls are nodes of kind null and count neither as
person nor as affiliation, nor does blank text; a name of braces only is a
person's name like any other. Repeated rows of a record repeat its nodes.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "array<struct<path:string,kind:string,value:string,pre:int,post:int,depth:int,owner:int,owner_no:int,no:int>>"
PERSON, AFFILIATION, VOLUME = "record.groups.members", "record.groups.members.affiliations", "record.venue.series.volumes"
ENTRY = "entry"

_ENTRY = re.compile(r"@\s*([A-Za-z]+)\s*([{(])")
_FIELD = re.compile(r"[\s,]*([A-Za-z][\w:.+/-]*)\s*=\s*")
_MARK = re.compile(r'\\[{}"]|[{}"]')
_NAME_MARK = re.compile(r"\\[{}]|[{}]|(?<!\S)(?i:and)(?!\S)")


class _Labels:
    def __init__(self) -> None:
        self.nodes: list[list] = []
        self.pre = self.post = 0

    def enter(self, path: str, kind: str, value: str | None, depth: int) -> list:
        self.pre += 1
        node = [path, kind, value, self.pre, 0, depth]
        self.nodes.append(node)
        return node

    def leave(self, node: list) -> None:
        self.post += 1
        node[4] = self.post

    def leaf(self, path: str, kind: str, value: str | None, depth: int) -> None:
        self.leave(self.enter(path, kind, value, depth))


def _embedded(value: str):
    """The object or array that a text holds as JSON of its own, else None."""
    bare = value.strip()
    if bare[:1] + bare[-1:] in ("{}", "[]") and len(bare) > 2:
        try:
            inner = json.loads(bare)
        except (ValueError, RecursionError):
            return None
        return inner if isinstance(inner, dict | list) else None
    return None


def json_nodes(text: str | None) -> list[list]:
    """Labelled nodes of a JSON text in pre-order; none if it is null or not whole.

    The walk keeps its own stack: nesting is limited by memory, not recursion."""
    if not text or not text.strip("\ufeff \t\r\n"):
        return []
    try:
        root = json.loads(text.strip("\ufeff \t\r\n"))
    except (ValueError, RecursionError):
        return []
    out = _Labels()
    stack: list[tuple] = [("visit", "", root, 0)]
    while stack:
        step, path, value, depth = stack.pop()
        if step == "leave":
            out.leave(value)
        elif isinstance(value, dict):
            node = out.enter(path, "object", None, depth)
            stack.append(("leave", path, node, depth))
            for name in reversed(value):
                stack.append(("visit", f"{path}.{name}" if path else name, value[name], depth + 1))
        elif isinstance(value, list):
            for item in reversed(value):
                stack.append(("visit", path, item, depth))
        elif value is None:
            out.leaf(path, "null", None, depth)
        elif isinstance(value, str):
            inner = _embedded(value)
            if inner is None:
                out.leaf(path, "text", value, depth)
            else:
                stack.append(("visit", path, inner, depth))
        else:
            out.leaf(path, "bool" if isinstance(value, bool) else "number", json.dumps(value), depth)
    return out.nodes


def _balanced(text: str, at: int, closing: str) -> int:
    """Where the value opened just before at ends; -1 if it never does."""
    depth = 0
    for mark in _MARK.finditer(text, at):
        sign = mark.group()
        if sign == "{":
            depth += 1
        elif depth == 0 and sign == closing:
            return mark.start()
        elif sign == "}":
            if depth == 0:
                return mark.start() if closing == "}" else -1
            depth -= 1
    return -1


def split_names(value: str) -> list[str]:
    """Names of a BibTeX name list: divided at the word and outside braces; others is no name."""
    names, depth, start = [], 0, 0
    for mark in _NAME_MARK.finditer(value):
        sign = mark.group()
        if sign == "{":
            depth += 1
        elif sign == "}":
            depth = max(0, depth - 1)
        elif sign[0] != "\\" and depth == 0:
            names.append(value[start : mark.start()])
            start = mark.end()
    names.append(value[start:])
    tidy = [" ".join(n.split()) for n in names]
    return [n for n in tidy if n and n.casefold() != "others"]


def _value(text: str, at: int) -> tuple[str, int]:
    """The value that starts at, pieces joined by #, and where it ends."""
    pieces, n = [], len(text)
    while at < n:
        while at < n and text[at].isspace():
            at += 1
        if at >= n:
            break
        if text[at] in '{"':
            end = _balanced(text, at + 1, "}" if text[at] == "{" else '"')
            if end < 0:
                return "".join(pieces) + text[at + 1 :], n
            pieces.append(text[at + 1 : end])
            at = end + 1
        else:
            bare = re.compile(r"[^\s,{}#\"()]+").match(text, at)
            if not bare:
                break
            pieces.append(bare.group())
            at = bare.end()
        more = re.compile(r"\s*#").match(text, at)
        if not more:
            break
        at = more.end()
    return "".join(pieces), at


def bibtex_nodes(text: str | None) -> list[list]:
    """Labelled nodes entry > field > person of BibTeX text, in pre-order.

    Entries are numbered as they stand; string, preamble and comment blocks are none."""
    if not text:
        return []
    out, at = _Labels(), 0
    while (head := _ENTRY.search(text, at)) is not None:
        kind, at = head.group(1).lower(), head.end()
        if kind in ("comment", "string", "preamble"):
            end = _balanced(text, at, "}") if head.group(2) == "{" else text.find(")", at)
            at = end + 1 if end >= 0 else at
            continue
        key = re.compile(r"\s*([^\s,{}=]*)\s*,?").match(text, at)
        at = key.end()
        node = out.enter("entry", kind, key.group(1), 0)
        while (field := _FIELD.match(text, at)) is not None:
            name = field.group(1).lower()
            value, at = _value(text, field.end())
            inner = out.enter(f"entry.{name}", "field", " ".join(value.split()), 1)
            if name in ("author", "editor"):
                for person in split_names(value):
                    out.leaf(f"entry.{name}.person", "text", person, 2)
            out.leave(inner)
        out.leave(node)
        close = re.compile(r"[\s,]*[})]").match(text, at)
        at = close.end() if close else at
    return out.nodes


def owned(nodes: list[list], tables: frozenset[str]) -> list[list]:
    """The nodes with the label of the nearest node around them that is a row of one of tables (0 if none), the number
    of that row in its own owner, and their own number among those of their type in theirs (0 if they hold nothing)."""
    around: list[tuple[int, int, int]] = []  # post, pre and number of the rows whose intervals are open
    counts: dict[tuple[int, str], int] = {}
    for node in nodes:
        path, kind, value, pre, post = node[:5]
        while around and around[-1][0] < post:
            around.pop()
        _, owner, owner_no = around[-1] if around else (0, 0, 0)
        number = 0
        if kind != "null" and (kind != "text" or value.strip()):
            number = counts[owner, path] = counts.get((owner, path), 0) + 1
        node += [owner, owner_no, number]
        if path in tables:
            around.append((post, pre, number))
    return nodes


def _nodes_udf(walk, tables: frozenset[str]):
    @F.pandas_udf(NODES)
    def run(texts: pd.Series) -> pd.Series:
        names = ("path", "kind", "value", "pre", "post", "depth", "owner", "owner_no", "no")
        return pd.Series([[dict(zip(names, n)) for n in owned(walk(t if isinstance(t, str) else None), tables)] for t in texts])

    return run


def json_tree(text: Column, tables: tuple[str, ...] = (PERSON, AFFILIATION, VOLUME)) -> Column:
    return _nodes_udf(json_nodes, frozenset(tables))(text)


def bibtex_tree(text: Column, tables: tuple[str, ...] = (ENTRY,)) -> Column:
    return _nodes_udf(bibtex_nodes, frozenset(tables))(text)


def of_type(nodes: Column, path: str) -> Column:
    """The nodes of one type that hold something, in document order."""
    return F.filter(nodes, lambda n: (n["path"] == path) & (n["no"] > 0))


def values_by_owner(nodes: Column, path: str, text_only: bool = False) -> Column:
    """Map from the label of a row to the first value of a type in it."""
    firsts = F.filter(nodes, lambda n: (n["path"] == path) & (n["no"] == 1) & ((n["kind"] == "text") if text_only else F.lit(True)))
    return F.map_from_entries(F.transform(firsts, lambda n: F.struct(n["owner"], n["value"])))


def node_table(df: DataFrame, nodes: str, *keep: str) -> DataFrame:
    """One row per node with its labels; keep names the columns that identify the record."""
    return df.select(*keep, F.explode(nodes).alias("__n")).select(*keep, "__n.path", "__n.kind", "__n.value", "__n.pre", "__n.post", "__n.depth")


def link(parents: DataFrame, children: DataFrame, *record: str) -> DataFrame:
    """children with parent_pre, by interval containment within the record; both are node tables.

    The equality on the record makes it a hash join; the interval only filters within one record."""
    p = parents.select(*record, F.col("pre").alias("parent_pre"), F.col("post").alias("__post"))
    return children.join(p, list(record)).filter("parent_pre < pre AND post < __post").drop("__post")


def latest_delivery(raw: DataFrame) -> DataFrame:
    """Per key the delivery with the latest mdate, then the highest ordinal; partial maxima before the shuffle."""
    row = F.struct(F.col("mdate"), F.col("ordinal"), F.col("payload"))
    return raw.filter("key IS NOT NULL").groupBy("key").agg(F.max(row).alias("__r")).select("key", "__r.mdate", "__r.ordinal", "__r.payload")


def deliveries(raw: DataFrame, publications: DataFrame) -> DataFrame:
    """publication_id and labelled nodes of the delivery that counts, for keys that have a publication."""
    ids = publications.select(F.col("id").alias("publication_id"), F.col("dblp_key").alias("key"))
    return latest_delivery(raw).join(ids, "key").select("publication_id", json_tree(F.col("payload")).alias("nodes"))


def people_of_bibtex(publications: DataFrame) -> DataFrame:
    """publication_id, entry_no, person_no, role, name: authors before editors in each entry."""
    tree = publications.filter("bibtex IS NOT NULL").select(F.col("id").alias("publication_id"), bibtex_tree(F.col("bibtex")).alias("nodes"))
    authors, editors = (of_type(F.col("nodes"), f"entry.{role}.person") for role in ("author", "editor"))
    # Editors go on from the number of authors of their entry, its last author's.
    counted = tree.select("publication_id", authors.alias("a"), editors.alias("e"))
    last = F.filter(F.col("a"), lambda n, i: (i == F.size("a") - 1) | (F.try_element_at(F.col("a"), i + 2)["owner"] != n["owner"]))
    counted = counted.select("publication_id", "a", "e", F.map_from_entries(F.transform(last, lambda n: F.struct(n["owner"], n["no"]))).alias("many"))
    row = lambda n, role, no: F.struct(n["owner_no"].alias("entry_no"), no.alias("person_no"), F.lit(role).alias("role"), n["value"].alias("name"))
    rows = F.concat(
        F.transform("a", lambda n: row(n, "author", n["no"])),
        F.transform("e", lambda n: row(n, "editor", n["no"] + F.coalesce(F.try_element_at(F.col("many"), n["owner"]), F.lit(0)))),
    )
    return counted.select("publication_id", F.inline(rows))


def people_of_payload(tree: DataFrame) -> DataFrame:
    """publication_id, person_no, name, pid and the node interval of each person of deliveries()."""
    nodes = F.col("nodes")
    inner = {"text": f"{PERSON}.name.text", "plain": f"{PERSON}.name", "pid": f"{PERSON}.name.pid"}
    found = tree.select("publication_id", of_type(nodes, PERSON).alias("people"), *[values_by_owner(nodes, path, name == "plain").alias(name) for name, path in inner.items()])
    of = lambda name, p: F.try_element_at(F.col(name), p["pre"])
    rows = F.transform("people", lambda p: F.struct(
        p["no"].alias("person_no"), F.when(p["kind"] == "text", p["value"]).otherwise(F.coalesce(of("text", p), of("plain", p))).alias("name"),
        of("pid", p).alias("pid"), p["pre"].alias("pre"), p["post"].alias("post"),
    ))
    return found.select("publication_id", F.inline(rows))


def affiliations_of_payload(tree: DataFrame) -> DataFrame:
    """publication_id, person_no, affiliation_no, org, from_year, unit; no row for a person without any."""
    nodes = F.col("nodes")
    inner = {"org": "org", "from": "from", "unit": "unit.name"}
    found = tree.select("publication_id", of_type(nodes, AFFILIATION).alias("all"), *[values_by_owner(nodes, f"{AFFILIATION}.{path}").alias(name) for name, path in inner.items()])
    of = lambda name, a: F.try_element_at(F.col(name), a["pre"])
    rows = F.transform("all", lambda a: F.struct(
        a["owner_no"].alias("person_no"), a["no"].alias("affiliation_no"), F.when(a["kind"] == "text", a["value"]).otherwise(of("org", a)).alias("org"),
        of("from", a).try_cast("int").alias("from_year"), of("unit", a).alias("unit"),
    ))
    return found.select("publication_id", F.inline(rows))


def venues_of_payload(tree: DataFrame) -> DataFrame:
    """publication_id, venue, series, volume: one row per delivery that names a venue, with its first volume; volumes_of_payload has all."""
    first = lambda path: F.try_element_at(of_type(F.col("nodes"), path), F.lit(1))["value"]
    plain = F.try_element_at(F.filter(of_type(F.col("nodes"), "record.venue"), lambda n: n["kind"] == "text"), F.lit(1))["value"]
    return tree.select(
        "publication_id",
        F.coalesce(plain, first("record.venue.name")).alias("venue"),
        first("record.venue.series.title").alias("series"),
        first(f"{VOLUME}.no").try_cast("int").alias("volume"),
    ).filter("venue IS NOT NULL OR series IS NOT NULL OR volume IS NOT NULL")


def volumes_of_payload(tree: DataFrame) -> DataFrame:
    """publication_id, volume_no (its number in the series), no: every volume, tied to its venue through the publication."""
    found = tree.select("publication_id", of_type(F.col("nodes"), VOLUME).alias("all"), values_by_owner(F.col("nodes"), f"{VOLUME}.no").alias("numbers"))
    rows = F.transform("all", lambda v: F.struct(v["no"].alias("volume_no"), F.try_element_at(F.col("numbers"), v["pre"]).alias("no")))
    return found.select("publication_id", F.inline(rows))


def nested_people(publications: DataFrame, raw: DataFrame) -> DataFrame:
    """source, publication_id, parent_no, child_no over both sources."""
    pubs = publications.select("id", "dblp_key", "bibtex")
    bib = people_of_bibtex(pubs).select(F.lit("bibtex").alias("source"), "publication_id", F.col("entry_no").alias("parent_no"), F.col("person_no").alias("child_no"))
    tree = deliveries(raw.select("ordinal", "key", "mdate", "payload"), pubs)
    both = tree.select(
        "publication_id",
        F.transform(of_type(F.col("nodes"), PERSON), lambda p: p["no"]).alias("people"),
        F.transform(of_type(F.col("nodes"), AFFILIATION), lambda a: F.struct(a["owner_no"].alias("parent_no"), a["no"].alias("child_no"))).alias("affiliations"),
    )
    without = F.array_except("people", F.transform("affiliations", lambda a: a["parent_no"]))
    rows = F.concat("affiliations", F.transform(without, lambda n: F.struct(n.alias("parent_no"), F.lit(0).alias("child_no"))))
    return bib.unionByName(both.select(F.lit("raw").alias("source"), "publication_id", F.inline(rows)))
