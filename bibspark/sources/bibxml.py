"""A Python data source for XML dumps of publication records.

    spark.dataSource.register(BibXmlSource)
    spark.read.format("bibxml").option("path", "dump.xml.gz").load()

One partition per file: a gzip stream cannot be split. Ordinals follow the
order of records in their file, with the file's place among the files read in
the bits above, so they are unique over all files and keep the order of both. Rows
leave the reader as Arrow batches of a bounded size while the file is still being
parsed; the parse tree is cleared after every record, so memory does not grow
with the file. Executors open the path themselves: on a cluster it lies on a
file system all of them mount.
"""

from __future__ import annotations

import glob
import gzip
import html.entities
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The record kinds of a dump.
RECORD_TAGS = frozenset("article inproceedings proceedings book incollection phdthesis mastersthesis www data".split())
SCHEMA = "file string, ordinal long, tag string, key string, mdate string, fields map<string,array<struct<text:string,pid:string>>>"
ARROW = pa.schema([
    ("file", pa.string()), ("ordinal", pa.int64()), ("tag", pa.string()), ("key", pa.string()), ("mdate", pa.string()),
    ("fields", pa.map_(pa.string(), pa.list_(pa.struct([("text", pa.string()), ("pid", pa.string())])))),
])
HEADER = 4096
BLOCK = 1 << 18
BATCH = 2000
FILE_BITS = 40
_DOCTYPE = re.compile(rb"<!DOCTYPE\s+(\w+)\s+SYSTEM\s+(?:'[^']*\.dtd'|\"[^\"]*\.dtd\")\s*>")
_PREDEFINED = {"amp", "lt", "gt", "apos", "quot"}


def entity_subset(root: bytes) -> bytes:
    """An inline document type that declares the named characters dumps use, so nothing has to be fetched."""
    lines = []
    for name, text in sorted(html.entities.html5.items()):
        bare = name[:-1]
        if name.endswith(";") and bare.isalnum() and bare.isascii() and not bare[0].isdigit() and bare not in _PREDEFINED:
            lines.append(f'<!ENTITY {bare} "{"".join(f"&#{ord(c)};" for c in text)}">')
    return b"<!DOCTYPE " + root + b" [\n" + "\n".join(lines).encode("ascii") + b"\n]>"


def blocks(stream) -> Iterator[bytes]:
    """The stream's bytes in blocks, the external document type in its head exchanged for the inline one."""
    head = stream.read(HEADER)
    parts = _DOCTYPE.split(head, maxsplit=1)
    if len(parts) != 3:
        raise ValueError("the archive does not begin with the expected DOCTYPE")
    yield parts[0] + entity_subset(parts[1]) + parts[2]
    while block := stream.read(BLOCK):
        yield block


def element_text(element: ET.Element) -> str:
    """All text below an element, markup inside it dropped."""
    return "".join(element.itertext()).strip()


def parse(stream) -> Iterator[tuple]:
    """(ordinal, tag, key, mdate, fields) of every record that has a known tag and a key."""
    parser = ET.XMLPullParser(("start", "end"))
    root, ordinal = None, 0
    for block in chain(blocks(stream), [b""]):
        parser.feed(block) if block else parser.close()
        for event, element in parser.read_events():
            if root is None:
                root = element
            if event != "end" or element.tag not in RECORD_TAGS or not element.get("key"):
                continue
            ordinal += 1
            fields: dict[str, list[dict]] = {}
            for child in element:
                fields.setdefault(child.tag, []).append({"text": element_text(child), "pid": child.get("pid")})
            yield ordinal, element.tag, element.get("key"), element.get("mdate"), fields
            root.clear()


def open_archive(path: str):
    return gzip.open(path, "rb") if path.endswith(".gz") else open(path, "rb")


class FilePartition(InputPartition):
    def __init__(self, path: str, place: int):
        super().__init__(path)
        self.path, self.place = path, place


class BibXmlReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        files = sorted(glob.glob(self.path)) if glob.has_magic(self.path) else [self.path]
        if os.path.isdir(self.path):
            files = sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith((".xml", ".xml.gz")))
        if not files:
            raise FileNotFoundError(self.path)
        return [FilePartition(f, n) for n, f in enumerate(files)]

    def read(self, partition):
        first, held = partition.place << FILE_BITS, []
        with open_archive(partition.path) as stream:
            for ordinal, tag, key, mdate, fields in parse(stream):
                held.append((partition.path, first + ordinal, tag, key, mdate, list(fields.items())))
                if len(held) == BATCH:
                    yield self.batch(held)
                    held = []
        if held:
            yield self.batch(held)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), ARROW)], schema=ARROW)


class BibXmlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bibxml"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BibXmlReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("option path is missing")
        return BibXmlReader(path)
