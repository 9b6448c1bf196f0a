"""Evaluation passages found in training text.

The word n-grams of all test items, normalised, form one hash set that is
broadcast; every document's token windows are scanned against it, and each hit
is verified by the length of the longest common word sequence of item and
document. Words are compared after markup, quote marks, case, accents and
look-alike characters are evened out; a misspelled word counts as the test
vocabulary's word one edit away (symmetric-delete lookup).

An item is in a document if the document holds at least min_share of the
item's words in order, and the same share (less slack) of its telling words,
those few items have. The second condition keeps items apart that are built
on one pattern and share only its wording.

The item table is checked against max_index_words before it is broadcast;
beyond that the items are dealt into several indexes, one after the other, each a pass
over the documents whose result is written before the next is sent. What is shared
by all is the count of each word, a row per word. A worker builds an index once.

Documents that hold items can be dropped, or the passages cut out of them.
Defined results: null, empty and blank texts hold nothing; repeated documents are
answered like any other; items without words match nothing; equal item texts are each
reported; a document without a passage is handed on as it is, nulls included.
"""

from __future__ import annotations

import html
import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.skeleton import comparison_key
from bibspark.runtime import cut

GRAM = 3
MAX_INDEX_WORDS = 2_000_000

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|\[/?(?:quote|b|i|u|s|size|color|url|img|list|code|spoiler|font|center|left|right|\*)\b[^\[\]]*\]|\[\*\]", re.I)
_TOKEN = re.compile(r"\S+")
_QUOTE = re.compile(r"(?m)^[ \t]*(?:[>|»]+[ \t]*)+")
_BROKEN = regex.compile(r"(\p{L})[-\u00ad\u2010]\r?\n[ \t]*(?=\p{Ll})")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def plain_words(text: str) -> list[str]:
    """Words of a text without markup, entities and quote marks, in comparison form."""
    for _ in range(2):
        if "&" in text:
            text = html.unescape(text)
    if "<" in text or "[" in text:
        text = _TAG.sub(" ", text)
    if ">" in text or "|" in text or "»" in text:
        text = _QUOTE.sub("", text)
    if "-" in text or "\u00ad" in text:
        text = _BROKEN.sub(r"\1", text)
    return _WORD.findall(comparison_key(text))


def _deletes(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def common_length(masks: dict[str, int], size: int, words: list[str]) -> int:
    """Longest common subsequence of an item (given as bit masks of its words' places) and words."""
    rest = full = (1 << size) - 1
    for w in words:
        mask = masks.get(w)
        if mask:
            hit = rest & mask
            rest = ((rest + hit) | (rest - hit)) & full
    return size - rest.bit_count()


class Item:
    __slots__ = ("item_id", "size", "masks", "rare_size", "rare_masks")

    def __init__(self, item_id: int, words: list[str], rare: set[str]):
        self.item_id, self.size = item_id, len(words)
        self.masks = self._masks(words)
        telling = [w for w in words if w in rare]
        self.rare_size, self.rare_masks = len(telling), self._masks(telling)

    @staticmethod
    def _masks(words: list[str]) -> dict[str, int]:
        masks: dict[str, int] = defaultdict(int)
        for i, w in enumerate(words):
            masks[w] |= 1 << i
        return dict(masks)


class LeakIndex:
    def __init__(self, items: list[tuple[int, str]], gram: int = GRAM, min_share: float = 0.5, slack: float = 0.15, rare_share: float = 0.04, df: dict[str, int] | None = None, count: int = 0):
        # df, count: in how many items each word is and how many there are, where these items are a part of them.
        self.gram, self.min_share, self.slack = gram, min_share, slack
        split = [(i, w) for i, t in items if t and (w := plain_words(t))]
        if df is None:
            df, count = Counter(w for _, words in split for w in set(words)), len(split)
        most = max(2, math.ceil(rare_share * count))
        rare = {w for w, n in df.items() if n <= most}
        self.items = [Item(i, w, rare) for i, w in split]
        self.vocabulary = set(df)
        self.near: dict[str, str] = {}
        for w in sorted(df):
            if len(w) >= 5 and w.isalpha():
                for d in _deletes(w) | {w}:
                    self.near.setdefault(d, w)
        grams: dict[tuple, set[int]] = defaultdict(set)
        for at, (_, words) in enumerate(split):
            n = min(gram, len(words))
            for k in range(len(words) - n + 1):
                grams[tuple(words[k : k + n])].add(at)
        self.grams = dict(grams)
        self.short = min((len(k) for k in grams), default=gram)
        self.cache: dict[str, str] = {}

    def known(self, word: str) -> str:
        """The test vocabulary's spelling of word if it is at most one edit away."""
        if word in self.vocabulary or len(word) < 5 or not word.isalpha():
            return word
        found = self.cache.get(word)
        if found is None:
            found = self.near.get(word)
            if found is None:
                found = next((self.near[d] for d in sorted(_deletes(word)) if d in self.near and abs(len(self.near[d]) - len(word)) <= 1), word)
            if len(self.cache) < 1_000_000:
                self.cache[word] = found
        return found

    def passages(self, text: str) -> list[tuple[int, int]]:
        """Start and end in the text of what it holds of items: from the first to the last n-gram of each, and the item's words next to these."""
        tokens = [(m.start(), m.end(), w) for m in _TOKEN.finditer(text) for w in plain_words(m.group())]
        words = [self.known(w) for *_, w in tokens]
        spans = []
        for at, first, last, share, telling in self.found(words):
            if telling >= self.min_share - self.slack:
                own = self.items[at].masks
                while first and words[first - 1] in own:
                    first -= 1
                while last < len(words) and words[last] in own:
                    last += 1
                spans.append((tokens[first][0], tokens[last - 1][1]))
        return sorted(spans)

    def scores(self, text: str) -> list[tuple[int, float, float]]:
        """item_id, share of words and share of telling words, of every item with a hit."""
        return [(self.items[at].item_id, share, telling) for at, _, _, share, telling in self.found([self.known(w) for w in plain_words(text)])]

    def found(self, words: list[str]) -> list[tuple[int, int, int, float, float]]:
        """Item, where its first hit begins and its last one ends, share of its words and of its telling words, where the share is enough."""
        first: dict[int, int] = {}
        last: dict[int, int] = {}
        for n in range(self.short, self.gram + 1):
            for k in range(len(words) - n + 1):
                for at in self.grams.get(tuple(words[k : k + n]), ()):
                    first.setdefault(at, k)
                    last[at] = k + n
        out = []
        for at in sorted(first):
            item = self.items[at]
            # Only words near the hits count: scattered function words elsewhere are no passage.
            region = words[max(0, first[at] - item.size // 2) : last[at] + item.size // 2]
            share = common_length(item.masks, item.size, region) / item.size
            if share >= self.min_share:
                telling = common_length(item.rare_masks, item.rare_size, region) / item.rare_size if item.rare_size else share
                out.append((at, first[at], last[at], share, telling))
        return out

    def matches(self, text: str) -> list[tuple[int, float]]:
        return [(i, s) for i, s, t in self.scores(text) if t >= self.min_share - self.slack]


_BUILT: dict[str, LeakIndex] = {}


def built(name: str, rows: list[tuple[int, str]], min_share: float, counts: dict[str, int] | None) -> LeakIndex:
    """The index of a broadcast item table, built once in each worker; the one before it is let go."""
    if name not in _BUILT:
        _BUILT.clear()
        df = None if counts is None else {w: n for w, n in counts.items() if w}
        _BUILT[name] = LeakIndex(rows, min_share=min_share, df=df, count=0 if counts is None else counts[""])
    return _BUILT[name]


def item_texts(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")


def leaks(documents: DataFrame, items: DataFrame, min_share: float = 0.5, max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """item_id, doc_id, share: every document that holds an item, one narrow pass per index."""
    spark = documents.sparkSession
    test = item_texts(items)
    size = test.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // max_index_words))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")

    whole = None
    if parts > 1:  # words are telling, and spelled, by all items whatever the number of indexes

        def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                split = [set(w) for t in batch["text"] if t and (w := plain_words(t))]
                rows = [("", len(split)), *Counter(w for words in split for w in words).items()]
                yield pd.DataFrame(rows, columns=["word", "n"])

        counted = test.select("text").mapInPandas(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
        whole = spark.sparkContext.broadcast({r["word"]: r["n"] for r in counted})

    def scan(part: int) -> DataFrame:
        own = test if parts == 1 else test.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        rows = [(r["item_id"], r["text"]) for r in own.orderBy("item_id").collect()]  # at most max_index_words words
        shared, name = spark.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = built(name, shared.value, min_share, None if whole is None else whole.value)
            for batch in batches:
                found = [(i, d, s) for d, t in zip(batch["doc_id"], batch["text"]) for i, s in index.matches(t)]
                yield pd.DataFrame(found, columns=["item_id", "doc_id", "share"])

        found = docs.mapInPandas(run, "item_id long, doc_id long, share double")
        if parts > 1:
            found = cut(found)
            shared.destroy()
        return found

    return reduce(DataFrame.unionByName, [scan(k) for k in range(parts)]).groupBy("item_id", "doc_id").agg(F.max("share").alias("share"))


def without_leaking_documents(documents: DataFrame, items: DataFrame, min_share: float = 0.5, max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """The documents that hold no item, all columns as they are."""
    held = leaks(documents, items, min_share, max_index_words).select("doc_id").distinct()
    return documents.join(held, "doc_id", "left_anti").select(*documents.columns)


def without_leaking_passages(documents: DataFrame, items: DataFrame, min_share: float = 0.5, max_index_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """doc_id, text and removed (characters): every document, the passages of the items it holds cut out of its text.

    Only documents that hold items meet these: each comes with the texts of its own, whose hits are then looked for word by
    word of the text as it stands."""
    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = leaks(documents, items, min_share, max_index_words).join(item_texts(items), "item_id")
    held = held.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("held"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, text, own in zip(batch["doc_id"], batch["text"], batch["held"]):
                kept, at = [], 0
                for start, end in LeakIndex([(i["item_id"], i["text"]) for i in own], min_share=0.0, rare_share=1.0).passages(text):
                    if end > at:
                        kept.append(text[at : max(at, start)])
                        at = end
                left = "".join(kept) + text[at:]
                rows.append((d, left, len(text) - len(left)))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "removed"])

    both = named.join(held, "doc_id", "left")
    cleaned = both.filter("held IS NOT NULL").mapInPandas(run, "doc_id long, text string, removed int")
    return both.filter("held IS NULL").select("doc_id", "text", F.lit(0).alias("removed")).unionByName(cleaned)
