"""Encoding of a corpus with a public byte-level BPE vocabulary.

Speculate and verify. Each word (by the vocabulary's own split pattern) is
first cut by greedy longest match. A sequence of tokens is what merging yields
exactly if every adjacent pair is compatible, that is, if merging the bytes of
the two tokens alone gives those two tokens back. All pairs of a batch are
tested at once against the pairs known so far; pairs not met before are decided
by merging their few bytes. Only words with a failing pair are merged exactly.

Defined results: an empty or null text has an empty list; special tokens'
strings are ordinary text; ids are those of the vocabulary file. Words and
pairs are remembered per Python worker, within bounds that only cost time.
The vocabulary (a fixed file of under 1 MB) is the only thing sent to workers.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED_WORDS = 500_000
MAX_VOCABULARY_BYTES = 64 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is too large for a vocabulary")
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern)
        self.words: dict[str, tuple[int, ...]] = {}
        self.size = max(self.tokens) + 1
        self.good = np.empty(0, np.int64)
        self.bad = np.empty(0, np.int64)
        self.speculated = self.merged = 0

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Exact merging: the lowest-ranked adjacent pair first, leftmost on ties."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def merge_long(self, data: bytes) -> tuple[int, ...]:
        """Exact merging with a heap over a linked list, for words of any length."""
        if len(data) < 64:
            return self.merge(data)
        import heapq

        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\x01" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != stop or not alive[j]:
                continue
            end[i], after[i], alive[j] = stop, after[j], 0
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n and (r := ranks.get(data[left : end[right]])) is not None:
                    heapq.heappush(heap, (r, left, end[right]))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = after[i]
        return tuple(out)

    def greedy(self, data: bytes) -> list[int]:
        out, i, n, ranks, longest = [], 0, len(data), self.ranks, self.longest
        while i < n:
            for stop in range(min(n, i + longest), i, -1):
                rank = ranks.get(data[i:stop])
                if rank is not None:
                    out.append(rank)
                    i = stop
                    break
        return out

    def compatible(self, codes: np.ndarray) -> np.ndarray:
        """For pairs coded left * size + right, whether merging keeps them apart."""
        def among(known: np.ndarray) -> np.ndarray:
            if not len(known):
                return np.zeros(len(codes), bool)
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            return known[at] == codes

        fresh = np.unique(codes[~(among(self.good) | among(self.bad))])
        if len(fresh):
            ok = np.array([self.merge_long(self.tokens[c // self.size] + self.tokens[c % self.size]) == (c // self.size, c % self.size) for c in fresh.tolist()])
            self.good = np.union1d(self.good, fresh[ok])
            self.bad = np.union1d(self.bad, fresh[~ok])
        return among(self.good)

    def learn(self, words: list[str]) -> None:
        guesses, todo = [], []
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(data)
            if rank is not None:
                self.words[word] = (rank,)  # a token of the vocabulary is what its own bytes merge to
            else:
                todo.append((word, data))
                guesses.append(np.array(self.greedy(data), np.int64))
        if not todo:
            return
        lengths = np.array([len(g) - 1 for g in guesses])
        codes = np.concatenate([g[:-1] * self.size + g[1:] for g in guesses])
        fails = np.add.reduceat(np.append(~self.compatible(codes), False).astype(np.int64), np.minimum(np.concatenate([[0], np.cumsum(lengths)[:-1]]), len(codes)))
        fails[lengths == 0] = 0
        for (word, data), guess, failed in zip(todo, guesses, fails.tolist()):
            self.speculated += 1
            if failed:
                self.merged += 1
                self.words[word] = self.merge_long(data)
            else:
                self.words[word] = tuple(guess.tolist())

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        if len(self.good) + len(self.bad) > 4 * REMEMBERED_WORDS:
            self.good = self.bad = np.empty(0, np.int64)
        parts = [self.split.findall(t) if t else [] for t in texts]
        fresh = {w for p in parts for w in p} - self.words.keys()
        self.learn(sorted(fresh))
        known = self.words
        return [np.array([i for w in p for i in known[w]], np.int32) for p in parts]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encode_column(df: DataFrame, doc_id: str, text: str, path: str | None = None, tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """doc_id and ids of every row of df; one narrow pass, no shuffle of texts."""
    spark: SparkSession = df.sparkSession
    path = path or os.path.join(tokenizer_dir, VOCABULARY)
    ranks = read_ranks(path)
    key = (path, len(ranks))
    shared = spark.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, Encoder(shared.value))
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": encoder.encode_batch([t if isinstance(t, str) else None for t in batch["text"]])})

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInPandas(run, "doc_id long, ids array<int>")
