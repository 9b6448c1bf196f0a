"""Suggestions while typing, and the titles closest to a mistyped one."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.functions.text import fold, fold_accents, query_tokens, query_words
from bibspark.operators.search import phrase_hits, ranked
from bibspark.plans.query import TITLE_WEIGHTS, Phrase, match_phrases


def suggest_authors(folded: DataFrame, suffixes: DataFrame, names: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """name, publications of the authors whose name, or a later part of it, starts with q; most published first."""
    start = fold_accents(q.strip())
    direct = folded.filter(F.col("name_folded").startswith(start)).select("name", "publications")
    later = suffixes.filter(F.col("suffix_folded").startswith(start)).select("name_norm").distinct()
    found = direct.unionByName(names.join(later, "name_norm").select("name", "publications"))
    once = found.groupBy("name").agg(F.max("publications").alias("publications"))
    if not start:
        once = once.filter(F.lit(False))
    return once.orderBy(F.desc("publications"), fold(F.col("name")), "name").limit(limit)


def suggest_titles(publications: DataFrame, postings: DataFrame, corpus: DataFrame, q: str, limit: int = 10) -> DataFrame:
    """dblp_key, title, year of the best matches by title alone."""
    phrases = tuple(match_phrases(q.strip()))
    base = publications.filter("title <> ''").select("id", "dblp_key", "title", "year")
    if not phrases or any(not p.tokens for p in phrases):
        return base.filter(F.lit(False)).select("dblp_key", "title", "year")
    return base.join(ranked(postings, corpus, phrases, TITLE_WEIGHTS), "id").orderBy("score", "id").limit(limit).select("dblp_key", "title", "year")


def closest_phrases(q: str) -> tuple[Phrase, ...]:
    """Up to eight words; those of four letters or more are cut to their first two."""
    cut = [w[:2] if len(w) >= 4 else w for w in query_words(q.strip().casefold(), 8)]
    return tuple(Phrase(tuple(query_tokens(w)), True, (0,), k) for k, w in enumerate(cut))


def closest_candidates(postings: DataFrame, q: str, cap: int | None = 5000) -> DataFrame:
    """id, missing: records with every word's start in the title (missing -1), or, if there are none,
    those that lack exactly the earliest word whose omission finds any. The cap is part of the service's contract; None takes every candidate."""
    phrases = closest_phrases(q)
    hits = phrase_hits(postings, phrases).groupBy("id").agg(F.collect_set("phrase").alias("have"))
    every = F.array(*[F.lit(k) for k in range(len(phrases))])
    scored = hits.select("id", F.array_except(every, F.col("have")).alias("lack")).filter(F.size("lack") <= (1 if len(phrases) > 1 else 0))
    placed = scored.select("id", F.coalesce(F.try_element_at("lack", F.lit(1)), F.lit(-1)).alias("missing"))
    best = placed.agg(F.min("missing").alias("best"))
    return placed.join(F.broadcast(best), F.col("missing") == F.col("best")).select("id", "missing").transform(lambda df: df if cap is None else df.orderBy("id").limit(cap))


def closest(publications: DataFrame, postings: DataFrame, q: str, limit: int = 10, cap: int | None = 5000) -> DataFrame:
    """id, dblp_key, title, authors, year, venue, record_type, similarity: the titles most like q, ties by id."""
    q = q.strip()
    columns = ("id", "dblp_key", "title", "authors", "year", "venue", "record_type")
    base = publications.select(*columns)
    if len(q) < 3 or not query_words(q, 8):
        return base.filter(F.lit(False)).withColumn("similarity", F.lit(None).cast("double"))
    needle = q.casefold()
    single = len(query_words(needle, 100)) == 1

    def ratios(titles: pd.Series) -> pd.Series:
        def one(title: str | None) -> float:
            text = (title or "").casefold()
            best = SequenceMatcher(None, needle, text).ratio()
            if single:
                best = max([best, *(SequenceMatcher(None, needle, w).ratio() for w in query_words(text, 10_000))])
            return best

        return titles.map(one)

    similarity = F.pandas_udf(ratios, "double")
    candidates = closest_candidates(postings, q, cap)
    found = base.join(candidates if cap is None else F.broadcast(candidates), "id").select(*columns, similarity("title").alias("similarity"))
    return found.orderBy(F.desc("similarity"), "id").limit(limit)


