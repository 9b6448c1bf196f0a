"""Ranked, filtered search over postings.

The score is the usual BM25 (k1 1.2, b 0.75) with column weights, summed over
all phrases of the request; document frequencies, lengths and their mean are
those of the whole corpus. Only postings of the request's own terms are
shuffled, aggregated per record and phrase before that; a posting carries its
record's length, so no table of lengths is joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions.records import STANDARD, Rules, filter_class, record_url, reference_type
from bibspark.functions.text import fold_accents
from bibspark.plans.query import SEARCH_WEIGHTS, Phrase, QuerySpec

FIELDS = ("dblp_key", "record_type", "title", "authors", "year", "venue", "doi", "ee", "mdate")


def phrase_hits(postings: DataFrame, phrases: tuple[Phrase, ...]) -> DataFrame:
    """phrase, id, col, n, n_tokens: how often each phrase occurs in each column of each record, and the record's length."""
    wanted: list[Column] = []
    for number, p in enumerate(phrases):
        for k, token in enumerate(p.tokens):
            last = k == len(p.tokens) - 1
            same = F.col("term").startswith(token) if p.prefix and last else F.col("term") == token
            column = F.col("col").isin(*p.columns)
            wanted.append(F.when(same & column, F.struct(F.lit(number).alias("phrase"), F.lit(k).alias("k"))))
    any_term = reduce(lambda a, b: a | b, [F.col("term").startswith(t) if p.prefix and k == len(p.tokens) - 1 else F.col("term") == t for p in phrases for k, t in enumerate(p.tokens)])
    hits = postings.filter(any_term).select("id", "n_tokens", "col", "pos", F.explode(F.array_compact(F.array(*wanted))).alias("h"))
    hits = hits.select("h.phrase", "h.k", "id", "n_tokens", "col", (F.col("pos") - F.col("h.k")).alias("start"))
    long = [n for n, p in enumerate(phrases) if len(p.tokens) > 1]
    if not long:
        return hits.groupBy("phrase", "id", "col").agg(F.count("*").alias("n"), F.max("n_tokens").alias("n_tokens"))
    sizes = F.create_map(*[x for n, p in enumerate(phrases) for x in (F.lit(n), F.lit(len(p.tokens)))])
    whole = hits.groupBy("phrase", "id", "col", "start").agg(F.count_distinct("k").alias("k"), F.max("n_tokens").alias("n_tokens")).filter(F.col("k") == sizes[F.col("phrase")])
    return whole.groupBy("phrase", "id", "col").agg(F.count("*").alias("n"), F.max("n_tokens").alias("n_tokens"))


def ranked(postings: DataFrame, corpus: DataFrame, phrases: tuple[Phrase, ...], weights: tuple[float, ...] = SEARCH_WEIGHTS) -> DataFrame:
    """id, score (negative, best first) of the records in which every clause has a hit; corpus has one row (n_docs, avgdl)."""
    hits = phrase_hits(postings, phrases)
    weight = F.create_map(*[x for c, w in enumerate(weights) for x in (F.lit(c), F.lit(float(w)))])
    per = hits.groupBy("phrase", "id").agg(F.sum(weight[F.col("col")] * F.col("n")).alias("f"), F.max("n_tokens").alias("n_tokens"))
    frequency = per.groupBy("phrase").agg(F.count("*").alias("n_i"))  # a row per phrase
    idf = F.log((F.col("n_docs") - F.col("n_i") + 0.5) / (F.col("n_i") + 0.5))
    facts = frequency.join(F.broadcast(corpus)).select("phrase", "avgdl", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf"))
    clause = F.create_map(*[x for n, p in enumerate(phrases) for x in (F.lit(n), F.lit(p.clause))])
    part = F.col("idf") * F.col("f") * 2.2 / (F.col("f") + 1.2 * (0.25 + 0.75 * F.col("n_tokens") / F.col("avgdl")))
    return (
        per.join(F.broadcast(facts), "phrase")
        .groupBy("id")
        .agg((-F.sum(part)).alias("score"), F.count_distinct(clause[F.col("phrase")]).alias("clauses"))
        .filter(F.col("clauses") == len({p.clause for p in phrases}))
        .select("id", "score")
    )


def author_hits(authors: DataFrame, suffixes: DataFrame | None, author: str, exact: bool) -> DataFrame:
    """publication_id of the records by an author: exact name, or first letters of the name or of a later part."""
    if exact:
        return authors.filter(F.col("name_norm") == author).select("publication_id").distinct()
    direct = authors.filter(F.col("name_norm").startswith(author)).select("publication_id")
    if suffixes is None:
        return direct.distinct()
    named = suffixes.filter(F.col("suffix_folded").startswith(fold_accents(author))).select("name_norm")
    return direct.unionByName(authors.join(named, "name_norm", "left_semi").select("publication_id")).distinct()


def facet_filter(publications: DataFrame, spec: QuerySpec, rules: Rules = STANDARD) -> DataFrame:
    """Years, record type and categories; records without year drop out where a year is asked for."""
    out = publications
    if spec.year_from is not None:
        out = out.filter(F.col("year") >= spec.year_from)
    if spec.year_to is not None:
        out = out.filter(F.col("year") <= spec.year_to)
    if spec.record_type:
        out = out.filter(F.col("record_type") == spec.record_type)
    if spec.categories:
        out = out.filter(filter_class(F.col("record_type"), F.col("venue"), F.col("dblp_key"), rules).isin(*sorted(spec.categories)))
    return out


def matches(publications: DataFrame, postings: DataFrame, corpus: DataFrame, authors: DataFrame, suffixes: DataFrame | None, spec: QuerySpec, rules: Rules = STANDARD) -> DataFrame:
    """All records that satisfy the request, with score (null without text), unordered."""
    base = facet_filter(publications, spec, rules).select("id", *FIELDS)
    if spec.empty:
        return base.filter(F.lit(False)).withColumn("score", F.lit(None).cast("double"))
    if spec.author:
        hits = author_hits(authors, suffixes, spec.author, spec.author_exact).withColumnRenamed("publication_id", "id")
        base = base.join(hits, "id", "left_semi")
    if spec.phrases:
        return base.join(ranked(postings, corpus, spec.phrases), "id")
    return base.withColumn("score", F.lit(None).cast("double"))


def order_of(spec: QuerySpec) -> list[Column]:
    if spec.sort == "year_asc":
        return [F.col("year").asc_nulls_first(), F.col("id").asc()]
    if spec.sort == "year_desc" or not spec.phrases:
        return [F.col("year").desc_nulls_last(), F.col("id").desc()]
    return [F.col("score").asc(), F.col("id").asc()]


def page(hits: DataFrame, spec: QuerySpec) -> DataFrame:
    """The page of hits asked for and one more, which tells whether there are more."""
    return hits.orderBy(*order_of(spec)).offset(spec.offset).limit(spec.limit + 1)


def labelled(hits: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    return hits.withColumn("url", record_url(F.col("dblp_key"))).withColumn("reference_type", reference_type(F.col("record_type"), F.col("venue"), F.col("dblp_key"), rules))


def facet_counts(hits: DataFrame) -> DataFrame:
    return labelled(hits).groupBy("reference_type").agg(F.count("*").alias("n"))
