"""Tables derived from the bibliography: author lookups, postings, corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions.text import fold, index_tokens, name_suffixes
from bibspark.operators import grouping
from bibspark.plans.query import COLUMNS


def author_names(authors: DataFrame) -> DataFrame:
    """name_norm, name (the smallest spelling), publications (rows): partial aggregation before the shuffle."""
    return authors.groupBy("name_norm").agg(F.min("name").alias("name"), F.count("*").alias("publications"))


def merge_author_names(old: DataFrame, delta: DataFrame) -> DataFrame:
    """The author table after more author rows: counts add up, the smaller spelling stays."""
    both = old.select("name_norm", "name", "publications").unionByName(author_names(delta))
    return both.groupBy("name_norm").agg(F.min("name").alias("name"), F.sum("publications").alias("publications"))


def author_folded(names: DataFrame) -> DataFrame:
    return names.select(fold(F.col("name")).alias("name_folded"), "name", "publications")


def author_suffixes(names: DataFrame) -> DataFrame:
    """suffix_folded, name_norm: every later part of a name leads to it."""
    folded = names.select("name_norm", fold(F.col("name")).alias("folded"))
    return folded.select(F.explode(name_suffixes(F.col("folded"))).alias("suffix_folded"), "name_norm").distinct()


def tokenised(publications: DataFrame) -> DataFrame:
    """id and one token array per indexed column."""
    return publications.select("id", *[index_tokens(F.col(c)).alias(c) for c in COLUMNS])


def postings(publications: DataFrame) -> DataFrame:
    """term, id, n_tokens (the record's length), col, pos: one row per token; a filter on term applies before anything is shuffled."""

    def placed(k: int, c: str) -> Column:
        return F.transform(F.col(c), lambda t, i: F.struct(t.alias("term"), F.lit(k).alias("col"), i.alias("pos")))

    rows = F.concat(*[placed(k, c) for k, c in enumerate(COLUMNS)])
    return tokenised(publications).select("id", F.explode(rows).alias("p"), F.size(rows).cast("long").alias("n_tokens")).select("p.term", "id", "n_tokens", "p.col", "p.pos")


def doc_stats(publications: DataFrame) -> DataFrame:
    """id, n_tokens over the indexed columns."""
    size = sum((F.size(c) for c in COLUMNS[1:]), F.size(COLUMNS[0]))
    return tokenised(publications).select("id", size.cast("long").alias("n_tokens"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """n_docs, avgdl: one row."""
    return docs.agg(F.count("*").alias("n_docs"), F.avg("n_tokens").alias("avgdl"))


def title_grams(publications: DataFrame, size: int = 3) -> DataFrame:
    """gram, id: distinct character n-grams of folded titles, for blocking approximate searches."""
    text = fold(F.coalesce(F.col("title"), F.lit("")))
    folded = publications.select("id", text.alias("t")).filter(F.length("t") >= size)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - (size - 1)), lambda i: F.substring(F.col("t"), i, F.lit(size))))
    return folded.select(F.explode(grams).alias("gram"), "id")


def _sorted(df: DataFrame, key: str, files: int, target: str) -> None:
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(target)


def write_names(names: DataFrame, target: str, files: int | None = None) -> None:
    """The author tables below target, sorted by the name they are looked up by; the two others come from the written first."""
    n = files or names.sparkSession.sparkContext.defaultParallelism
    _sorted(names, "name_norm", n, f"{target}/author_names")
    names = names.sparkSession.read.parquet(f"{target}/author_names")
    _sorted(author_folded(names), "name_folded", n, f"{target}/author_folded")
    _sorted(author_suffixes(names), "suffix_folded", n, f"{target}/author_suffixes")


def write_index(publications: DataFrame, authors: DataFrame, target: str, files: int | None = None) -> None:
    """All tables of one index version below target.

    Postings are range-partitioned and sorted by term, so that a lookup reads the row groups its term can be in."""
    spark = publications.sparkSession
    n = files or spark.sparkContext.defaultParallelism
    publications.write.mode("overwrite").parquet(f"{target}/publications")
    authors.write.mode("overwrite").parquet(f"{target}/publication_authors")
    _sorted(postings(publications), "term", n, f"{target}/postings")
    _sorted(grouping.works_table(publications), "who", n, f"{target}/works")
    _sorted(title_grams(publications), "gram", n, f"{target}/title_grams")
    write_names(author_names(authors), target, n)
    doc_stats(publications).write.mode("overwrite").parquet(f"{target}/doc_stats")
    corpus_stats(spark.read.parquet(f"{target}/doc_stats")).write.mode("overwrite").parquet(f"{target}/corpus_stats")
