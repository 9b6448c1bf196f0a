"""Deliveries that arrive as files: a stream that keeps author counts and new records up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bibspark.operators import etl, index


def author_counts(rows: DataFrame) -> DataFrame:
    """Streaming form of the author table: rows(name_norm, name) -> name_norm, name, publications."""
    return rows.groupBy("name_norm").agg(F.min("name").alias("name"), F.count("*").alias("publications"))


def batches_below(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches written below a folder of any file system Spark reads; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
    return sorted(int(name.removeprefix("batch=")) for name in found if name.startswith("batch="))


def ingest(spark: SparkSession, landing: str, schema, target: str, checkpoint: str) -> StreamingQuery:
    """Append publications that land as Parquet files, each key once, and bring the author table up to date.

    A batch is written below its own number, and rewriting a batch after a failure
    replaces what it wrote before, so every record is taken exactly once. Of the batches before
    only the keys are read; the author counts of the one before are added to those of the new records."""
    spark_stream = spark.readStream.schema(schema).parquet(landing)

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = [k for k in batches_below(session, f"{target}/publications") if k < number]
        fresh = batch.dropDuplicates(["dblp_key"])
        if earlier:
            known = session.read.parquet(*[f"{target}/publications/batch={k}" for k in earlier]).select("dblp_key")
            fresh = fresh.join(known, "dblp_key", "left_anti").select(*batch.columns)
        fresh.write.mode("overwrite").parquet(f"{target}/publications/batch={number}")
        people = etl.publication_authors(session.read.parquet(f"{target}/publications/batch={number}"))
        names = index.author_names(people)
        if earlier:
            names = index.merge_author_names(session.read.parquet(f"{target}/author_names/batch={earlier[-1]}"), people)
        names.write.mode("overwrite").parquet(f"{target}/author_names/batch={number}")

    return spark_stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
