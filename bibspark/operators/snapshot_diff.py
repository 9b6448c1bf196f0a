"""What changed between consecutive full snapshots.

Each delivered row is unpivoted into signed cells (entity, key, field, value):
+1 in the step that leads to its snapshot, -1 in the step that leaves it, plus a
presence marker per key. Equal cells cancel, so nonzero grouped sums are the
differences: a marker left over means added (+1) or removed (-1), fields left
over under a cancelled marker mean changed, and they name the changed fields.

Versions of a key within a snapshot are reduced by a partial maximum before
their shuffle, so a key delivered any number of times costs one row per task.
After that a key has at most one row per snapshot, and whole rows that equal those of
the neighbouring snapshot cancel before they are unpivoted: only rows that
changed, came or went become cells. One exchange on the key serves both the
cell sums and the classification.

Defined results: null and empty values are equal; rows with a null key or
snapshot give no row; repeated rows count once; equal times are decided by the
larger values; snapshots follow each other by instant, those without one come
by their first load time; the first snapshot gives no rows; a snapshot with no
rows at all in an entity takes part through the other's metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUBLICATION_FIELDS = ("record_type", "title", "year", "venue", "doi")


def snapshot_steps(metadata: DataFrame, loads: DataFrame | None = None) -> DataFrame:
    """snapshot_id, at, position: snapshots in the order of their instants.

    There is one row per delivered snapshot, so the window over all of them is small."""
    told = metadata.filter("snapshot_id IS NOT NULL").groupBy("snapshot_id").agg(
        F.min(F.when(F.col("key") == "downloaded_at", F.expr("try_to_timestamp(value)"))).alias("told")
    )
    if loads is None:
        timed = told.withColumn("at", F.col("told"))
    else:
        loaded = loads.filter("snapshot_id IS NOT NULL").groupBy("snapshot_id").agg(F.min("loaded_at").alias("loaded"))
        timed = told.join(loaded, "snapshot_id", "full").withColumn("at", F.coalesce("told", "loaded"))
    return timed.select("snapshot_id", "at", F.row_number().over(Window.orderBy(F.col("at").asc_nulls_first(), "snapshot_id")).alias("position"))


def _cells(rows: DataFrame, entity: str, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Unpivot rows with snapshot position into signed cells, but for rows equal to the one before or after, which cancel."""
    present = F.struct(F.lit("").alias("field"), F.lit("").alias("value"))
    cells = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]
    along = Window.partitionBy("item_key").orderBy("position")
    whole = F.struct("position", *fields)
    beside = lambda row, by: (row["position"] == F.col("position") + by) & _all_equal(row, fields)
    sided = rows.select(F.col(key).alias("item_key"), "position", *texts).select(
        "item_key", "position", *fields, F.lag(whole).over(along).alias("__before"), F.lead(whole).over(along).alias("__after")
    )
    came = F.when(~F.coalesce(beside(F.col("__before"), -1), F.lit(False)), F.struct(F.col("position").alias("step"), F.lit(1).alias("sign")))
    went = F.when(~F.coalesce(beside(F.col("__after"), 1), F.lit(False)), F.struct((F.col("position") + 1).alias("step"), F.lit(-1).alias("sign")))
    return (
        sided.select(F.lit(entity).alias("entity"), "item_key", F.explode(F.array_compact(F.array(came, went))).alias("__s"), F.array(present, *cells).alias("__c"))
        .select("entity", "item_key", "__s.step", "__s.sign", F.explode("__c").alias("__c"))
        .select("entity", "item_key", "step", "sign", "__c.field", "__c.value")
    )


def _all_equal(row: Column, fields: tuple[str, ...]) -> Column:
    equal = F.lit(True)
    for f in fields:
        equal = equal & (row[f] == F.col(f))
    return equal


def latest_rows(rows: DataFrame, key: str, fields: tuple[str, ...], order: list[Column]) -> DataFrame:
    """One row per snapshot and key: the maximum by order, then by its values."""
    best = F.max(F.struct(*order, *[F.col(f) for f in fields])).alias("__r")
    reduced = rows.filter(F.col(key).isNotNull() & F.col("snapshot_id").isNotNull()).groupBy("snapshot_id", key).agg(best)
    return reduced.select("snapshot_id", key, *[F.col("__r")[f].alias(f) for f in fields])


def changed_cells(publications: DataFrame, metadata: DataFrame) -> DataFrame:
    """entity, item_key, step, field, value, balance: the cells that do not cancel."""
    p = publications.select("snapshot_id", "dblp_key", "loaded_at", *PUBLICATION_FIELDS)
    m = metadata.select("snapshot_id", "key", "value")
    steps = F.broadcast(snapshot_steps(m, p).select("snapshot_id", "position"))
    pubs = latest_rows(p, "dblp_key", PUBLICATION_FIELDS, [F.col("loaded_at").alias("__at")]).join(steps, "snapshot_id")
    meta = latest_rows(m, "key", ("value",), []).join(steps, "snapshot_id")
    cells = _cells(pubs, "publications", "dblp_key", PUBLICATION_FIELDS).unionByName(_cells(meta, "metadata", "key", ("value",)))
    # Rows are bounded per key here, so hash partitions of the key are even; both aggregates below keep this partitioning.
    spread = cells.repartition("entity", "item_key")
    return spread.groupBy("entity", "item_key", "step", "field", "value").agg(F.sum("sign").alias("balance")).filter("balance <> 0")


def snapshot_changes(publications: DataFrame, metadata: DataFrame) -> DataFrame:
    """entity, item_key, snapshot_id (the later of the two), change, fields (the changed ones)."""
    cells = changed_cells(publications, metadata)
    marker = F.coalesce(F.sum(F.when(F.col("field") == "", F.col("balance"))), F.lit(0))
    kinds = cells.groupBy("entity", "item_key", "step").agg(
        F.when(marker > 0, "added").when(marker < 0, "removed").otherwise("changed").alias("change"),
        F.array_sort(F.collect_set(F.when(F.col("field") != "", F.col("field")))).alias("fields"),
    )
    steps = snapshot_steps(metadata.select("snapshot_id", "key", "value"), publications.select("snapshot_id", "loaded_at"))
    later = F.broadcast(steps.filter("position > 1").select("snapshot_id", F.col("position").alias("step")))
    return kinds.join(later, "step").select("entity", "item_key", "snapshot_id", "change", "fields")
