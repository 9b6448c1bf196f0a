"""Hits grouped into works: versions by the same people under the same title.

Grouping is greedy around each hit in rank order, not transitive; records of
other people are never versions, so author identities are independent groups
and each is resolved in one task. Explicit links may join titles that differ,
and then the titles of linked records count too, until nothing is added.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.functions.records import STANDARD, Rules, reference_type, version_rank
from bibspark.functions.text import author_identity, normalized_title


def same_work_title(left: str, right: str) -> bool:
    """Equal, or long, of nearly one length and nearly the same letters."""
    if left == right:
        return True
    shorter, longer = sorted((len(left), len(right)))
    if shorter < 24 or longer - shorter > max(3, 0.03 * longer):
        return False
    return SequenceMatcher(None, left, right).ratio() >= 0.97


def works_table(publications: DataFrame) -> DataFrame:
    """What grouping needs of each record, worked out once for a built index; who is a short code of the identity."""
    identity = author_identity(F.col("authors"), F.col("dblp_key"))
    return publications.select(
        F.xxhash64(identity).alias("who"), "id", "dblp_key", identity.alias("identity"), (F.coalesce(F.col("authors"), F.lit("")) != "").alias("authored"),
        normalized_title(F.col("title")).alias("norm_title"), "record_type", "venue", "doi", "year",
    )


def resolved(publications: DataFrame, rules: Rules = STANDARD) -> DataFrame:
    """Records (or rows of works_table) with what grouping needs: identity, norm_title, reference_type, rank."""
    works = publications if "norm_title" in publications.columns else works_table(publications)
    kind = reference_type(F.col("record_type"), F.col("venue"), F.col("dblp_key"), rules)
    return works.select(
        "who", "id", "dblp_key", "identity", "authored", "norm_title",
        kind.alias("reference_type"),
        version_rank(kind, F.col("doi"), F.col("year"), F.col("dblp_key")).alias("rank"),
    )


def exact_works(publications: DataFrame) -> DataFrame:
    """Works by equal people and equal normalised title: identity, norm_title, versions, best id and key.

    One hash aggregate; a record without authors or title is its own work."""
    r = resolved(publications)
    alone = ~F.col("authored") | (F.col("norm_title") == "")
    keyed = r.withColumn("work", F.when(alone, F.concat(F.lit("key:"), F.col("dblp_key"))).otherwise(F.concat_ws("\u0001", F.array_join("identity", "\u0002"), F.col("norm_title"))))
    return keyed.groupBy("work").agg(
        F.count("*").alias("versions"), F.min_by("id", "rank").alias("best_id"), F.concat(F.lit("group:"), F.min("dblp_key")).alias("group_key")
    )


def near_title_pairs(publications: DataFrame) -> DataFrame:
    """id_a < id_b by the same people whose titles differ but pass the length and edit-distance gates
    that any pair of the same work passes; what is left for the exact ratio."""
    r = resolved(publications).filter("authored AND length(norm_title) >= 24").select("id", F.array_join("identity", "\u0002").alias("who"), "norm_title")
    # Distinct titles of a person group first: equal titles need no comparison and may be many.
    t = r.groupBy("who", "norm_title").agg(F.min("id").alias("id")).withColumn("n", F.length("norm_title"))
    a, b = t.toDF("who", "ta", "id_a", "na"), t.toDF("who", "tb", "id_b", "nb")
    gate = F.expr("id_a < id_b AND abs(na - nb) <= greatest(3, 0.03 * greatest(na, nb)) AND levenshtein(ta, tb, cast(floor(0.03 * (na + nb) + 1e-9) as int)) >= 0")
    return a.join(b, "who").filter(gate).select("id_a", "id_b", "ta", "tb")


def group_hits(hits: DataFrame, publications: DataFrame, links: DataFrame | None = None, rules: Rules = STANDARD) -> DataFrame:
    """hits(id, hit_rank) -> hit_rank, group_key, best_id, version_count, versions (ids, best first).

    hits is a page of results and is broadcast against the corpus, once by id and once by identity; links(key, group_id)."""
    r = resolved(publications, rules)
    first = F.broadcast(hits.select(F.col("id").alias("__hit"), "hit_rank"))
    found = r.join(first, r["id"] == F.col("__hit")).select("who", "identity", "hit_rank", "id")
    wanted = F.broadcast(found.select("who", "identity").distinct())
    pool = r.join(wanted, ["who", "identity"], "left_semi").join(found.select("id", "hit_rank"), "id", "left")
    if links is not None:
        tied = links.groupBy("key").agg(F.min("group_id").alias("link"))
        pool = pool.join(tied, pool["dblp_key"] == tied["key"], "left").drop("key")
    else:
        pool = pool.withColumn("link", F.lit(None).cast("int"))

    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        records = {r.id: r for r in rows.itertuples()}
        order = sorted(records.values(), key=lambda r: tuple(r.rank.values()) if isinstance(r.rank, dict) else tuple(r.rank))
        out, seen = [], set()
        for hit in sorted((r for r in records.values() if pd.notna(r.hit_rank)), key=lambda r: r.hit_rank):
            if hit.dblp_key in seen:
                continue
            if hit.authored:
                def linked(a, b):
                    return pd.notna(a.link) and pd.notna(b.link) and a.link == b.link

                chosen = {
                    r.id for r in records.values()
                    if (hit.norm_title and r.norm_title and same_work_title(hit.norm_title, r.norm_title)) or linked(hit, r)
                }
                if any(pd.notna(records[i].link) for i in chosen):
                    while True:
                        more = chosen | {
                            r.id for r in records.values()
                            if any(linked(r, records[i]) or (r.norm_title and records[i].norm_title and same_work_title(r.norm_title, records[i].norm_title)) for i in chosen)
                        }
                        if more == chosen:
                            break
                        chosen = more
            else:
                chosen = set()
            chosen = chosen or {hit.id}
            versions = [r for r in order if r.id in chosen]
            seen.update(r.dblp_key for r in versions)
            out.append((int(hit.hit_rank), "group:" + min(r.dblp_key for r in versions), versions[0].id, len(versions), [r.id for r in versions]))
        return pd.DataFrame(out, columns=["hit_rank", "group_key", "best_id", "version_count", "versions"])

    flat = pool.select(F.array_join("identity", "\u0002").alias("who"), "id", "dblp_key", "authored", "norm_title", "rank", "hit_rank", "link")
    return flat.groupBy("who").applyInPandas(resolve, "hit_rank int, group_key string, best_id long, version_count int, versions array<long>")
