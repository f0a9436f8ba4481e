"""Samples by quota that keep clusters whole, and matched background samples. All orders are hashes, so results don't depend on partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.lexicons import STRATUM_WEIGHTS
from tesserae.operators.dedup import keep_first, row_ids
from tesserae.operators.skew import attach, bucketed_running, hex_order
from tesserae.session import cut_lineage


def make_quota(total: int, weights: dict[str, float] = STRATUM_WEIGHTS) -> dict[str, int]:
    """``total`` by ``weights``: each share rounded half to even, then one more or less in turn until the sum is right."""
    scale = sum(weights.values())
    quota = {k: round(total * w / scale) for k, w in weights.items()}
    names, k = list(weights), 0
    while (gap := total - sum(quota.values())) and names:
        step = 1 if gap > 0 else -1
        if quota[names[k % len(names)]] + step >= 0:
            quota[names[k % len(names)]] += step
        k += 1
    return quota


def hashed_order(key: str, seed: int = 42):
    return F.sha1(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all): the first by hash of ``key``."""
    return df.orderBy(hashed_order(key, seed), key).limit(max(n, 0))


def quota_sample(df: DataFrame, key: str, stratum: str, quota: dict[str, int], seed: int = 42) -> DataFrame:
    """The first rows by hash of each stratum, up to its quota.

    Of a stratum only rows whose hash lies under a bound for a few times the quota are ranked, so no task orders a whole large stratum.
    """
    spark = df.sparkSession
    table = spark.createDataFrame(list(quota.items()), "stratum string, quota int")
    sizes = df.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("_n")).join(table, "stratum")
    held = df.join(sizes, df[stratum] == sizes["stratum"]).drop("stratum") if stratum != "stratum" else df.join(sizes, "stratum")
    h = hashed_order(key, seed)
    near = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * F.col("_n") < 2 * F.col("quota") + 200
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(h, key))
    return held.where(near).withColumn("_r", rank).where("_r <= quota").drop("_r", "_n", "quota")


def cluster_sample(df: DataFrame, cluster: str, target: int, cap: int | None = None, seed: int = 42, exclude: DataFrame | None = None) -> DataFrame:
    """Rows of whole clusters in hashed order until ``target`` rows are reached; a cluster that would pass ``cap`` (unset: ``target``) is skipped.

    Sizes are those of the cluster in all of ``df``; null is no cluster. The clusters that fit one after the other are found by running sums, up to the first that doesn't fit; the rest, without what can't fit
    any more, is gone through in the same way. No task ever holds or orders all clusters.
    """
    pool = df if exclude is None else df.join(exclude.select(cluster).distinct(), cluster, "left_anti")
    most, held, taken = max(target, cap or target), 0, []
    sizes = pool.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n")).withColumn("_d", hashed_order(cluster, seed))
    left = cut_lineage(sizes.withColumn("_h", hex_order("_d")).withColumn("_g", F.lit(0)))
    while held < target:
        left = left.where(F.col("n") <= most - held)
        line = cut_lineage(bucketed_running(left, "_g", "_h", "_d", F.col("n"), name="_to"))
        wrong = line.where(F.col("_to") > most - held).agg(F.min("_to").alias("to")).first()["to"]
        fits = line.where((F.col("_to") - F.col("n") < target - held) & (F.lit(True) if wrong is None else F.col("_to") < wrong))
        got = fits.agg(F.sum("n").alias("n")).first()["n"] or 0
        taken.append(fits.select(cluster))
        held += got
        if wrong is None:
            break
        left = line.where(F.col("_to") > wrong).drop("_to")
    chosen = reduce(DataFrame.unionAll, taken) if taken else left.limit(0).select(cluster)
    return pool.join(chosen.distinct(), cluster, "left_semi").select(*pool.columns)


def matched_background(pool: DataFrame, reference: DataFrame, keys: list[str], key: str, total: int, seed: int = 42) -> DataFrame:
    """``total`` rows of ``pool`` (or all) whose distribution over ``keys`` follows ``reference``; what cells lack is filled from the rest by hash."""
    cells = reference.groupBy(*keys).agg(F.count("*").alias("_r"))
    whole = cells.agg(F.sum("_r").alias("_all"))
    goals = cells.join(F.broadcast(whole), F.lit(True)).select(*keys, F.round(F.col("_r") * total / F.col("_all")).cast("int").alias("_goal"))  # one row
    cell = F.to_json(F.struct(*keys))
    held = attach(pool, goals, keys).withColumn("_g", cell).withColumn("_d", hashed_order(key, seed)).withColumn("_h", hex_order("_d"))
    ranked = bucketed_running(held, "_g", "_h", "_d", name="_rank")
    first = F.when(F.col("_rank") <= F.coalesce("_goal", F.lit(0)), 0).otherwise(1)
    return ranked.orderBy(first, "_d", key).limit(total).select(*pool.columns)


#: What is sampled: single awards, whole clusters, or one award of each cluster.
DUPLICATE_MODES = ("award", "cluster_expand", "cluster_representative")


def annotation_sample(df: DataFrame, key: str, cluster: str, stratum: str, total: int, forced: DataFrame | None = None, seed: int = 42, labels: list[str] = (), mode: str = "cluster_expand", abstract: str | None = None, overrun: bool = False) -> DataFrame:
    """A sample for annotation: forced clusters first, whole clusters per stratum by quota, then any clusters until ``total``; numbered in hashed order with empty label columns.

    ``mode`` is one of ``DUPLICATE_MODES``: ``award`` samples every ``key`` for itself, ``cluster_representative`` the row with the least key of each cluster. With ``abstract`` (a 0/1 column) rows without one are left out.
    No cluster is ever cut: one that would pass ``total`` is skipped. Forced clusters of more than ``total`` rows are sampled themselves, unless ``overrun`` lets all of them in.
    """
    if mode not in DUPLICATE_MODES:
        raise ValueError(f"mode must be one of {', '.join(DUPLICATE_MODES)}")
    pool = df if abstract is None else df.where(F.col(abstract) == 1)
    unit = key if mode == "award" else cluster
    if mode == "cluster_representative":
        pool = keep_first(pool.where(F.col(cluster).isNotNull()), [cluster], [F.col(key)])
    pool, picked = cut_lineage(pool), None
    if forced is not None:
        picked = cut_lineage(pool.join(forced.select(unit).distinct(), unit, "left_semi"))
        if not overrun and picked.count() > total:
            picked = cut_lineage(cluster_sample(picked, unit, total, cap=total, seed=seed))
    picked = pool.limit(0) if picked is None else picked
    quota = make_quota(max(total - picked.count(), 0))
    for name, n in quota.items():
        if n:  # each step is written, so that the plan doesn't grow with the steps
            own = pool.join(pool.where(F.col(stratum) == name).select(unit).distinct(), unit, "left_semi")  # whole clusters, whatever the strata of their other rows
            picked = cut_lineage(picked.unionByName(cluster_sample(own, unit, n, cap=n, seed=seed, exclude=picked)))
    lacking = total - picked.count()
    if lacking > 0:
        picked = cut_lineage(picked.unionByName(cluster_sample(pool, unit, lacking, cap=lacking, seed=seed, exclude=picked)))
    named = picked.withColumn("annotation_duplicate_mode", F.lit(mode)).withColumn("_o", hashed_order(key, seed))
    return row_ids(named, ["_o", key], "ann_", 5, "annotation_id").drop("_o").withColumns({c: F.lit(None).cast("string") for c in labels})
