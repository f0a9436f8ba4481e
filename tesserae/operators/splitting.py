"""Split assignment that keeps clusters whole: by time, flag, hash, stratified deficit and connected components."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import hash_bucket
from tesserae.operators.components import connected_components
from tesserae.operators.reports import group_mode
from tesserae.operators.skew import attach, bucketed_running, hex_order

#: Cut points of the time split and bounds of the hash split. Fixed values.
TRAIN_UNTIL, VALIDATION_UNTIL = 2016, 2019
BOUNDS = (70, 85)
SPLITS = ("train", "validation", "test")
RATIOS = (0.70, 0.15, 0.15)


def bucket_split(bucket, bounds: tuple[int, int] = BOUNDS):
    return F.when(bucket < bounds[0], SPLITS[0]).when(bucket < bounds[1], SPLITS[1]).otherwise(SPLITS[2])


def hash_split(df: DataFrame, key: str, name: str = "split", salt: str = "") -> DataFrame:
    """``df`` with the split of ``key`` by SHA-1 modulo 100; null keys share one."""
    text = F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return df.withColumn(name, bucket_split(hash_bucket(text)))


def temporal_split(df: DataFrame, cluster: str, year: str, name: str = "split", train_until: int = TRAIN_UNTIL, validation_until: int = VALIDATION_UNTIL) -> DataFrame:
    """``df`` with the split of the latest year of its cluster; clusters without any year are ``unknown``."""
    last = df.groupBy(cluster).agg(F.max(year).alias("_y"))
    rule = F.when(F.col("_y").isNull(), "unknown").when(F.col("_y") <= train_until, SPLITS[0]).when(F.col("_y") <= validation_until, SPLITS[1]).otherwise(SPLITS[2])
    return attach(df, last, [cluster]).withColumn(name, rule).drop("_y")


def transfer_split(df: DataFrame, cluster: str, source, target, name: str = "split") -> DataFrame:
    """``test`` for clusters with any row of ``target``, ``train`` for others with any row of ``source``, else ``unused``."""
    flags = df.groupBy(cluster).agg(F.max(F.coalesce(target.cast("int"), F.lit(0))).alias("_t"), F.max(F.coalesce(source.cast("int"), F.lit(0))).alias("_s"))
    rule = F.when(F.col("_t") == 1, SPLITS[2]).when(F.col("_s") == 1, SPLITS[0]).otherwise("unused")
    return attach(df, flags, [cluster]).withColumn(name, rule).drop("_t", "_s")


def component_split(df: DataFrame, cluster: str, key: str, name: str = "split", unknown_ties: bool = True) -> DataFrame:
    """``df`` with one split per connected component of clusters and key values, by hash of the component's smallest node.

    With ``unknown_ties`` blank keys are one value ``unknown`` that ties all such clusters; without it they tie nothing.
    """
    value = F.lower(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    value = F.when(value == "", F.lit("unknown") if unknown_ties else F.concat(F.lit("row:"), F.col(cluster).cast("string"))).otherwise(value)
    nodes = df.withColumn("_c", F.concat(F.lit("cluster:"), F.coalesce(F.col(cluster).cast("string"), F.lit("")))).withColumn("_k", F.concat(F.lit("key:"), value))
    components = connected_components(nodes.select(F.col("_c").alias("src"), F.col("_k").alias("dst")).distinct())
    split = components.where(F.col("node").startswith("cluster:")).select(F.col("node").alias("_c"), bucket_split(hash_bucket("component")).alias(name))
    return nodes.join(split, "_c", "left").drop("_c", "_k")


def _deal(frame: pd.DataFrame, n_rows: float, ratios: tuple[float, ...]) -> list[str]:
    held, target, out = [0] * 3, [r * n_rows for r in ratios], []
    for size in frame["n"]:
        pick = min(range(3), key=lambda s: (-(target[s] - held[s]), held[s], s))
        held[pick] += int(size)
        out.append(SPLITS[pick])
    return out


def greedy_split(df: DataFrame, cluster: str, stratum: str, name: str = "split", seed: int = 42, ratios: tuple[float, ...] = RATIOS, parts: int = 1) -> DataFrame:
    """``df`` with splits dealt per stratum: shuffled clusters go, one by one, to the split that lacks most rows (ties: fewer rows, then train, validation, test).

    The stratum of a cluster is its most frequent one; strata with fewer than three clusters use the hash of the cluster. The fold is sequential inside a
    part of a stratum; ``parts`` deals a stratum in that many independent parts by hash, each with its own targets, so that no task
    holds a stratum of any size.
    """
    modes = group_mode(df, [cluster], stratum, "stratum")
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    order = F.sha1(F.concat(F.lit(f"{seed}|"), F.col(cluster).cast("string")))
    table = attach(sizes, modes, [cluster]).select(F.col(cluster).cast("string").alias("cluster"), "n", "stratum", order.alias("o"), (F.pmod(F.xxhash64(cluster), F.lit(parts))).cast("int").alias("part"))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["o", "cluster"])
        return pd.DataFrame({"cluster": frame["cluster"], "dealt": _deal(frame, float(frame["n"].sum()), ratios) if len(frame) >= 3 else None})

    dealt = table.groupBy("stratum", "part").applyInPandas(fold, "cluster string, dealt string")
    rule = bucket_split(hash_bucket(F.concat(F.lit(f"{name}:"), F.col("cluster"))))
    dealt = dealt.select("cluster", F.coalesce("dealt", rule).alias(name))
    return attach(df.withColumn("_c", F.col(cluster).cast("string")), dealt.withColumnRenamed("cluster", "_c"), ["_c"]).drop("_c")


def carve_validation(df: DataFrame, unit: str, label: str | None = None, share: float = 0.15, seed: int = 42, mode: str = "cluster") -> DataFrame:
    """``df`` with ``internal_split``: about ``share`` of the units (clusters or rows) of each label are validation, the first by hash.

    Modes: ``cluster`` (stratified by majority label), ``group`` (clusters without strata), ``row`` (rows by label; ``unit`` is the row id), ``none``.
    The share is cut by hash value, so that nothing is ordered.
    """
    if mode == "none":
        return df.withColumn("internal_split", F.lit(SPLITS[0]))
    salt = F.lit(f"{seed}|") if mode == "group" or not label else F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("_label"), F.lit("")), F.lit("|"))
    held = df
    if label and mode != "group":
        held = df.join(group_mode(df, [unit], label, "_label"), unit, "left") if mode == "cluster" else df.withColumn("_label", F.col(label).cast("string"))
    chosen = hash_bucket(F.concat(salt, F.col(unit).cast("string")), 10_000) < int(share * 10_000)
    return held.withColumn("internal_split", F.when(chosen, SPLITS[1]).otherwise(SPLITS[0])).drop("_label")


def exact_carve(df: DataFrame, key: str, label: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """``df`` with exactly the rounded share of each label as validation, by ranked hash."""
    h = F.sha1(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    # the first 15 hex digits, spread over all 64-bit numbers, order as the digest does; the digest itself decides ties
    ranked = bucketed_running(df.withColumn("_g", F.coalesce(F.col(label).cast("string"), F.lit(""))).withColumn("_d", h).withColumn("_h", hex_order("_d")), "_g", "_h", "_d", total="_all", name="_r")
    return ranked.withColumn("internal_split", F.when(F.col("_r") <= F.round(F.col("_all") * share), SPLITS[1]).otherwise(SPLITS[0])).drop("_g", "_d", "_h", "_all", "_r")
