"""Joins and ranks that stay spread out when one key holds a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Heavy keys that one sketch reports at most, and values it tracks: any key with more than a thousandth of the rows is among them.
TOP_KEYS, TRACKED = 1_000, 10_000
#: Rows below which no key is hot.
LEAST_ROWS = 1_000


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_shares(df: DataFrame, key: Column | str) -> dict:
    """Values of ``key`` (null included) that hold more rows than a quarter of a shuffle partition's share, with their shares of all rows.

    One pass with a heavy-hitters sketch, which is combined before the shuffle: no key is grouped or counted in one task, and at most ``TOP_KEYS`` values come back.
    """
    column = F.col(f"`{key}`") if isinstance(key, str) else key
    found = df.select(column.alias("k")).agg(F.expr(f"approx_top_k(k, {TOP_KEYS}, {TRACKED})").alias("top"), F.count("*").alias("n")).first()
    bound = max(LEAST_ROWS, found["n"] / (4 * _partitions(df)))
    return {r["item"]: r["count"] / found["n"] for r in found["top"] or [] if r["count"] > bound}


def hot_keys(df: DataFrame, key: Column | str) -> list:
    """The values of ``hot_shares``."""
    return list(hot_shares(df, key))


def _salts(df: DataFrame, hot: dict) -> int:
    """Parts of a hot key, so that a part of the hottest has about the rows of a shuffle partition."""
    return max(2, math.ceil(max(hot.values()) * _partitions(df)) + 1)


def _parts(df: DataFrame, is_hot: Column, salts: int) -> tuple[Column, Column]:
    """The part of a row of the big side, and the parts of a row of the small side."""
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int")
    return F.when(is_hot, part).otherwise(F.lit(0)), F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))


def lookup(big: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small``, which has each ``key`` at most once.

    The rows of hot keys of ``big`` are dealt to parts and the one matching row of ``small`` is
    repeated for each part, so no task receives a whole hot key. ``how`` is inner or left. Null keys match nothing; in a left join they are dealt to parts too.
    """
    if how == "inner":
        big = big.where(F.col(f"`{key}`").isNotNull())
    hot = hot_shares(big, key)
    if not hot:
        return big.join(small, key, how)
    values = [k for k in hot if k is not None]
    is_hot = F.coalesce(F.col(f"`{key}`").isin(values), F.lit(None in hot))
    left, right = _parts(big, is_hot, _salts(big, hot))
    return big.withColumn("_part", left).join(small.withColumn("_part", F.explode(right)), [key, "_part"], how).drop("_part")


def permuted(*cols: str | Column, seed: int = 42) -> Column:
    """A reproducible pseudo-random order: a 64-bit hash of ``cols`` and ``seed``."""
    return F.xxhash64(F.lit(seed), *cols)


def hex_order(digest: str) -> Column:
    """A 64-bit number that orders as a hex digest does (by its first 15 digits), over the whole signed range."""
    top = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")  # 60 bits
    return (top - F.lit(1 << 59)) * 16


def bucketed_running(df: DataFrame, group: str, order: str, tie: str, weight: Column | None = None, buckets: int | None = None, total: str | None = None, name: str = "rank") -> DataFrame:
    """Running sum of ``weight`` (or rank from 1) inside ``group`` by the uniform 64-bit hash column ``order``.

    The hash range is cut into ``buckets`` equal intervals (unset: 64 or, if greater, as many as shuffle partitions). Only an interval of a group is ever ordered in one
    task; the sums of the intervals before it (groups x buckets rows) are added afterwards. ``total`` adds the
    sum over the whole group under that name. Ties of the hash are ordered by ``tie``.
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight
    buckets = buckets or max(64, _partitions(df))
    slot = F.floor((F.col(order) / F.lit(2.0**64) + F.lit(0.5)) * buckets).cast("int")
    held = df.withColumn("_w", weight).withColumn("_slot", F.least(slot, F.lit(buckets - 1)))
    sums = held.groupBy(group, "_slot").agg(F.sum("_w").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    if total:
        sums = sums.withColumn(total, F.sum("_sum").over(Window.partitionBy(group)))
    inside = Window.partitionBy(group, "_slot").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    ranked = held.withColumn("_in", F.sum("_w").over(inside))
    return ranked.join(sums.drop("_sum"), [group, "_slot"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_w", "_slot", "_in", "_before")


def attach(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``small``, which has each combination of ``keys`` at most once; null equals null.

    Hot combinations, nulls among them, are dealt to parts by the hash of their values.
    """
    renamed = small.select(*[F.col(f"`{k}`").alias(f"_k{n}") for n, k in enumerate(keys)], *[F.col(f"`{c}`") for c in small.columns if c not in keys])
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]
    hashed = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    hot = hot_shares(df, hashed)
    if hot:
        salts = _salts(df, hot)
        df = df.withColumn("_part", _parts(df, hashed.isin(list(hot)), salts)[0])
        parts = _parts(df, F.xxhash64(*[F.col(f"_k{n}") for n in range(len(keys))]).isin(list(hot)), salts)[1]
        renamed = renamed.withColumn("_of", F.explode(parts))
        same.append(F.col("_part") == F.col("_of"))
    return df.join(renamed, same, "left").drop("_part", "_of", *[f"_k{n}" for n in range(len(keys))])
