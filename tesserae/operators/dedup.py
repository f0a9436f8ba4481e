"""Keep-first and keep-latest, duplicate flags and text clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.skew import attach
from tesserae.session import cut_lineage


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per ``keys``: the first by ``order``, which must be given (null keys are a key of their own).

    A row is the minimum of its order columns, found by an aggregate that combines before the shuffle, so that a hot key is no problem. ``order`` must be
    ascending expressions of orderable types.
    """
    if not order:
        raise ValueError("keep_first needs an order")
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order))
    return df.groupBy(*keys).agg(row.alias("_row")).select(*[F.col(f"`{c}`") if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def keep_latest(df: DataFrame, key: str, date: str, tie: str) -> DataFrame:
    """One row per ``key``: the greatest ``date`` (nulls last), then the smallest ``tie``."""
    rest = [c for c in df.columns if c != key]
    rank = F.struct(F.col(date).isNotNull(), F.col(date), -F.col(tie))
    row = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), rank)
    return df.groupBy(key).agg(row.alias("_row")).select(*[F.col(key) if c == key else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def duplicate_flag(df: DataFrame, keys: list[str], order: list[Column], name: str = "duplicate_flag") -> DataFrame:
    """``df`` with 1 on every row but the first of its ``keys`` by ``order`` (which must be unique inside a key), else 0."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return attach(df, first, keys).withColumn(name, (F.struct(*order) != F.col("_first")).cast("int")).drop("_first")


def add_cluster_size(df: DataFrame, cluster: str, member: str) -> DataFrame:
    """``df`` with the number of distinct ``member`` in its cluster and a 0/1 flag for clusters of several."""
    sizes = df.groupBy(cluster).agg(F.count_distinct(member).alias("cluster_size"))
    return attach(df, sizes, [cluster]).withColumn("duplicate_text_cluster_flag", (F.col("cluster_size") > 1).cast("int"))


def joined_sample(df: DataFrame, cluster: str, member: str, limit: int, name: str, sep: str = "|") -> DataFrame:
    """``(cluster, name)``: the first ``limit`` distinct non-blank members of each cluster in order, joined; if there are more, ``...`` at the end.

    Only the first members of each cluster leave a partition and are put together, whatever its size.
    """
    text = F.col(member).cast("string")
    members = df.select(cluster, text.alias("_m")).where(F.trim("_m") != "").distinct()
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy(cluster).orderBy("_m"))).where(F.col("_r") <= limit + 1)
    held = first.groupBy(cluster).agg(F.array_sort(F.collect_list("_m")).alias("_v"))
    return held.select(cluster, F.concat(F.array_join(F.slice("_v", 1, limit), sep), F.when(F.size("_v") > limit, F.lit(sep + "...")).otherwise("")).alias(name))


def cluster_report(df: DataFrame, cluster: str, member: str, title: str, year: str, order: str, limit: int = 10) -> DataFrame:
    """Clusters of several members: members, rows, first title by ``order``, first and last year, joined member ids."""
    df = cut_lineage(df.select(*dict.fromkeys([cluster, member, title, year, order])))  # read twice, and much smaller than the texts it is made of
    report = df.groupBy(cluster).agg(F.count_distinct(member).alias("n_members"), F.count("*").alias("n_rows"), F.min_by(title, order).alias("first_title"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    ids = joined_sample(df, cluster, member, limit, "member_ids")
    return report.where("n_members > 1").join(ids, cluster, "left").withColumn("member_ids", F.coalesce("member_ids", F.lit("")))


def representatives(df: DataFrame, cluster: str, year: str, key: str) -> DataFrame:
    """One row per cluster: the earliest year (nulls last), then the smallest key."""
    return keep_first(df, [cluster], [F.col(year).isNull(), F.col(year), F.col(key)])


def cluster_span(df: DataFrame, cluster: str, year: str) -> DataFrame:
    """``df`` with rows, first and last year of its cluster."""
    span = df.groupBy(cluster).agg(F.count("*").alias("cluster_rows"), F.min(year).alias("cluster_min_year"), F.max(year).alias("cluster_max_year"))
    return attach(df, span, [cluster])


def ranked(df: DataFrame, groups: list[str], score: str, ties: list[str]) -> DataFrame:
    """``df`` with its rank by falling ``score`` inside ``groups``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(F.col(score).desc_nulls_last(), *ties)))


def row_ids(df: DataFrame, order: list[str], prefix: str, width: int, name: str) -> DataFrame:
    """``df`` with ids ``<prefix><number>`` in the order of ``order`` (unique), numbered by ranges without a single-task sort."""
    from tesserae.operators.order import global_row_number

    numbered = global_row_number(df, order, "_n")
    return numbered.withColumn(name, F.concat(F.lit(prefix), F.lpad(F.col("_n").cast("string"), width, "0"))).drop("_n")
