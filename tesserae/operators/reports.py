"""Aggregates and reports: counts in order, long-form quality reports, label rules, agreement of annotators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.lexicons import VOCABULARY
from tesserae.operators.skew import attach


def value_counts(df: DataFrame, col: str, order: str) -> DataFrame:
    """``(value, n)`` by falling count, then by first appearance in ``order``; null is a value."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("n"), F.asc("_first")).drop("_first")


def group_mode(df: DataFrame, groups: list[str], col: str, name: str, default: str = "unknown") -> DataFrame:
    """The most frequent non-blank value per group, of ties the smallest; ``default`` if there is none."""
    value = F.when(F.trim(F.col(col).cast("string")) != "", F.col(col).cast("string"))
    counts = df.select(*groups, value.alias("_v")).groupBy(*groups, "_v").agg(F.count("_v").alias("_n"))
    least = counts.groupBy(*groups).agg(F.max("_n").alias("_top"))
    top = attach(counts, least, groups).where("_n = _top")
    return top.groupBy(*groups).agg(F.coalesce(F.min("_v"), F.lit(default)).alias(name))


def any_in_group(df: DataFrame, group: str, rule: Column, name: str) -> DataFrame:
    """``df`` with 1 where any row of its group fulfils ``rule``, else 0."""
    flags = df.groupBy(group).agg(F.max(F.coalesce(rule.cast("int"), F.lit(0))).alias(name))
    return attach(df, flags, [group])


def long_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column, value, n)`` of every listed column, unpivoted in one scan; null values are ``<null>``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("<null>")).alias("value")) for c in cols])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def quality_report(df: DataFrame, key: str, text: list[str], numbers: list[str], categories: list[str]) -> DataFrame:
    """``(section, metric, value)``: rows and distinct keys, missing values, number summaries (mean, median, range) and value counts.

    Two scans: one wide aggregate, one for all counts.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")) == "", F.lit(True))
    wide: dict[tuple[str, str], Column] = {("rows", "n_rows"): F.count("*"), ("rows", f"distinct_{key}"): F.count_distinct(key)}
    wide |= {("missing", c): F.count_if(blank(c)) for c in [*text, *categories]} | {("missing", c): F.count_if(F.col(c).isNull()) for c in numbers}
    for c in numbers:
        wide |= {("numbers", f"{c}_{n}"): f(c) for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))}
    names = list(wide)
    one = df.agg(*[e.cast("double").alias(f"m{k}") for k, e in enumerate(wide.values())])
    rows = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(f"m{k}").alias("value")) for k, (s, m) in enumerate(names)])
    long = one.select(F.explode(rows).alias("r")).select("r.*")
    counts = long_counts(df, categories).select(F.concat(F.lit("counts_"), F.col("column")).alias("section"), F.col("value").alias("metric"), F.col("n").cast("double").alias("value"))
    return long.unionByName(counts)


def feature_manifest(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``(feature, dtype, n_missing, n_unique)`` of every column, in one scan; ``approximate`` counts distinct values by sketch."""
    unique = F.approx_count_distinct if approximate else F.count_distinct
    one = df.agg(*[e for k, c in enumerate(df.columns) for e in (F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}"), unique(F.col(f"`{c}`")).alias(f"u{k}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(t).alias("dtype"), F.col(f"n{k}").alias("n_missing"), F.col(f"u{k}").alias("n_unique")) for k, (c, t) in enumerate(df.dtypes)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def drop_all_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` without those of ``cols`` that hold no value at all."""
    if not cols:
        return df
    seen = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(cols)]).first()
    return df.drop(*[c for k, c in enumerate(cols) if not seen[k]])


def label_rules() -> list[tuple[Column, str, str, str]]:
    """The row rules of label tables as (condition, type, severity, message); a blank label raises "missing" and "invalid"."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    out = []
    for name, allowed in VOCABULARY.items():
        out.append((c(name) == "", f"missing_{name}", "error", f"{name} is missing"))
        out.append((~c(name).isin(allowed), f"invalid_{name}", "error", f"{name} is not an allowed value"))
    cls, qual, quant = c("label_mmr_class"), c("label_qual_signal"), c("label_quant_signal")
    design, design_type, joint, joint_type = c("label_design_present"), c("label_design_type"), c("label_integration_present"), c("label_integration_type")
    named = lambda col: ~col.isin("none", "unclear")
    return [
        *out,
        ((design == "yes") & (design_type == "none"), "design_yes_type_none", "error", "a design is present but has no type"),
        ((design == "no") & named(design_type), "design_no_type_real", "error", "no design is present but it has a type"),
        ((joint == "yes") & (joint_type == "none"), "integration_yes_type_none", "error", "integration is present but has no type"),
        ((joint == "no") & named(joint_type), "integration_no_type_real", "error", "no integration is present but it has a type"),
        ((cls == "qual_only") & (quant == "yes"), "qual_only_with_quant_yes", "error", "qualitative class with quantitative signal"),
        ((cls == "quant_only") & (qual == "yes"), "quant_only_with_qual_yes", "error", "quantitative class with qualitative signal"),
        ((cls == "no_method_signal") & ((qual == "yes") | (quant == "yes") | (design == "yes") | (joint == "yes")), "no_method_signal_with_method_label", "error", "class without method but a method label is yes"),
        ((cls == "implicit_mmr") & (qual != "yes"), "implicit_mmr_without_qual_yes", "error", "implicit class without qualitative signal"),
        ((cls == "implicit_mmr") & (quant != "yes"), "implicit_mmr_without_quant_yes", "error", "implicit class without quantitative signal"),
        ((cls == "explicit_mmr") & (qual != "yes"), "explicit_mmr_without_qual_yes", "review", "explicit class without qualitative signal"),
        ((cls == "explicit_mmr") & (quant != "yes"), "explicit_mmr_without_quant_yes", "review", "explicit class without quantitative signal"),
        ((c("label_reporting_completeness") == "high") & cls.isin("no_method_signal", "unclear"), "high_reporting_without_method_signal", "review", "full reporting without a method class"),
    ]


def rule_issues(df: DataFrame, rules: list[tuple[Column, str, str, str]], keep: list[str]) -> DataFrame:
    """One row per broken rule: ``issue_type, severity, message`` and the columns ``keep``. All rules are tested in one scan."""
    issues = F.array(*[F.when(cond, F.struct(F.lit(t).alias("issue_type"), F.lit(s).alias("severity"), F.lit(m).alias("message"))) for cond, t, s, m in rules])
    held = df.select(*keep, F.explode(F.filter(issues, lambda x: x.isNotNull())).alias("_i"))
    return held.select("_i.*", *keep)


def issue_pivot(df: DataFrame, issues: DataFrame, key: str, severities: list[str] = ("error", "review")) -> DataFrame:
    """``df`` with the number of issues per severity, 0 where there are none."""
    counts = issues.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in severities])
    return df.join(counts, key, "left").na.fill(0, [f"n_{s}" for s in severities])


def outside_vocabulary(df: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """``(column, value, n)`` of values that are not in the column's vocabulary; null is not reported."""
    spark = df.sparkSession
    allowed = spark.createDataFrame([(c, v) for c, vs in vocabulary.items() for v in vs], "column string, value string")
    return long_counts(df, list(vocabulary)).where("value <> '<null>'").join(allowed, ["column", "value"], "left_anti")


def agreement(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """``(label, n, agreement, kappa)`` of two annotators per label, over rows where both gave a value; kappa is null if chance alone agrees fully.

    The joint table of all labels is counted in one scan; marginals are summed from it.
    """
    text = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    rows = F.array(*[F.struct(F.lit(name).alias("label"), text(a).alias("a"), text(b).alias("b")) for name, (a, b) in pairs.items()])
    joint = df.select(F.explode(rows).alias("r")).select("r.*").where("a is not null and b is not null").groupBy("label", "a", "b").agg(F.count("*").alias("n"))
    total = joint.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left = joint.groupBy("label", F.col("a").alias("v")).agg(F.sum("n").alias("na"))
    right = joint.groupBy("label", F.col("b").alias("v")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, ["label", "v"]).groupBy("label").agg(F.sum(F.col("na") * F.col("nb")).alias("x"))
    out = total.join(chance, "label", "left").withColumn("p", F.col("same") / F.col("n")).withColumn("e", F.coalesce("x", F.lit(0)) / (F.col("n") * F.col("n")))
    kappa = F.when(F.col("e") != 1, F.round((F.col("p") - F.col("e")) / (1 - F.col("e")), 4))
    return out.select("label", "n", F.round("p", 4).alias("agreement"), kappa.alias("kappa"))


def split_summary(df: DataFrame, split_cols: list[str], counts: dict[str, Column]) -> DataFrame:
    """``(split_column, split, n_rows, <counts>)``: conditional counts per split column and value, in one scan."""
    rows = F.array(*[F.struct(F.lit(c).alias("split_column"), F.col(c).alias("split")) for c in split_cols])
    flags = {name: F.coalesce(rule.cast("int"), F.lit(0)) for name, rule in counts.items()}
    long = df.select(F.explode(rows).alias("s"), *[e.alias(n) for n, e in flags.items()])
    return long.groupBy("s.split_column", "s.split").agg(F.count("*").alias("n_rows"), *[F.sum(n).alias(n) for n in flags])


def leakage_report(df: DataFrame, split_cols: list[str], keys: list[str]) -> DataFrame:
    """``(split_column, key, n_groups, n_crossing, n_rows_crossing)``: groups of rows with one key value that lie in several splits.

    A null key is a group; null splits don't count. Every pair of split column and key is audited in one scan. Counts are combined per
    (pair, value, split) before groups meet, so a key value with very many rows is no more than a few rows there.
    """
    pairs = F.array(*[F.struct(F.lit(s).alias("split_column"), F.lit(k).alias("key"), F.col(s).cast("string").alias("split"), F.col(k).cast("string").alias("value")) for s in split_cols for k in keys])
    cells = df.select(F.explode(pairs).alias("p")).groupBy("p.split_column", "p.key", "p.value", "p.split").agg(F.count("*").alias("n"))
    groups = cells.groupBy("split_column", "key", "value").agg(F.sum("n").alias("n"), F.count("split").alias("n_splits"))
    crossing = (F.col("n") > 1) & (F.col("n_splits") > 1)
    return groups.groupBy("split_column", "key").agg(F.count("*").alias("n_groups"), F.count_if(crossing).alias("n_crossing"), F.sum(F.when(crossing, F.col("n")).otherwise(0)).alias("n_rows_crossing"))


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values with their counts; ties by value."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def coverage(df: DataFrame, sets: dict[str, str]) -> DataFrame:
    """``(entity, n_covered, n_rows)`` of array columns: rows with at least one item."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.size(c) > 0).alias(name) for name, c in sets.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("entity"), F.col(name).alias("n_covered"), F.col("n").alias("n_rows")) for name in sets])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def match_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(n_left, n_right, n_both, n_left_only, n_right_only)`` of the distinct non-null keys of two tables."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count("_l").alias("n_left"), F.count("_r").alias("n_right"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_both"), F.count_if(F.col("_r").isNull()).alias("n_left_only"), F.count_if(F.col("_l").isNull()).alias("n_right_only"))


def table_digest(df: DataFrame) -> DataFrame:
    """``(n_rows, digest)``: a digest of the rows that does not depend on their order or on files; equal tables have equal digests.

    Each row's values as text (nested ones as JSON, null with a sign of its own), in the order of the column names, are put through SHA-256; two parts of the hashes are added up.
    """
    nested = {c for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))}
    value = lambda c: F.to_json(F.col(f"`{c}`")) if c in nested else F.col(f"`{c}`").cast("string")
    row = F.sha2(F.concat_ws("|", *[F.coalesce(value(c), F.lit("∅")) for c in sorted(df.columns)]), 256)
    part = lambda at: F.sum(F.conv(F.substring("h", at, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return df.select(row.alias("h")).agg(F.count("*").alias("n_rows"), F.concat_ws(":", part(1), part(13)).alias("digest"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
