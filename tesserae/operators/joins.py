"""Validated and coalescing joins, corpus unions, feature fusion and column selection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import award_key, column_name
from tesserae.operators.dedup import keep_first


def prefer_left(left: str, right: str) -> Column:
    """The left value unless it is null or blank, else the right one."""
    return F.coalesce(F.when(F.trim(F.col(left).cast("string")) != "", F.col(left)), F.col(right))


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[Column], suffix: str = "_right") -> DataFrame:
    """``left`` with the columns of the first row of ``right`` per key by ``order``; clashing names get ``suffix``."""
    one = keep_first(right.where(F.col(key).isNotNull()), [key], order)
    return left.join(one.select(key, *[F.col(c).alias(c + suffix if c in left.columns else c) for c in one.columns if c != key]), key, "left")


def check_unique(df: DataFrame, key: str, what: str) -> None:
    """Raises if a non-null key occurs twice."""
    twice = df.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: {key} {twice[0][0]!r} occurs {twice[0]['count']} times")


def one_to_one(left: DataFrame, right: DataFrame, key: str, fill: float = 0.0) -> DataFrame:
    """Left join that raises on a repeated key on either side; missing numbers become ``fill``, marked by ``embedding_missing``.

    Array columns stay null where they are missing.
    """
    check_unique(left, key, "left side")
    check_unique(right, key, "right side")
    marked = right.withColumn("_there", F.lit(1))
    out = left.join(marked, key, "left").withColumn("embedding_missing", F.when(F.col("_there") == 1, 0).otherwise(1)).drop("_there")
    numbers = [c for c, t in right.dtypes if c != key and t in ("int", "bigint", "float", "double")]
    return out.na.fill(fill, numbers)


def align_vectors(nodes: DataFrame, vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``nodes`` with their vector, or zeros with ``embedding_missing`` = 1. Repeated vectors of a key: the first by content."""
    one = keep_first(vectors.select(key, vector), [key], [F.col(vector)])
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    out = nodes.join(one, key, "left")
    return out.withColumn("embedding_missing", F.col(vector).isNull().cast("int")).withColumn(vector, F.coalesce(vector, zeros))


#: Names, beginnings and parts of names of columns that would give the target away. Fixed values.
LEAKY_NAMES = {"award_id", "benchmark_id", "annotation_id", "title_clean", "abstract_clean", "project_text_id", "project_cluster_id", "person_id", "institution_id", "pi_clean", "organization_clean"}
LEAKY_STARTS = ("label_", "target_", "split_", "y_", "pred", "score_")
LEAKY_PARTS = ("candidate", "annotator", "stratum")


def is_leaky(name: str) -> bool:
    return name in LEAKY_NAMES or name.startswith(LEAKY_STARTS) or any(p in name for p in LEAKY_PARTS)


def column_roles(df: DataFrame, keep: set[str]) -> list[tuple[str, str]]:
    """``(column, role)``: identifier, target, split, leakage, text, feature or other, by allow-list and name."""
    role = lambda c: "target" if c.startswith("target_") else "split" if c.startswith("split_") else "label" if c.startswith("label_") else "identifier" if c.endswith("_id") else "text" if c.endswith("_clean") else "feature" if c in keep or c.startswith(("g_", "m_", "cat_")) else "leakage" if is_leaky(c) else "other"
    return [(c, role(c)) for c in df.columns]


def safe_columns(df: DataFrame, allowed: list[str], optional: str | None = None, after: str | None = None) -> DataFrame:
    """The allowed columns that exist, in the order of the list; ``optional`` is put behind ``after``."""
    cols = [c for c in allowed if c in df.columns]
    if optional and optional in df.columns:
        cols.insert(cols.index(after) + 1 if after in cols else len(cols), optional)
    return df.select(*cols)


def drop_generated(df: DataFrame, names: list[str], prefixes: list[str]) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in names or c.startswith(tuple(prefixes))])


def canonical_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``<x>_name`` columns take the place of ``<x>``; aliases are renamed where their target is absent."""
    for c in df.columns:
        base = c.removesuffix("_name")
        if c != base and base.startswith("label_"):
            df = df.withColumn(base, F.col(c)).drop(c)
    for old, new in (aliases or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def select_features(df: DataFrame, prefixes: tuple[str, ...] = ("g_", "m_", "cat_"), allow: list[str] | None = None) -> list[str]:
    """Feature columns by prefix or allow-list, without leaky ones, each once in order."""
    wanted = [c for c in (allow or df.columns) if c in df.columns and (allow or c.startswith(prefixes)) and not is_leaky(c)]
    return list(dict.fromkeys(wanted))


def feature_table(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """A feature file ready for fusion: matched key, no leaky columns, prefixed names, one row per key."""
    cols = [c for c in df.columns if c != key and not is_leaky(c)]
    named = df.select(award_key(key, "match").alias("match_key"), *[F.col(f"`{c}`").alias(column_name(c, prefix)) for c in cols]).where("match_key <> ''")
    return keep_first(named, ["match_key"], [F.to_json(F.struct(*[c for c in named.columns if c != "match_key"]))])


def fuse(base: DataFrame, key: str, tables: dict[str, DataFrame], own_key: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """``base`` joined to every feature table by matched key; the second result maps each table to its columns."""
    out, groups = base.withColumn("match_key", award_key(key, "match")), {}
    for name, table in tables.items():
        ready = feature_table(table, own_key, f"{name}__")
        groups[name] = [c for c in ready.columns if c != "match_key"]
        out = out.join(ready, "match_key", "left")
    return out.drop("match_key"), groups


def union_corpus(corpus: DataFrame, extra: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """All corpus rows, filled from ``extra`` where they are blank, and the rows of ``extra`` without match; ``source`` says corpus, both or extra.

    Keys are compared without leading zeros and wrappers; of repeated keys the first row by content stays.
    """
    def side(df: DataFrame) -> DataFrame:
        rows = df.select(award_key(key, "match").alias("_k"), key, *cols).where("_k <> ''")
        return keep_first(rows, ["_k"], [F.to_json(F.struct(key, *cols))])

    a, b = side(corpus), side(extra)
    both = a.select("_k", *[F.col(c).alias(f"l_{c}") for c in [key, *cols]]).join(b.select("_k", *[F.col(c).alias(f"r_{c}") for c in [key, *cols]]), "_k", "full_outer")
    source = F.when(F.col(f"r_{key}").isNull(), "corpus").when(F.col(f"l_{key}").isNull(), "extra").otherwise("both")
    return both.select(*[prefer_left(f"l_{c}", f"r_{c}").alias(c) for c in [key, *cols]], source.alias("source"))


def longest_text(parts: list[DataFrame], key: str, text: str) -> DataFrame:
    """``(key, text)``: of all tables the longest text per key; ties by content."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, [p.select(key, text) for p in parts]).where(F.col(key).isNotNull())
    best = F.max_by(F.coalesce(F.col(text), F.lit("")), F.struct(F.length(F.coalesce(F.col(text), F.lit(""))), F.coalesce(F.col(text), F.lit(""))))
    return rows.groupBy(key).agg(best.alias(text))


def usable_target(df: DataFrame, target: str, invalid: list[str] = ("", "nan", "none", "null", "unclear", "unknown")) -> DataFrame:
    """Rows whose target says something."""
    value = F.lower(F.trim(F.col(target).cast("string")))
    return df.where(value.isNotNull() & ~value.isin(list(invalid)))


def numeric_like(df: DataFrame, cols: list[str], share: float = 0.95) -> list[str]:
    """Those of ``cols`` whose non-blank values are numbers in more than ``share`` of the cases; one scan."""
    if not cols:
        return []
    text = {c: F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in cols}
    row = df.agg(*[F.avg(F.when(e.isNotNull(), e.try_cast("double").isNotNull().cast("int"))).alias(f"n{k}") for k, e in enumerate(text.values())]).first()
    return [c for k, c in enumerate(cols) if row[k] is not None and row[k] > share]


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    return [c for c in needed if c not in df.columns]


def require_columns(df: DataFrame, needed: list[str], what: str = "table") -> DataFrame:
    missing = missing_columns(df, needed)
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def natural_key(name: str) -> list:
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", name)]
