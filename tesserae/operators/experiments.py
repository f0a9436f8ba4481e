"""The experiment matrix, node features and comparison of outputs."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.numeric import minmax, multi_hot, one_hot, safe_log1p
from tesserae.operators.reports import table_digest, top_values


def run_matrix(spark: SparkSession, cells: list[dict], run: Callable[[dict], dict], parallel: int = 4) -> DataFrame:
    """One row per cell (target, split, model ...): its settings, the metrics that ``run`` gives, and ``error`` if it failed.

    Cells are independent jobs of one session; ``parallel`` of them run at a time.
    """
    def one(cell: dict) -> dict:
        try:
            return {**cell, **run(cell), "error": None}
        except Exception as e:  # a failed cell must not lose the others
            return {**cell, "error": str(e)[:500]}

    with ThreadPoolExecutor(parallel) as pool:
        rows = list(pool.map(one, cells))
    names = list(dict.fromkeys(k for r in rows for k in r))
    kind = lambda n: "double" if any(isinstance(r.get(n), (int, float)) for r in rows) else "string"
    cast = lambda n, v: None if v is None else float(v) if kind(n) == "double" else str(v)
    return spark.createDataFrame([tuple(cast(n, r.get(n)) for n in names) for r in rows], ", ".join(f"`{n}` {kind(n)}" for n in names))


def evaluation_rows(results: DataFrame, split_value: str = "evaluated_on", wanted: str = "test") -> DataFrame:
    """Results measured on the evaluation split."""
    return results.where(F.lower(F.trim(F.col(split_value))) == wanted)


def award_node_features(awards: DataFrame, key: str, year: str, amounts: list[str], categories: list[str], code_col: str | None = None, top: int = 20) -> DataFrame:
    """Numeric node features: scaled year, log amounts, one-hot of the most frequent categories, multi-hot of the most frequent codes with a rest.

    Frequent values are the first ``top`` by count, ties by value; the driver sees these names only.
    """
    out = minmax(awards, [year])
    cols = [F.col(f"{year}_scaled").alias("x_year"), *[safe_log1p(a).alias(f"x_{a}_log1p") for a in amounts]]
    for c in categories:
        cols += one_hot(c, [r["value"] for r in top_values(awards, c, top).collect()], f"x_{c}")
    if code_col:
        listed = [r["value"] for r in top_values(awards.select(F.explode(code_col).alias("code")), "code", top).collect()]
        cols += multi_hot(code_col, listed, f"x_{code_col}")
    return out.select(key, *cols)


def with_text_features(nodes: DataFrame, key: str, vectors: DataFrame, vector: str, dim: int) -> DataFrame:
    """Node features with an array of text values, zeros and ``has_text_embedding`` = 0 where there are none."""
    joined = nodes.join(vectors.select(key, vector), key, "left")
    return joined.withColumn("has_text_embedding", F.col(vector).isNotNull().cast("int")).withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0.0).cast("float"), dim)))


def same_tables(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables have the same rows, in any order."""
    return sorted(left.columns) == sorted(right.columns) and table_digest(left).first() == table_digest(right).first()
