"""Named queries over the test tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder as DataFrames: ``t.orders``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        short = {"awards": "cleaned_nsf_awards_2000_2025", "flagged": "nsf_awards_with_methodology_flags", "edges": "award_pi_edges", "benchmark": "methodkg_labeled_benchmark_v3_modeling"}
        return self.spark.read.parquet(f"{self.folder}/{short.get(name, name)}.parquet")


def query(sql: str | None = None) -> Callable:
    """Registers a function of ``Tables`` under its name, with its SQL if SQL can say the same."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE[f.__name__] = sql.replace("$awards", "cleaned_nsf_awards_2000_2025").replace("$flagged", "nsf_awards_with_methodology_flags").replace("$edges", "award_pi_edges").replace("$benchmark", "methodkg_labeled_benchmark_v3_modeling")
        return f

    return register


def load() -> None:
    """Imports the modules that register queries."""
    from tesserae.plans import feature_queries, graph_queries, model_queries, report_queries, source_queries, split_queries, text_queries  # noqa: F401


load()
