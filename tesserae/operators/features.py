"""TF-IDF and preprocessing of mixed features."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import ascii_fold


def terms(df: DataFrame, key: str, text: str, ngrams: int = 2) -> DataFrame:
    """``(key, term, tf)``: words of two or more letters, digits or underscores and their n-grams, lower case, without accents."""
    words = F.filter(F.split(F.lower(ascii_fold(text)), r"[^a-z0-9_]+"), lambda w: F.length(w) >= 2)
    held = df.select(key, words.alias("w"))
    grams = [F.col("w"), *[_ngrams(n) for n in range(2, ngrams + 1)]]
    return held.select(key, F.explode(F.concat(*grams)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _ngrams(n: int):
    places = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice("w", i, n), " "))


def tfidf(df: DataFrame, key: str, text: str, ngrams: int = 2, min_df: int = 2, max_terms: int = 100_000) -> DataFrame:
    """``(key, term, weight)``: (1 + ln tf) x (ln((1 + n) / (1 + df)) + 1), each text scaled to length 1.

    Terms occur in ``min_df`` texts at least; of these the ``max_terms`` most frequent in the corpus are kept (ties by term), as the
    vocabulary size is a parameter of the operator. Null and empty texts have no row but count in n.
    """
    counts = terms(df, key, text, ngrams)
    vocabulary = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(max_terms)
    n = df.count()
    weighted = counts.join(vocabulary, "term").withColumn("w", (1 + F.log("tf")) * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1))
    norms = weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def bucket_rare(df: DataFrame, cols: list[str], min_frequency: int = 2, other: str = "__rare__", missing: str = "__missing__") -> DataFrame:
    """``df`` with blank categories as ``missing`` and categories of fewer than ``min_frequency`` rows as ``other``."""
    for c in cols:
        df = df.withColumn(c, F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(missing)))
        counts = df.groupBy(c).agg(F.count("*").alias("_n"))
        df = df.join(counts, c).withColumn(c, F.when(F.col("_n") < min_frequency, other).otherwise(F.col(c))).drop("_n")
    return df


def preprocessing(numbers: list[str], categories: list[str], center: bool = True, fill: str = "median", out: str = "features") -> Pipeline:
    """Stages for mixed features: numbers imputed and scaled, categories one-hot with unseen values kept apart, all in one vector."""
    stages: list = []
    parts: list[str] = []
    if numbers:
        stages += [Imputer(strategy=fill, inputCols=numbers, outputCols=[f"{c}__imp" for c in numbers]), VectorAssembler(inputCols=[f"{c}__imp" for c in numbers], outputCol="_numbers", handleInvalid="keep"), StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=center, withStd=True)]
        parts.append("_scaled")
    if categories:
        stages += [StringIndexer(inputCols=categories, outputCols=[f"{c}__ix" for c in categories], handleInvalid="keep", stringOrderType="frequencyDesc"), OneHotEncoder(inputCols=[f"{c}__ix" for c in categories], outputCols=[f"{c}__oh" for c in categories], handleInvalid="keep", dropLast=False)]
        parts += [f"{c}__oh" for c in categories]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol=out, handleInvalid="keep")])


def expand_vector(df: DataFrame, vector: str, dim: int, prefix: str = "emb_", width: int = 3) -> DataFrame:
    """``df`` with an array column as ``dim`` columns ``<prefix>000`` and so on."""
    return df.select("*", *[F.get(vector, F.lit(k)).alias(f"{prefix}{k:0{width}d}") for k in range(dim)]).drop(vector)
