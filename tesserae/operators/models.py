"""Thin wrappers around pyspark.ml for the model families of the experiments."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.metrics import label_index


def make_model(name: str, n_features: int | None = None, n_classes: int = 2, seed: int = 42, weight: str | None = None):
    """An estimator over ``features`` and ``label``: lr, svm, mlp, rf, extra_trees (a forest on all rows, as Spark has no random cut points) or gbt."""
    common = {"featuresCol": "features", "labelCol": "label"}
    weighted = {"weightCol": weight} if weight else {}
    if name == "lr":
        return LogisticRegression(maxIter=100, regParam=0.01, **common, **weighted)
    if name == "svm":
        svm = LinearSVC(maxIter=100, regParam=0.01, **common, **weighted)
        return svm if n_classes == 2 else OneVsRest(classifier=svm, **common)
    if name == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, 64, n_classes], maxIter=100, seed=seed, **common)
    if name == "rf":
        return RandomForestClassifier(numTrees=100, maxDepth=10, seed=seed, **common, **weighted)
    if name == "extra_trees":
        return RandomForestClassifier(numTrees=100, maxDepth=10, subsamplingRate=1.0, bootstrap=False, featureSubsetStrategy="sqrt", seed=seed, **common, **weighted)
    if name == "gbt":
        return GBTClassifier(maxIter=50, seed=seed, **common, **weighted)
    raise ValueError(f"unknown model {name}")


def save_model(model, path: str, overwrite: bool = False) -> None:
    """A fitted pipeline in a folder, from which ``load_model`` reads it."""
    (model.write().overwrite() if overwrite else model.write()).save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def draw_classes(train: DataFrame, df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """``df`` with ``y_pred`` drawn by a hash of ``key`` in the proportions of the labels of ``train``: the stratified dummy model."""
    counts = sorted((r[0], r[1]) for r in train.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string")).count().collect())  # one row per class
    total, seen, drawn = sum(n for _, n in counts), 0, F.lit(None).cast("string")
    at = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(max(total, 1)))
    for name, n in counts:
        drawn = F.coalesce(drawn, F.when(at < seen + n, F.lit(name)))
        seen += n
    return df.withColumn("y_pred", drawn)


def word_features(max_terms: int = 100_000, min_df: int = 2, text: str = "_text") -> list:
    """Stages from ``text`` to ``features``: TF-IDF of words of two or more letters or digits and of pairs of neighbours, each text scaled to length 1."""
    words = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\p{L}\p{N}_]+", toLowercase=True, minTokenLength=2)
    both = SQLTransformer(statement="select *, concat(_w, _p) as _terms from __THIS__")
    counts = CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=max_terms, minDF=min_df)
    return [words, NGram(n=2, inputCol="_w", outputCol="_p"), both, counts, IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="features")]


def term_classifier(train: DataFrame, text: str, label: str, model: str = "lr", max_terms: int = 100_000):
    """A fitted pipeline of ``word_features`` and a balanced linear model (lr or svm); gives it with its labels in order. Use ``classify``, or ``calibrated`` for two classes."""
    labels = [r["label"] for r in label_index(train, label).orderBy("idx").collect()]
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    rows = balanced_weights(train, label).withColumn("label", number.cast("double")).where("label is not null").withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    return Pipeline(stages=[*word_features(max_terms), make_model(model, n_classes=len(labels), weight="class_weight")]).fit(rows), labels


def calibrated(model, held_out: DataFrame, text: str, label: str, positive: str):
    """Platt scaling of a two-class margin: a function that adds ``score``, the probability of ``positive``, fitted on rows that the model has not seen."""
    def margins(df: DataFrame) -> DataFrame:
        return model.transform(df.drop("label").withColumn("_text", F.coalesce(F.col(text), F.lit("")))).withColumn("_margin", F.get(vector_to_array("rawPrediction"), F.lit(1)))

    fit_on = margins(held_out.withColumn("_y", (F.col(label) == positive).cast("double")).where("_y is not null")).select(F.col("_y").alias("label"), F.array("_margin").alias("m"))
    curve = LogisticRegression(featuresCol="features", labelCol="label").fit(fit_on.select("label", array_to_vector("m").alias("features")))
    slope, offset = float(curve.coefficients[0]), float(curve.intercept)
    return lambda df: margins(df).select(*[c for c in df.columns if c != "label"], (1 / (1 + F.exp(-(F.col("_margin") * slope + offset)))).alias("score"))


def vector_classifier(train: DataFrame, vector: str, label: str, model: str = "lr", dim: int | None = None):
    """A fitted pipeline over frozen vectors (an array column): standardised, then a balanced lr or an mlp; gives it with its labels in order."""
    labels = [r["label"] for r in label_index(train, label).orderBy("idx").collect()]
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    rows = with_vector(balanced_weights(train, label).withColumn("label", number.cast("double")).where("label is not null"), vector)
    last = make_model(model, n_features=dim, n_classes=len(labels), weight=None if model == "mlp" else "class_weight")
    return Pipeline(stages=[StandardScaler(inputCol="_vector", outputCol="features", withMean=True, withStd=True), last]).fit(rows), labels


def with_vector(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with its array column as ``_vector``; rows without one are left out."""
    return df.where(F.col(vector).isNotNull()).withColumn("_vector", array_to_vector(F.col(vector).cast("array<double>")))


def majority_class(train: DataFrame, label: str) -> str:
    """The most frequent label, of ties the smallest: the dummy model."""
    return train.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).first()[0]


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """``df`` with ``class_weight``: rows over classes times rows of the class."""
    from tesserae.functions.numeric import class_weights

    return df.join(class_weights(df, label).select(label, F.col("weight").alias("class_weight")), label, "left")


def text_classifier(train: DataFrame, text: str, label: str, buckets: int = 1 << 16, model: str = "lr"):
    """A fitted pipeline of hashed TF-IDF and a balanced linear model; gives it with its labels in order."""
    labels = [r["label"] for r in label_index(train, label).orderBy("idx").collect()]
    number = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)) - 1
    rows = balanced_weights(train, label).withColumn("label", number.cast("double")).where("label is not null").withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    stages = [Tokenizer(inputCol="_text", outputCol="_w"), HashingTF(inputCol="_w", outputCol="_tf", numFeatures=buckets), IDF(inputCol="_tf", outputCol="features", minDocFreq=2), make_model(model, n_classes=len(labels), weight="class_weight")]
    return Pipeline(stages=stages).fit(rows), labels


def classify(model, df: DataFrame, text: str, labels: list[str]) -> DataFrame:
    """``df`` with ``y_pred``."""
    scored = model.transform(df.drop("label").withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    names = F.array(*[F.lit(x) for x in labels])
    return scored.select(*[c for c in df.columns if c != "label"], F.get(names, F.col("prediction").cast("int")).alias("y_pred"))


def fine_tune(*_args, **_kwargs):
    """Fine-tuning of transformers and graph networks needs weights and an accelerator that Spark doesn't offer; it is out of scope."""
    raise NotImplementedError("training of transformers and graph networks is out of scope; score outside and join the vectors with one_to_one or align_vectors")
