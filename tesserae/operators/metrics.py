"""Classification metrics as aggregates over scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def label_index(df: DataFrame, col: str) -> DataFrame:
    """``(label, idx)``: the distinct non-null labels numbered from 0 in order. Classes are few."""
    return df.where(F.col(col).isNotNull()).select(F.col(col).alias("label")).distinct().withColumn("idx", F.row_number().over(Window.orderBy("label")) - 1)


def confusion_counts(df: DataFrame, truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """``(y_true, y_pred, n)`` of the pairs that occur; rows with null on either side are left out."""
    return df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, labels: list[str], truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """One row per true label with a column per predicted label; zeros where nothing fell."""
    counts = confusion_counts(df, truth, pred).groupBy("y_true").pivot("y_pred", labels).agg(F.sum("n"))
    frame = df.sparkSession.createDataFrame([(x,) for x in labels], "y_true string")
    return frame.join(counts, "y_true", "left").na.fill(0)


def class_report(counts: DataFrame) -> DataFrame:
    """``(label, precision, recall, f1, support)`` over labels seen in truth or prediction, from confusion counts; 0 where undefined."""
    true = counts.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred = counts.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    both = true.join(pred, "label", "full_outer").na.fill(0)
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("predicted") > 0, 2 * F.col("tp") / (F.col("support") + F.col("predicted"))).otherwise(0.0)
    return both.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def summary_metrics(counts: DataFrame) -> DataFrame:
    """``(n, accuracy, macro_f1, weighted_f1)`` from confusion counts; the macro mean is over labels seen in truth or prediction."""
    report = class_report(counts)
    right = counts.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    means = report.agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    return right.join(F.broadcast(means), F.lit(True))  # one row each


def ranking_metrics(df: DataFrame, truth: str = "y_true", score: str = "score", buckets: int = 256, by: list[str] = ()) -> DataFrame:
    """``(*by, n, n_pos, roc_auc, average_precision)``, for each ``by`` (few), with tied scores as one group; null where only one class occurs.

    Distinct scores are cut into ``buckets`` equal ranges between the least and greatest; running sums are made inside a range and
    shifted by the sums of the higher ranges, so the curve is never ordered in one task.
    """
    known = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    groups = known.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(truth).cast("bigint")).alias("pos"), F.count("*").alias("all"))
    one = list(by) or F.lit(True)
    span = groups.groupBy(*by).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * buckets), F.lit(buckets - 1))).otherwise(0).cast("int")
    placed = groups.join(F.broadcast(span), one).withColumn("cell", cell)  # one row per `by`
    sums = placed.groupBy(*by, "cell").agg(F.sum("pos").alias("cp"), F.sum("all").alias("ca"))
    higher = Window.partitionBy(*by).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    whole = Window.partitionBy(*by)
    sums = sums.select(*by, "cell", F.coalesce(F.sum("cp").over(higher), F.lit(0)).alias("bp"), F.coalesce(F.sum("ca").over(higher), F.lit(0)).alias("ba"), F.sum("cp").over(whole).alias("P"), F.sum("ca").over(whole).alias("N"))
    down = Window.partitionBy(*by, "cell").orderBy(F.desc("s"))
    curve = placed.join(F.broadcast(sums), [*by, "cell"]).withColumn("tp", F.sum("pos").over(down) + F.col("bp")).withColumn("seen", F.sum("all").over(down) + F.col("ba"))
    neg = F.col("all") - F.col("pos")
    # of each group: positives above it beat its negatives, half of those inside tie
    wins = F.sum(neg * (F.col("tp") - F.col("pos")) + neg * F.col("pos") / 2)
    ap = F.sum(F.col("pos") / F.col("P") * (F.col("tp") / F.col("seen")))
    out = curve.groupBy(*by).agg(F.max("N").alias("n"), F.max("P").alias("n_pos"), wins.alias("w"), ap.alias("ap"))
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return out.select(*by, "n", "n_pos", F.when(both, F.col("w") / (F.col("n_pos") * (F.col("n") - F.col("n_pos")))).alias("roc_auc"), F.when(F.col("n_pos") > 0, F.col("ap")).alias("average_precision"))


def infer_task(df: DataFrame, target: str, requested: str = "auto") -> str:
    """``binary`` if the non-null values of ``target`` are at most two, else ``multiclass``; ``requested`` unless it is ``auto``."""
    if requested != "auto":
        return requested
    return "binary" if len(df.where(F.col(target).isNotNull()).select(F.col(target).cast("string")).distinct().limit(3).collect()) <= 2 else "multiclass"


def prepared_target(df: DataFrame, target: str, task: str, drop_unclear: bool = True, name: str = "y") -> DataFrame:
    """``df`` with the number ``name`` of its target: text labels in lower snake case, with blanks, ``nan`` and ``none`` (and ``unclear``) as null.

    Binary: numbers as they are, yes, true and 1 as 1, no, false and 0 as 0; where no value is one of these, two other classes in order as 0 and 1 (more raise). Multiclass: the place of the label in order, from 0.
    """
    if dict(df.dtypes)[target] in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") and task == "binary":
        return df.withColumn(name, F.col(target).cast("double"))
    text = F.regexp_replace(F.lower(F.trim(F.col(target).cast("string"))), r"[\s-]+", "_")
    held = df.withColumn("_label", F.when(~text.isin("", "nan", "none", *(["unclear"] if drop_unclear else [])), text))
    if task == "binary":
        number = F.when(F.col("_label").isin("yes", "true", "1"), 1.0).when(F.col("_label").isin("no", "false", "0"), 0.0)
        if held.agg(F.count(number)).first()[0]:
            return held.withColumn(name, number).drop("_label")
        if held.select("_label").where("_label is not null").distinct().limit(3).count() != 2:
            raise ValueError(f"{target} can't be made binary")
    index = label_index(held, "_label").select(F.col("label").alias("_label"), F.col("idx").cast("double").alias(name))  # classes are few
    return held.join(index, "_label", "left").drop("_label")


def threshold_grid(df: DataFrame, score: str, grid: str = "quantiles_99", accuracy: int | None = None) -> list[float]:
    """Candidate thresholds in ascending order: ``quantiles_99``, ``quantiles_97``, ``linear_91``, ``linear_181`` or ``none``.

    Exact quantiles hold every distinct score in one task; with ``accuracy`` (as of ``approx_percentile``) they come from a sketch instead.
    """
    if grid == "none":
        return [0.5]
    if grid.startswith("linear"):
        n = int(grid.split("_")[1])
        return [0.05 + 0.9 * k / (n - 1) for k in range(n)]
    points = [k / 100 for k in (range(1, 100) if grid == "quantiles_99" else range(2, 99))]
    values = df.where(F.col(score).isNotNull()).agg((F.percentile(score, points) if accuracy is None else F.percentile_approx(score, points, accuracy)).alias("q")).first()["q"] or []
    return sorted(set(values) | (set() if grid == "quantiles_99" else {0.0, 0.5}))


def threshold_sweep(df: DataFrame, thresholds: list[float], truth: str = "y_true", score: str = "score") -> DataFrame:
    """``(threshold, accuracy, f1_pos, macro_f1)`` of the rule ``score >= threshold``, all in one scan."""
    rows = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull())
    cells = rows.select(F.col(truth).cast("int").alias("y"), F.explode(F.transform(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.struct(t.alias("t"), (F.col(score) >= t).cast("int").alias("p")))).alias("c"))
    sums = cells.groupBy(F.col("c.t").alias("threshold")).agg(F.count("*").alias("n"), F.sum("y").alias("P"), F.sum("c.p").alias("S"), F.sum(F.col("y") * F.col("c.p")).alias("tp"))
    f1_pos = F.when(F.col("P") + F.col("S") > 0, 2 * F.col("tp") / (F.col("P") + F.col("S"))).otherwise(0.0)
    tn = F.col("n") - F.col("P") - F.col("S") + F.col("tp")
    neg = 2 * F.col("n") - F.col("P") - F.col("S")
    f1_neg = F.when(neg > 0, 2 * tn / neg).otherwise(0.0)
    seen = (F.col("P") + F.col("S") > 0).cast("int") + (neg > 0).cast("int")
    return sums.select("threshold", ((F.col("tp") + tn) / F.col("n")).alias("accuracy"), f1_pos.alias("f1_pos"), ((f1_pos + f1_neg) / seen).alias("macro_f1"))


def best_threshold(df: DataFrame, truth: str = "y_true", score: str = "score", grid: str = "quantiles_99", by: str = "macro_f1") -> tuple[float, float]:
    """The threshold with the best value and that value; of equals the lowest. Starts from 0.5 with -1, as for an empty table."""
    best = threshold_sweep(df, threshold_grid(df, score, grid), truth, score).orderBy(F.desc(by), "threshold").first()
    return (best["threshold"], best[by]) if best else (0.5, -1.0)


def binary_metrics(df: DataFrame, truth: str = "y_true", pred: str = "y_pred", score: str | None = None) -> DataFrame:
    """Accuracy, macro, weighted and positive F1, precision and recall (0 where undefined), with AUC and average precision if there is a score."""
    counts = confusion_counts(df.withColumns({truth: F.col(truth).cast("string"), pred: F.col(pred).cast("string")}), truth, pred)
    pos = class_report(counts).where("label = '1'").agg(F.coalesce(F.max("f1"), F.lit(0.0)).alias("f1_pos"), F.coalesce(F.max("precision"), F.lit(0.0)).alias("precision_pos"), F.coalesce(F.max("recall"), F.lit(0.0)).alias("recall_pos"))
    out = summary_metrics(counts).join(F.broadcast(pos), F.lit(True))
    return out.join(F.broadcast(ranking_metrics(df, truth, score).select("roc_auc", "average_precision")), F.lit(True)) if score else out


def macro_ovr_auc(df: DataFrame, classes: list[str], truth: str = "y_true", scores: str = "scores") -> float | None:
    """Mean one-versus-rest AUC of an array of class scores; None unless every class occurs. All classes in one pass."""
    one = F.array(*[F.struct(F.lit(c).alias("c"), (F.col(truth) == c).cast("int").alias("y"), F.get(scores, F.lit(k)).alias("s")) for k, c in enumerate(classes)])
    rows = df.select(F.explode(one).alias("o")).select("o.*") if classes else None
    values = [r["roc_auc"] for r in ranking_metrics(rows, "y", "s", by=["c"]).collect()] if classes else []  # one row per class
    return sum(values) / len(values) if len(values) == len(classes) > 0 and all(v is not None for v in values) else None


def align_scores(df: DataFrame, key: str, trained: list[str], classes: list[str], scores: str = "scores") -> DataFrame:
    """``df`` with the score array in the order of ``classes``; classes that training lacked get 0."""
    return df.withColumn(scores, F.array(*[F.get(scores, F.lit(trained.index(c))) if c in trained else F.lit(0.0) for c in classes]))


def ranked_results(results: DataFrame, groups: list[str] = ("target", "split"), by: str = "macro_f1") -> DataFrame:
    """Results with their rank per group by falling metric; ties by model."""
    w = Window.partitionBy(*groups).orderBy(F.col(by).desc_nulls_last(), "model")
    return results.withColumn("rank", F.row_number().over(w))
