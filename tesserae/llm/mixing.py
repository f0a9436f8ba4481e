"""Problem 7: mixing sources to target weights, by weighted fair queueing.

The documents of a source stand in a permuted order, repeated as often as the source allows. A document's virtual finish time is the tokens
of its source up to and with it, divided by the target weight of the source. Ordered by finish time, every prefix of the queue has the target
shares as long as no source has run out; the mix is the prefix of the total budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.tokens import TOKENIZERS, token_counts
from tesserae.operators.skew import bucketed_running, permuted
from tesserae.session import cut_lineage

#: Most listed sources that the driver plans for.
MAX_SOURCES = 10_000


def _listed(weights: DataFrame) -> list[dict]:
    rows = weights.select("source", "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return [r.asDict() for r in rows]


def finish_limit(supply: dict[str, int], share: dict[str, float], budget: float) -> float:
    """The virtual time at which the served tokens reach ``budget``: source s has given min(supply, share x time)."""
    ends = sorted((supply[s] / share[s], s) for s in share if supply.get(s))
    used, active = 0.0, sum(share[s] for _, s in ends)
    for time, s in ends:
        if used + active * time >= budget:
            return (budget - used) / active
        used, active = used + supply[s], active - share[s]
    return float("inf")


def mix_sources(docs: DataFrame, weights: DataFrame, budget: int | None = None, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mix ``(doc_id, source, copy, n_tokens, finish_time)`` in queue order, and the report per listed source.

    ``budget`` is the size of the mix in tokens; unset, the tokens of all documents of listed sources. Copy 0 of every document of a source comes before
    copy 1 of any. Where a source ends early (``exhausted`` in the report), the others go on in proportion to their weights. The last document
    that begins within the budget is the last. Documents without listed source, null or empty documents (0 tokens) are not mixed.
    The driver sees one row per listed source.
    """
    spark, listed = docs.sparkSession, _listed(weights)
    share = {r["source"]: r["target_share"] for r in listed}
    sized = token_counts(docs.where(F.col("source").isNotNull()).select(F.struct("doc_id", "source").alias("key"), "text"), "key", "text", tokenizer, folder)
    table = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"]) for r in listed], "source string, target_share double, max_repeats int")
    sized = cut_lineage(sized.select("key.doc_id", "key.source", "n_tokens").where("n_tokens > 0").join(table, "source"))
    held = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    supply = {r["source"]: held.get(r["source"], 0) * r["max_repeats"] for r in listed}
    limit = finish_limit(supply, share, float(sum(held.values()) if budget is None else budget))
    queue = bucketed_running(sized.withColumn("_h", permuted("doc_id", seed=seed)), "source", "_h", "doc_id", F.col("n_tokens"), total="_all", name="_cum")
    # copies that can't begin before the limit are not made
    room = (F.lit(limit) * F.col("target_share") - F.col("_cum") + F.col("n_tokens")) / F.col("_all")
    last = F.least(F.col("max_repeats") - 1.0, F.floor(F.least(room, F.lit(1e9))) + 1).cast("int")
    queue = queue.withColumn("copy", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))))
    finish = (F.col("_cum") + F.col("copy") * F.col("_all")) / F.col("target_share")
    # a document belongs to the prefix if it begins before the limit
    mix = queue.withColumn("finish_time", finish).where(F.col("finish_time") - F.col("n_tokens") / F.col("target_share") < F.lit(limit))
    mix = cut_lineage(mix.select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "n_tokens", "finish_time"))
    got = mix.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_distinct("doc_id").alias("n_distinct"), F.max("copy").alias("_top"), F.sum("n_tokens").alias("n_tokens"))
    supplied = spark.createDataFrame([(s, n) for s, n in supply.items()], "source string, supply bigint")
    report = table.join(got, "source", "left").join(supplied, "source", "left").na.fill(0, ["n_docs", "n_distinct", "n_tokens"])
    report = report.withColumn("_sum", F.sum("n_tokens").over(Window.partitionBy()))  # over the listed sources
    report = report.select("source", "target_share", "max_repeats", "n_docs", "n_distinct", F.coalesce(F.col("_top") + 1, F.lit(0)).cast("int").alias("most_repeats"), "n_tokens", F.when(F.col("_sum") > 0, F.col("n_tokens") / F.col("_sum")).otherwise(0.0).alias("actual_share"), (F.col("n_tokens") >= F.col("supply")).alias("exhausted"))
    return mix.orderBy("finish_time", "source", "doc_id"), report
