"""The three ways through the operators: awards to tables, labels to an audited benchmark, benchmark to features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions import signals, text
from tesserae.operators import dedup, edges, history, joins, reports, splitting
from tesserae.session import cut_lineage


def awards_to_tables(awards: DataFrame, first_year: int | None = None, last_year: int | None = None) -> dict[str, DataFrame]:
    """Cleaned awards (latest version each), text flags, the four edge tables, duplicate clusters and a quality report.

    The cleaned table and the person edges are written once and feed every result.
    """
    joins.require_columns(awards, ["award_id", "record_id", "title_clean", "abstract_clean", "last_amendment_date", "start_year", "pi_clean", "pi_email_extracted", "co_pi_records", "programelementcodes", "programs", "institution_id"], "awards")
    rows = awards
    if first_year is not None and last_year is not None:
        rows = rows.where(F.col("start_year").between(first_year, last_year))
    latest = dedup.keep_latest(rows, "award_id", "last_amendment_date", "record_id")
    latest = cut_lineage(latest.withColumn("text_cluster", text.text_cluster_id("title_clean", "abstract_clean", "award_id")))
    norm = text.search_text(F.concat_ws(" ", F.coalesce("title_clean", F.lit("")), F.coalesce("abstract_clean", F.lit(""))))
    people = cut_lineage(edges.person_edges(latest, "award_id", "pi_clean", "pi_email_extracted", "co_pi_records", "record_id", ["start_year", "institution_id"]))
    return {
        "awards": latest,
        "flags": signals.add_signals(latest.select("award_id", "start_year", "nsforganization", norm.alias("norm")), "norm").drop("norm"),
        "person_edges": people,
        "collaboration": edges.collaboration_edges(people.select("award_id", F.col("person_id").alias("pi_id"), F.col("name").alias("pi_name"), "start_year")),
        "institution_edges": edges.institution_edges(latest, ["award_id", "institution_id", "organization_clean", "state", "organizationcity", "start_year", "nsfdirectorate", "nsforganization"]),
        "program_edges": edges.program_edges(latest, "award_id", "programelementcodes", "programs", ["start_year"]),
        "clusters": dedup.cluster_report(latest, "text_cluster", "award_id", "title_clean", "start_year", "record_id"),
        "quality": reports.quality_report(latest, "award_id", ["title_clean", "abstract_clean"], ["award_amount", "start_year"], ["nsforganization", "state"]),
    }


def labels_to_benchmark(labels: DataFrame) -> dict[str, DataFrame]:
    """The labelled table with canonical labels, targets and cluster-safe splits, and its audits."""
    rows = labels
    for c in [c for c in labels.columns if c.startswith("label_") and c != "label_source"]:
        rows = rows.withColumn(c, text.label(c))
    for c in ("label_design_type", "label_integration_type"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit("none"))
    rows = signals.label_targets(rows.drop(*[c for c in rows.columns if c.startswith("split_")]))
    rows = splitting.greedy_split(rows, "project_cluster_id", "stratify_key", "split_random")
    rows = splitting.temporal_split(rows, "project_cluster_id", "start_year", "split_temporal")
    rows = splitting.component_split(rows, "project_cluster_id", "person_id", "split_person", unknown_ties=False)
    rows = cut_lineage(splitting.component_split(rows, "project_cluster_id", "organization_clean", "split_institution", unknown_ties=False))
    splits = ["split_random", "split_temporal", "split_person", "split_institution"]
    issues = reports.rule_issues(rows, reports.label_rules(), ["benchmark_id"])
    return {
        "benchmark": rows, "issues": issues, "issue_counts": reports.issue_pivot(rows.select("benchmark_id"), issues, "benchmark_id"),
        "summary": reports.split_summary(rows, splits, {"n_mmr": F.col("target_mmr") == 1}), "leakage": reports.leakage_report(rows, splits, ["project_cluster_id", "person_id", "organization_clean"]),
        "labels": reports.long_counts(rows, [c for c in rows.columns if c.startswith("label_")]),
    }


def benchmark_to_features(awards: DataFrame, person_edges: DataFrame) -> DataFrame:
    """Strictly earlier history of every award with a year."""
    base = awards.select("award_id", F.col("start_year").alias("year"), F.col("person_id").alias("lead"), F.col("institution_id").alias("institution"), F.coalesce(F.get(text.codes("programelementcodes"), F.lit(0)), F.lit("")).alias("program"))
    return history.history_features(base, person_edges.select("award_id", F.col("person_id").alias("person")).distinct())
