"""Queries of readers, writers, discovery and the tables about tables. What is written goes to the shared work folder and is read back whole."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import experiments, joins, metrics, models, reports
from tesserae.plans.registry import query
from tesserae.sources import io


def _rows(t, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


# a CSV file can't tell an empty cell from a null one: both are read as null
@query("select edge_id::varchar as edge_id, nullif(award_id, '') as award_id, nullif(pi_name, '') as pi_name, nullif(pi_email, '') as pi_email, nullif(role, '') as role, start_year::varchar as start_year from $edges")
def csv_round_trip(t):
    path = io.work_folder(t.spark, "csv")
    io.write_csv(t.edges.select("edge_id", "award_id", "pi_name", "pi_email", "role", "start_year"), path, bom=True)
    return io.read_text_csv(t.spark, path)


@query("select record_id::int as record_id, start_year, round(award_amount, 2) as award_amount, start_date from $awards")
def csv_typed(t):
    path = io.work_folder(t.spark, "csv")
    io.write_csv(t.awards.select("record_id", "start_year", "award_amount", "start_date"), path)
    return io.read_typed_csv(t.spark, path).withColumn("award_amount", F.round("award_amount", 2))


@query("select record_id::double as record_id, round(award_amount, 2) as award_amount, start_date, end_date, case when trim(coalesce(title_clean, '')) = '' then 0 else 1 end as titled from $awards")
def csv_restored(t):
    path = io.work_folder(t.spark, "csv")
    io.write_csv(t.awards.select("record_id", "award_amount", "start_date", "end_date", "title_clean"), path)
    out = io.restore_types(io.read_text_csv(t.spark, path), ["record_id", "award_amount"], ["start_date", "end_date"], text="title_clean")
    return out.select("record_id", F.round("award_amount", 2).alias("award_amount"), "start_date", "end_date", (F.col("abstract_word_count") > 0).cast("int").alias("titled"))


@query("select n_nationkey::varchar as n_nationkey, n_name from nation")
def zip_read(t):
    folder = io.work_folder(t.spark, "zip")
    io.write_csv(t.nation.select("n_nationkey", "n_name").coalesce(1), f"{folder}/csv")
    part = next(f"{folder}/csv/{n}" for n in os.listdir(f"{folder}/csv") if n.endswith(".csv"))
    with zipfile.ZipFile(f"{folder}/data.zip", "w") as z:  # an old version, sidecars and the file that is wanted
        z.writestr("__MACOSX/._methodkg_v9_modeling.csv", "no")
        z.writestr("._methodkg_v9_modeling.csv", "no")
        z.writestr("methodkg_v2_modeling.csv", "n_nationkey,n_name\n0,old\n")
        z.write(part, "methodkg_v10_modeling.csv")
    return io.read_csv_or_zip(t.spark, f"{folder}/data.zip", folder=f"{folder}/unpacked")


@query("select * from (values ('choose_known', 'b_v1.csv'), ('choose_newest', 'a_v10.csv'), ('choose_preferred', 'b_v1.csv'), ('choose_modeling', 'x_modeling.csv'), ('sidecar_dot', 'true'), ('sidecar_macosx', 'true'), ('sidecar_plain', 'false'), ('version', '3.1')) v(what, answer)")
def member_choice(t):
    names = ["a_v2.csv", "a_v10.csv", "b_v1.csv"]
    side = lambda n: str(io.is_sidecar(n)).lower()
    rows = [
        ("choose_known", io.choose_member(names, None, ["zz.csv", "b_v1.csv"])), ("choose_newest", io.choose_member(names)), ("choose_preferred", io.choose_member(names, "b_v1.csv")), ("choose_modeling", io.choose_member([*names, "x_modeling.csv"])),
        ("sidecar_dot", side("d/._a.csv")), ("sidecar_macosx", side("__MACOSX/a.csv")), ("sidecar_plain", side("d/a.csv")), ("version", ".".join(map(str, io.version_of("labels_v3_1.csv")))),
    ]
    return _rows(t, rows, "what string, answer string")


@query("select r_regionkey, r_name from region")
def discovered_table(t):
    folder = io.work_folder(t.spark, "found")
    io.write_table(t.region.limit(0), f"{folder}/sub/regions_v2.parquet")
    io.write_table(t.region, f"{folder}/regions_v10.parquet")
    return t.spark.read.parquet(io.discover(folder, ["missing.parquet"], ["*.parquet"])).select("r_regionkey", "r_name")


_NEEDED = ["benchmark_id", "award_id", "label_mmr_class", "label_design_type", "annotator_id", "start_year"]


@query(f"select c as column from (select unnest({_NEEDED}) as c) where c not in (select column_name from information_schema.columns where table_name = '$benchmark')")
def missing_columns(t):
    return _rows(t, [(c,) for c in joins.missing_columns(t.benchmark, _NEEDED)], "column string")


@query("select * from (values ('first write', 'done'), ('guarded second write', 'refused'), ('overwrite', 'done'), ('delete outside of the root', 'refused'), ('delete of the root', 'refused'), ('reset below the root', 'done')) v(step, result)")
def overwrite_guard(t):
    folder = io.work_folder(t.spark, "guard")
    path, steps = f"{folder}/table", []

    def attempt(step, f):
        try:
            f()
            steps.append((step, "done"))
        except (FileExistsError, ValueError):
            steps.append((step, "refused"))

    def write(overwrite):
        io.refuse_overwrite([path], overwrite)
        io.write_table(t.region, path, overwrite)

    attempt("first write", lambda: write(False))
    attempt("guarded second write", lambda: write(False))
    attempt("overwrite", lambda: write(True))
    attempt("delete outside of the root", lambda: io.reset_folder(f"{folder}/../else", folder, True))
    attempt("delete of the root", lambda: io.reset_folder(folder, folder, True))
    attempt("reset below the root", lambda: io.reset_folder(path, folder, True))
    return _rows(t, steps, "step string, result string")


@query("select nsforganization as unit, count(*) as n, (select count(*) from $flagged) as n_rows from $flagged where nsforganization is not null group by 1")
def json_summary(t):
    path = io.work_folder(t.spark, "summary") + ".json"
    counts = reports.value_counts(t.flagged.where("nsforganization is not null"), "nsforganization", "record_id")
    io.write_summary(path, n_rows=t.flagged.count(), by_unit=io.rows_as_dicts(counts))
    out = t.spark.read.option("multiLine", True).json(path)
    return out.select(F.explode("by_unit").alias("u"), "n_rows").select(F.col("u.value").alias("unit"), F.col("u.n").alias("n"), "n_rows")


@query("select count(*) as n_rows, sum(('0x' || left(d, 12))::bigint)::decimal(38, 0)::varchar || ':' || sum(('0x' || substr(d, 13, 12))::bigint)::decimal(38, 0)::varchar as digest from (select sha256(coalesce(award_id, '∅') || '|' || coalesce(edge_id::varchar, '∅') || '|' || coalesce(pi_name, '∅')) as d from $edges)")
def edges_digest(t):
    return reports.table_digest(t.edges.select("edge_id", "award_id", "pi_name"))


@query("select 'same' as pair, true as equal union all select 'other order and files', true union all select 'one row less', false")
def compared_outputs(t):
    one = t.edges.select("edge_id", "pi_name")
    rows = [("same", experiments.same_tables(one, one)), ("other order and files", experiments.same_tables(one, one.repartition(5))), ("one row less", experiments.same_tables(one, one.where(F.col("edge_id") > one.agg(F.min("edge_id")).first()[0])))]
    return _rows(t, rows, "pair string, equal boolean")


_RESULTS = """(select label_mmr_class as target, lower(trim(split_temporal_cluster_safe)) as split, primary_program_key as model, count(*) as n, round(avg(start_year), 4) as macro_f1 from $benchmark
    where label_mmr_class is not null and lower(trim(split_temporal_cluster_safe)) in ('train', 'validation', 'test') and primary_program_key is not null group by 1, 2, 3)"""


def _results(t):
    rows = t.benchmark.withColumn("split", F.lower(F.trim("split_temporal_cluster_safe"))).where("label_mmr_class is not null and split in ('train', 'validation', 'test') and primary_program_key is not null")
    return rows.groupBy(F.col("label_mmr_class").alias("target"), "split", F.col("primary_program_key").alias("model")).agg(F.count("*").alias("n"), F.round(F.avg("start_year"), 4).alias("macro_f1"))


@query(f"select target, split, n::int as n from (select target, split, sum(n) as n from {_RESULTS} group by 1, 2)")
def result_rollup(t):
    folder = io.work_folder(t.spark, "results")
    sums = _results(t).groupBy("target", "split").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # one small file per cell of the matrix, as experiments leave them
        io.write_csv(t.spark.createDataFrame([(r["n"],)], "n bigint").coalesce(1), f"{folder}/{r['target']}/{r['split']}/metrics.csv")
    return io.rollup_results(t.spark, [folder], "part-*.csv", ("target", "split", "file")).select("target", "split", F.col("n").cast("int").alias("n"))


@query(f"select * from {_RESULTS} where split = 'test'")
def evaluation_only(t):
    return experiments.evaluation_rows(_results(t), "split")


@query(f"select *, row_number() over (partition by target, split order by macro_f1 desc nulls last, model)::int as rank from {_RESULTS}")
def ranked_results(t):
    return metrics.ranked_results(_results(t))


@query(f"select * from (select target, split, arg_min(model, struct_pack(a := -coalesce(macro_f1, -1), b := model)) as model, max(macro_f1) as macro_f1 from {_RESULTS} group by 1, 2)")
def best_results(t):
    return metrics.ranked_results(_results(t)).where("rank = 1").select("target", "split", "model", "macro_f1")


@query("select award_id, record_id, start_year, award_amount from $awards order by start_year desc nulls last, award_amount asc nulls last, record_id limit 50")
def sorted_head(t):
    rows = t.awards.select("award_id", "record_id", "start_year", "award_amount")
    return rows.orderBy(F.col("start_year").desc_nulls_last(), F.col("award_amount").asc_nulls_last(), "record_id").limit(50)


@query("select vec_id, label, round(embedding[1]::double, 5) as first from embeddings")
def cached_table(t):
    path = io.work_folder(t.spark, "cache")
    io.cached(path, lambda: t.embeddings, t.spark)
    return io.cached(path, lambda: t.embeddings.limit(0), t.spark).select("vec_id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


@query("select count(*) as n, true as same from embeddings")
def saved_model(t):
    fitted, labels = models.vector_classifier(t.embeddings.select("vec_id", "embedding", F.col("label").cast("string").alias("label")), "embedding", "label")
    path = io.work_folder(t.spark, "model")
    models.save_model(fitted, path)
    rows = models.with_vector(t.embeddings.select("vec_id", "embedding"), "embedding")
    a, b = (m.transform(rows).select("vec_id", "prediction") for m in (fitted, models.load_model(path)))
    return a.join(b.withColumnRenamed("prediction", "other"), "vec_id").agg(F.count("*").alias("n"), F.bool_and(F.col("prediction") == F.col("other")).alias("same"))


@query("select q.target, s.split, m.model, (select count(*) from $benchmark where lower(trim(split_temporal_cluster_safe)) = s.split and label_mmr_class = q.target)::double as n, case when m.model = 'broken' then 'no such model' end as error from (values ('explicit_mmr'), ('qual_only')) q(target), (values ('train'), ('test')) s(split), (values ('count'), ('broken')) m(model) where m.model = 'count' union all select q.target, s.split, 'broken', null, 'no such model' from (values ('explicit_mmr'), ('qual_only')) q(target), (values ('train'), ('test')) s(split)")
def experiment_matrix(t):
    rows = t.benchmark.withColumn("split", F.lower(F.trim("split_temporal_cluster_safe")))

    def run(cell):
        if cell["model"] == "broken":
            raise ValueError("no such model")
        return {"n": rows.where((F.col("split") == cell["split"]) & (F.col("label_mmr_class") == cell["target"])).count()}

    cells = [{"target": q, "split": s, "model": m} for q in ("explicit_mmr", "qual_only") for s in ("train", "test") for m in ("count", "broken")]
    return experiments.run_matrix(t.spark, cells, run)
