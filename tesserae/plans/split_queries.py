"""Queries of splits, audits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.text import hash_bucket, split_value
from tesserae.operators import reports, sampling, splitting
from tesserae.plans import sql as s
from tesserae.plans.registry import query

SPLIT_COLUMNS = ["split_random_cluster_stratified", "split_temporal_cluster_safe", "split_edu_to_eng_cluster_safe", "split_cross_program_cluster_safe", "split_cold_start_pi_cluster_safe", "split_cold_start_institution_cluster_safe"]
KEYS = ["project_cluster_id", "person_id", "organization_clean", "primary_program_key"]


@query(f"select record_id, {s.bucket('award_id')} as bucket, {s.split_of(s.bucket('award_id'))} as split from $awards")
def split_hash(t):
    return splitting.hash_split(t.awards, "award_id").select("record_id", hash_bucket("award_id").alias("bucket"), "split")


@query("""select record_id, case when y is null then 'unknown' when y <= 2016 then 'train' when y <= 2019 then 'validation' else 'test' end as split from (select record_id, max(start_year) over (partition by project_text_id) as y from $awards)""")
def split_temporal(t):
    return splitting.temporal_split(t.awards.select("record_id", "project_text_id", "start_year"), "project_text_id", "start_year").select("record_id", "split")


@query("""select record_id, case when e = 1 then 'test' when d = 1 then 'train' else 'unused' end as split from (select record_id, max(coalesce((nsforganization = 'EEC')::int, 0)) over w as e, max(coalesce((nsforganization = 'DUE')::int, 0)) over w as d from $awards window w as (partition by project_text_id))""")
def split_any_flag(t):
    rows = t.awards.select("record_id", "project_text_id", "nsforganization")
    return splitting.transfer_split(rows, "project_text_id", F.col("nsforganization") == "DUE", F.col("nsforganization") == "EEC").select("record_id", "split")


_NODES = "(select benchmark_id, 'cluster:' || coalesce(project_cluster_id, '') as c, 'key:' || case when trim(coalesce(primary_program_key, '')) = '' then 'unknown' else lower(trim(primary_program_key)) end as k from $benchmark)"


@query(f"""with recursive e as (select distinct c as a, k as b from {_NODES} union select distinct k, c from {_NODES}), reach(a, r) using key (a) as (select a, a as r from (select distinct a from e) union
    select e.b, min(reach.r) as r from e join reach on reach.a = e.a join recurring.reach old on old.a = e.b where reach.r < old.r group by e.b)
    select n.benchmark_id, {s.split_of(s.bucket('reach.r'))} as split from {_NODES} n join reach on reach.a = n.c""")
def split_component(t):
    return splitting.component_split(t.benchmark, "project_cluster_id", "primary_program_key").select("benchmark_id", "split")


# the fold over the clusters of a stratum, one by one, as a recursion
_DEALT = f"""b as (select benchmark_id, project_cluster_id as c, coalesce(label_mmr_class, 'unknown') as stratum from $benchmark), cnt as (select c, stratum, count(*) as n from b group by 1, 2), mode as (select c, arg_min(stratum, {{'n': -n, 's': stratum}}) as stratum from cnt group by 1),
    z as (select c, count(*) as n from b group by 1), t as materialized (select z.c, z.n, m.stratum, row_number() over (partition by m.stratum order by sha1('42|' || z.c) nulls last, z.c) as k, count(*) over (partition by m.stratum) as clusters, (sum(z.n) over (partition by m.stratum))::double as total from z join mode m on m.c is not distinct from z.c),
    f as (select stratum, 0::bigint as k, 0::double as a, 0::double as v, 0::double as e, '' as pick from t group by 1 union all
        select stratum, k, a + (p = 'train')::int * n, v + (p = 'validation')::int * n, e + (p = 'test')::int * n, p from (select t.stratum, t.k, t.n, f.a, f.v, f.e,
            list_sort([{{'lack': -(0.7::double * total - a), 'held': a, 'no': 0, 'name': 'train'}}, {{'lack': -(0.15::double * total - v), 'held': v, 'no': 1, 'name': 'validation'}}, {{'lack': -(0.15::double * total - e), 'held': e, 'no': 2, 'name': 'test'}}])[1].name as p from f join t on t.stratum = f.stratum and t.k = f.k + 1))"""


@query(f"with recursive {_DEALT} select b.benchmark_id, b.stratum, case when t.clusters >= 3 then f.pick else {s.split_of(s.bucket("'split:' || t.c"))} end as split from b join t on t.c is not distinct from b.c join f on f.stratum = t.stratum and f.k = t.k")
def split_greedy(t):
    rows = t.benchmark.withColumn("stratum", F.coalesce("label_mmr_class", F.lit("unknown")))
    return splitting.greedy_split(rows, "project_cluster_id", "stratum").select("benchmark_id", "stratum", "split")


@query(f"select benchmark_id, case when {s.bucket(chr(39) + '42|' + chr(39) + ' || coalesce(label_mmr_class, ' + chr(39) * 2 + ') || ' + chr(39) + '|' + chr(39) + ' || benchmark_id', 10000)} < 1500 then 'validation' else 'train' end as internal_split from $benchmark")
def carve_validation(t):
    return splitting.carve_validation(t.benchmark, "benchmark_id", "label_mmr_class", mode="row").select("benchmark_id", "internal_split")


@query("""select benchmark_id, case when row_number() over (partition by label_mmr_class order by sha1('42|' || benchmark_id), benchmark_id) <= round(count(*) over (partition by label_mmr_class) * 0.15) then 'validation' else 'train' end as internal_split from $benchmark""")
def carve_exact(t):
    return splitting.exact_carve(t.benchmark, "benchmark_id", "label_mmr_class").select("benchmark_id", "internal_split")


_LONG = " union all ".join(f"select '{c}' as split_column, {c} as split, target_mmr_binary, label_design_present from $benchmark" for c in SPLIT_COLUMNS)


@query(f"select split_column, split, count(*) as n_rows, count(*) filter (where target_mmr_binary = 1) as n_mmr, count(*) filter (where label_design_present = 'yes') as n_design from ({_LONG}) group by 1, 2")
def split_summary(t):
    return reports.split_summary(t.benchmark, SPLIT_COLUMNS, {"n_mmr": F.col("target_mmr_binary") == 1, "n_design": F.col("label_design_present") == "yes"})


_AUDIT = " union all ".join(f"select '{c}' as split_column, '{k}' as key, {k} as value, count(*) as n, count(distinct case when trim(lower({c})) = '' then 'unknown' else trim(lower({c})) end) as m from $benchmark group by {k}" for c in SPLIT_COLUMNS for k in KEYS)


@query(f"select split_column, key, count(*) as n_groups, count(*) filter (where n > 1 and m > 1) as n_crossing, coalesce(sum(n) filter (where n > 1 and m > 1), 0)::bigint as n_rows_crossing from ({_AUDIT}) group by 1, 2")
def leakage_report(t):
    rows = t.benchmark.withColumns({c: F.when(F.col(c).isNotNull(), split_value(c)) for c in SPLIT_COLUMNS})
    return reports.leakage_report(rows, SPLIT_COLUMNS, KEYS)


@query("select record_id from $awards order by sha1(record_id || '|42'), record_id limit 100")
def sample_n(t):
    return sampling.sample_n(t.awards.select("record_id"), "record_id", 100)


@query("""with q(stratum, quota) as (values ('design_integration_enriched', 36), ('explicit_mmr', 54), ('implicit_mmr', 54), ('qual_only_hard_negative', 42), ('quant_only_hard_negative', 42), ('method_heavy_background', 36), ('random_background', 36))
    select record_id, candidate_stratum from (select record_id, candidate_stratum, quota, row_number() over (partition by candidate_stratum order by sha1(record_id || '|42'), record_id) as r from $flagged join q on stratum = candidate_stratum) where r <= quota""")
def sample_quota(t):
    return sampling.quota_sample(t.flagged.select("record_id", "candidate_stratum"), "record_id", "candidate_stratum", sampling.make_quota(300)).select("record_id", "candidate_stratum")


@query("""with recursive o as materialized (select project_text_id as c, count(*) as n, row_number() over (order by sha1(project_text_id || '|42'), project_text_id) as k from $awards where project_text_id is not null group by 1),
    f as (select 0::bigint as k, 0::bigint as held, '' as c, false as took union all select o.k, f.held + (f.held < 100 and f.held + o.n <= 120)::int * o.n, o.c, f.held < 100 and f.held + o.n <= 120 from f join o on o.k = f.k + 1)
    select a.record_id, a.project_text_id from $awards a join f on f.c = a.project_text_id and f.took""")
def cluster_sample(t):
    return sampling.cluster_sample(t.awards.select("record_id", "project_text_id"), "project_text_id", 100, cap=120)


@query("""with ref as (select start_year, count(*) as r from $benchmark group by 1), g as (select start_year, round(r * 100.0 / sum(r) over ())::int as goal from ref),
    k as (select record_id, sha1(record_id || '|42') as h, case when row_number() over (partition by start_year order by sha1(record_id || '|42'), record_id) <= coalesce(goal, 0) then 0 else 1 end as f from $awards left join g using (start_year))
    select record_id from k order by f, h, record_id limit 100""")
def matched_background(t):
    return sampling.matched_background(t.awards.select("record_id", "start_year"), t.benchmark, ["start_year"], "record_id", 100).select("record_id")


@query()
def annotation_sample(t):
    rows = t.flagged.join(t.awards.select("record_id", "project_text_id"), "record_id")
    return sampling.annotation_sample(rows.select("record_id", "project_text_id", "candidate_stratum"), "record_id", "project_text_id", "candidate_stratum", 200, labels=["label_mmr_class", "annotator"])
