"""Queries of dedup, clusters, aggregates, reports, rules and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.text import label, search_text, text_cluster_id
from tesserae.operators import dedup, joins, reports
from tesserae.plans import sql as s
from tesserae.plans.registry import query

_CLUSTER = f"(select doc_id, doc_year, source, 'projtxt_' || left(sha1(case when {s.search_text('text')} = '' then 'missing ' || doc_id else {s.search_text('text')} end), 16) as cluster from documents)"


def _clusters(t):
    norm = search_text("text")
    digest = F.sha1(F.when(norm == "", F.concat(F.lit("missing "), F.col("doc_id").cast("string"))).otherwise(norm))
    return t.documents.select("doc_id", "doc_year", "source", F.concat(F.lit("projtxt_"), F.substring(digest, 1, 16)).alias("cluster"))


@query(f"""select cluster, count(distinct doc_id) as n_members, count(*) as n_rows, arg_min(source, doc_id) filter (where source is not null) as first_title, min(doc_year) as first_year, max(doc_year) as last_year,
    array_to_string(list_sort(list(distinct doc_id::varchar))[1:5], '|') || case when count(distinct doc_id) > 5 then '|...' else '' end as member_ids from {_CLUSTER} group by 1 having count(distinct doc_id) > 1""")
def text_cluster_report(t):
    return dedup.cluster_report(_clusters(t), "cluster", "doc_id", "source", "doc_year", "doc_id", 5)


@query(f"select record_id, 'projtxt_' || left(sha1(case when k = '' then 'missing ' || trim(coalesce(award_id, '')) else k end), 16) as cluster from (select record_id, award_id, trim({s.id_text('title_clean')} || ' ' || {s.id_text('abstract_clean')}) as k from $awards)")
def award_text_cluster(t):
    return t.awards.select("record_id", text_cluster_id("title_clean", "abstract_clean", "award_id").alias("cluster"))


@query(f"select doc_id, cluster, (row_number() over (partition by cluster order by doc_id) > 1)::int as dup from {_CLUSTER}")
def dup_flag(t):
    return dedup.duplicate_flag(_clusters(t), ["cluster"], [F.col("doc_id")], "dup").select("doc_id", "cluster", "dup")


@query(f"select doc_id, cluster, n as cluster_size, (n > 1)::int as duplicate_text_cluster_flag from {_CLUSTER} join (select cluster, count(distinct doc_id) as n from {_CLUSTER} group by 1) using (cluster)")
def cluster_size(t):
    return dedup.add_cluster_size(_clusters(t), "cluster", "doc_id").select("doc_id", "cluster", "cluster_size", "duplicate_text_cluster_flag")


@query("select award_id, record_id, last_amendment_date from (select *, row_number() over (partition by award_id order by last_amendment_date desc nulls last, record_id) as r from $awards) where r = 1")
def keep_latest(t):
    return dedup.keep_latest(t.awards.select("award_id", "record_id", "last_amendment_date"), "award_id", "last_amendment_date", "record_id")


@query("select award_id, record_id, start_year from (select *, row_number() over (partition by award_id order by start_year nulls last, record_id) as r from $awards) where r = 1")
def cluster_representative(t):
    return dedup.representatives(t.awards.select("award_id", "record_id", "start_year"), "award_id", "start_year", "record_id")


@query("select record_id, count(*) over w as cluster_rows, min(start_year) over w as cluster_min_year, max(start_year) over w as cluster_max_year from $awards window w as (partition by award_id)")
def cluster_span(t):
    return dedup.cluster_span(t.awards.select("record_id", "award_id", "start_year"), "award_id", "start_year").select("record_id", "cluster_rows", "cluster_min_year", "cluster_max_year")


@query("select record_id, 'bench_v3_' || lpad(row_number() over (order by record_id)::varchar, 9, '0') as benchmark_id from $awards")
def sequence_ids(t):
    return dedup.row_ids(t.awards.select("record_id"), ["record_id"], "bench_v3_", 9, "benchmark_id")


@query("select record_id, award_id from $awards where start_year between 2005 and 2015")
def year_filter(t):
    return t.awards.where(F.col("start_year").between(2005, 2015)).select("record_id", "award_id")


@query("select record_id, (not coalesce(upper(trim(nsforganization)), '') in ('DUE', 'DRL', 'EES', 'DGE', 'EEC'))::int as legacy from $awards")
def legacy_flag(t):
    known = F.coalesce(F.upper(F.trim("nsforganization")), F.lit("")).isin("DUE", "DRL", "EES", "DGE", "EEC")
    return t.awards.select("record_id", (~known).cast("int").alias("legacy"))


@query("select nsforganization as value, count(*) as n from $flagged group by 1")
def value_counts_ordered(t):
    return reports.value_counts(t.flagged, "nsforganization", "record_id")


@query("""with c as (select institution_id, trim(state) as v, count(*) as n from $awards where trim(state) <> '' group by 1, 2)
    select i.institution_id, coalesce(min(c.v) filter (where c.n = m.n), 'unknown') as state from (select distinct institution_id from $awards) i left join c using (institution_id) left join (select institution_id, max(n) as n from c group by 1) m using (institution_id) group by 1""")
def mode_tiebreak(t):
    return reports.group_mode(t.awards.withColumn("state", F.trim("state")), ["institution_id"], "state", "state")


@query("select record_id, max((upper(trim(coalesce(nsforganization, ''))) = 'EEC')::int) over (partition by award_id) as any_eec from $awards")
def any_in_group(t):
    rows = t.awards.select("record_id", "award_id", "nsforganization")
    return reports.any_in_group(rows, "award_id", F.upper(F.trim("nsforganization")) == "EEC", "any_eec").select("record_id", "any_eec")


@query("""with n as (select count(*)::double as n_rows, count(distinct award_id)::double as d, count(*) filter (where coalesce(trim(title_clean), '') = '')::double as mt, count(*) filter (where coalesce(trim(state), '') = '')::double as ms,
    count(*) filter (where award_amount is null)::double as ma, avg(award_amount) as a, median(award_amount) as m, min(award_amount) as lo, max(award_amount) as hi from $awards)
    select 'rows' as section, 'n_rows' as metric, n_rows as value from n union all select 'rows', 'distinct_award_id', d from n union all select 'missing', 'title_clean', mt from n union all select 'missing', 'state', ms from n union all select 'missing', 'award_amount', ma from n
    union all select 'numbers', 'award_amount_mean', round(a, 4) from n union all select 'numbers', 'award_amount_median', round(m, 4) from n union all select 'numbers', 'award_amount_min', lo from n union all select 'numbers', 'award_amount_max', hi from n
    union all select 'counts_state', coalesce(state, '<null>'), count(*)::double from $awards group by 2""")
def quality_report_long(t):
    out = reports.quality_report(t.awards, "award_id", ["title_clean"], ["award_amount"], ["state"])
    return out.withColumn("value", F.round("value", 4))


@query("""select 'start_year' as feature, 'int' as dtype, count(*) filter (where start_year is null) as n_missing, count(distinct start_year) as n_unique from $awards union all
    select 'state', 'string', count(*) filter (where state is null), count(distinct state) from $awards union all select 'award_amount', 'double', count(*) filter (where award_amount is null), count(distinct award_amount) from $awards""")
def feature_manifest(t):
    return reports.feature_manifest(t.awards.select("start_year", "state", "award_amount"))


_RULES = """(select *, null::varchar as label_design_type, null::varchar as label_integration_type from $benchmark)"""


@query(f"""with b as (select benchmark_id, coalesce(label_mmr_class, '') as c, coalesce(label_qual_signal, '') as q, coalesce(label_quant_signal, '') as n, coalesce(label_design_present, '') as d, coalesce(label_integration_present, '') as i, coalesce(label_reporting_completeness, '') as r from {_RULES})
    select benchmark_id, u.t as issue_type, case when u.t like 'explicit_%' or u.t like 'high_%' then 'review' else 'error' end as severity from b, unnest([
    'missing_label_design_type', 'invalid_label_design_type', 'missing_label_integration_type', 'invalid_label_integration_type', case when d = 'no' then 'design_no_type_real' end, case when i = 'no' then 'integration_no_type_real' end,
    case when c = '' then 'missing_label_mmr_class' end, case when c not in ('explicit_mmr', 'implicit_mmr', 'qual_only', 'quant_only', 'multi_method_not_mmr', 'unclear', 'no_method_signal') then 'invalid_label_mmr_class' end,
    case when q = '' then 'missing_label_qual_signal' end, case when q not in ('yes', 'no', 'unclear') then 'invalid_label_qual_signal' end, case when n = '' then 'missing_label_quant_signal' end, case when n not in ('yes', 'no', 'unclear') then 'invalid_label_quant_signal' end,
    case when d = '' then 'missing_label_design_present' end, case when d not in ('yes', 'no', 'unclear') then 'invalid_label_design_present' end, case when i = '' then 'missing_label_integration_present' end, case when i not in ('yes', 'no', 'unclear') then 'invalid_label_integration_present' end,
    case when r = '' then 'missing_label_reporting_completeness' end, case when r not in ('low', 'medium', 'high', 'unclear', 'none_no_report', 'minimal', 'partial', 'adequate', 'complete') then 'invalid_label_reporting_completeness' end,
    case when c = 'qual_only' and n = 'yes' then 'qual_only_with_quant_yes' end, case when c = 'quant_only' and q = 'yes' then 'quant_only_with_qual_yes' end, case when c = 'no_method_signal' and 'yes' in (q, n, d, i) then 'no_method_signal_with_method_label' end,
    case when c = 'implicit_mmr' and q <> 'yes' then 'implicit_mmr_without_qual_yes' end, case when c = 'implicit_mmr' and n <> 'yes' then 'implicit_mmr_without_quant_yes' end, case when c = 'explicit_mmr' and q <> 'yes' then 'explicit_mmr_without_qual_yes' end,
    case when c = 'explicit_mmr' and n <> 'yes' then 'explicit_mmr_without_quant_yes' end, case when r = 'high' and c in ('no_method_signal', 'unclear') then 'high_reporting_without_method_signal' end]) as u(t) where u.t is not null""")
def issue_rules(t):
    rows = t.benchmark.withColumn("label_design_type", F.lit(None).cast("string")).withColumn("label_integration_type", F.lit(None).cast("string"))
    return reports.rule_issues(rows, reports.label_rules(), ["benchmark_id"]).select("benchmark_id", "issue_type", "severity")


@query("""select benchmark_id, ((label_mmr_class = 'qual_only' and label_quant_signal = 'yes')::int + (label_mmr_class = 'quant_only' and label_qual_signal = 'yes')::int)::bigint as n_error, (label_reporting_completeness = 'high' and label_mmr_class in ('no_method_signal', 'unclear'))::bigint as n_review from $benchmark""")
def issue_pivot(t):
    names = ("qual_only_with_quant_yes", "quant_only_with_qual_yes", "high_reporting_without_method_signal")
    rows = t.benchmark.withColumn("label_design_type", F.lit("none")).withColumn("label_integration_type", F.lit("none"))
    issues = reports.rule_issues(rows, [r for r in reports.label_rules() if r[1] in names], ["benchmark_id"])
    return reports.issue_pivot(t.benchmark.select("benchmark_id"), issues, "benchmark_id")


@query("select 'nsforganization' as column, nsforganization as value, count(*) as n from $flagged where nsforganization is not null and nsforganization not in ('DUE', 'DRL', 'EES', 'DGE', 'EEC') group by 2")
def outside_vocabulary(t):
    return reports.outside_vocabulary(t.flagged, {"nsforganization": ["DUE", "DRL", "EES", "DGE", "EEC"]})


@query("""with j as (select trim(label_qual_signal) as a, trim(label_quant_signal) as b from $benchmark where trim(label_qual_signal) <> '' and trim(label_quant_signal) <> ''), n as (select count(*) as n, avg((a = b)::int) as p from j),
    e as (select sum(x.c * y.c)::double / any_value(n.n) / any_value(n.n) as e from (select a, count(*) as c from j group by 1) x join (select b, count(*) as c from j group by 1) y on x.a = y.b, n)
    select 'signals' as label, n.n, round(n.p, 4) as agreement, round((n.p - e.e) / (1 - e.e), 4) as kappa from n, e""")
def kappa(t):
    return reports.agreement(t.benchmark, {"signals": ("label_qual_signal", "label_quant_signal")})


@query("select organization_clean as value, count(*) as n from $awards where organization_clean is not null group by 1 order by n desc, value limit 10")
def top_categories(t):
    return reports.top_values(t.awards, "organization_clean", 10)


@query("select 'others' as entity, count(*) filter (where len(co_pi_records) > 0) as n_covered, count(*) as n_rows from $awards")
def entity_coverage(t):
    return reports.coverage(t.awards, {"others": "co_pi_records"})


@query("""with a as (select distinct award_id from $awards where award_id is not null), b as (select distinct award_id from documents where award_id is not null)
    select (select count(*) from a) as n_left, (select count(*) from b) as n_right, (select count(*) from a semi join b using (award_id)) as n_both, (select count(*) from a anti join b using (award_id)) as n_left_only, (select count(*) from b anti join a using (award_id)) as n_right_only""")
def match_report(t):
    return reports.match_report(t.awards, t.documents, "award_id")


_ALL = sorted("award_id awardinstrument abstract_clean benchmark_id benchmark_version cluster_size label_design_present label_integration_present label_mmr_class label_qual_signal label_quant_signal label_reporting_completeness label_source nsfdirectorate nsforganization organization_clean person_id pi_clean primary_program_key project_cluster_id split_cold_start_institution_cluster_safe split_cold_start_pi_cluster_safe split_cross_program_cluster_safe split_edu_to_eng_cluster_safe split_random_cluster_stratified split_temporal_cluster_safe start_year state target_mmr_binary title_clean".split())
_ROW_TEXT = " || '|' || ".join(f"coalesce({c}::varchar, '∅')" for c in _ALL)


@query(f"select count(*) as n_rows, sum(('0x' || left(d, 12))::bigint)::decimal(38, 0)::varchar || ':' || sum(('0x' || substr(d, 13, 12))::bigint)::decimal(38, 0)::varchar as digest from (select sha256({_ROW_TEXT}) as d from $benchmark)")
def table_digest(t):
    return reports.table_digest(t.benchmark)


@query("select record_id, coalesce(nullif(trim(pi_email_extracted), ''), person_id) as contact from $awards")
def prefer_left(t):
    return t.awards.select("record_id", joins.prefer_left("pi_email_extracted", "person_id").alias("contact"))


@query("""select b.benchmark_id, r.organizationcity, r.record_id from $benchmark b left join (select * from (select *, row_number() over (partition by award_id order by record_id) as k from $awards where award_id is not null) where k = 1) r using (award_id)""")
def first_match_join(t):
    right = t.awards.select("award_id", "record_id", "organizationcity")
    return joins.first_match(t.benchmark.select("benchmark_id", "award_id"), right, "award_id", [F.col("record_id")]).select("benchmark_id", "organizationcity", "record_id")


@query("select o.o_orderkey, coalesce(e.label, 0) as label, (e.vec_id is null)::int as embedding_missing from orders o left join embeddings e on e.vec_id = o.o_orderkey")
def fusion_join(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("o_orderkey"), "label")
    return joins.one_to_one(t.orders.select("o_orderkey"), vectors, "o_orderkey", 0)


@query("select d.doc_id, (e.vec_id is null)::int as embedding_missing, round(coalesce(e.embedding[1], 0)::double, 6) as first from documents d left join embeddings e on e.vec_id = d.doc_id")
def embedding_align(t):
    out = joins.align_vectors(t.documents.select("doc_id"), t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", 64)
    return out.select("doc_id", "embedding_missing", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("""with a as (select award_id, min(state) as state from $awards where trim(award_id) <> '' group by 1), b as (select award_id, min(lang) as state from documents where trim(award_id) <> '' group by 1)
    select award_id, coalesce(nullif(trim(a.state), ''), b.state) as state, case when b.award_id is null then 'corpus' when a.award_id is null then 'extra' else 'both' end as source from a full outer join b using (award_id)""")
def union_corpus(t):
    a = t.awards.where("trim(award_id) <> ''").groupBy("award_id").agg(F.min("state").alias("state"))
    b = t.documents.where("trim(award_id) <> ''").groupBy("award_id").agg(F.min("lang").alias("state"))
    return joins.union_corpus(a, b, "award_id", ["state"])


@query("""select award_id, arg_max(t, {'n': length(t), 't': t}) as text from (select award_id, coalesce(abstract_clean, '') as t from $awards where award_id is not null union all select award_id, coalesce(text, '') from documents where award_id is not null) group by 1""")
def longest_text(t):
    return joins.longest_text([t.awards.select("award_id", F.col("abstract_clean").alias("text")), t.documents.select("award_id", "text")], "award_id", "text")


@query("select benchmark_id, label_mmr_class from $benchmark where lower(trim(label_mmr_class)) not in ('', 'nan', 'none', 'null', 'unclear', 'unknown')")
def usable_target(t):
    return joins.usable_target(t.benchmark, "label_mmr_class").select("benchmark_id", "label_mmr_class")


@query("select record_id from $awards semi join (select award_id from $benchmark) b using (award_id)")
def semi_join_expand(t):
    return t.awards.join(t.benchmark.select("award_id"), "award_id", "left_semi").select("record_id")


@query("select record_id from $awards a where not exists (select 1 from $benchmark b where b.award_id = a.award_id)")
def anti_join_rest(t):
    return t.awards.join(t.benchmark.select("award_id"), "award_id", "left_anti").select("record_id")


@query("(select institution_id from $awards intersect select institution_id from documents) union (select institution_id from $awards except select institution_id from documents)")
def set_operations(t):
    a, b = t.awards.select("institution_id"), t.documents.select("institution_id")
    return a.intersect(b).union(a.subtract(b)).distinct()


@query("select benchmark_id, trim(regexp_replace(lower(trim(coalesce(label_mmr_class, ''))), '[^a-z0-9]+', '_', 'g'), '_') as label from $benchmark")
def canonical_labels(t):
    named = t.benchmark.select("benchmark_id", F.col("label_mmr_class").alias("label_x_name"))
    return joins.canonical_columns(named, {"label_x": "label_x"}).select("benchmark_id", label("label_x").alias("label"))
