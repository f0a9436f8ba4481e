"""Queries of column selection, program keys, people cells, fusion, node features, preprocessing and the wide history row."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tesserae.functions import people, signals, text
from tesserae.functions.numeric import wants_log
from tesserae.functions.text import codes
from tesserae.operators import edges, experiments, features, history, joins, metrics, models, reports, sampling
from tesserae.operators.skew import attach, lookup
from tesserae.plans import sql as s
from tesserae.plans.graph_queries import _ENTITIES, _entities
from tesserae.plans.model_queries import _SCORED, _labelled, _scored
from tesserae.plans.registry import query

# columns by name and role; DuckDB knows the columns of the table by itself
_COLUMNS = "(select column_name as c from information_schema.columns where table_name = '$benchmark')"
_LEAKY = "(c in ({}) or {} or {})".format(", ".join(f"'{n}'" for n in sorted(joins.LEAKY_NAMES)), " or ".join(f"starts_with(c, '{p}')" for p in joins.LEAKY_STARTS), " or ".join(f"contains(c, '{p}')" for p in joins.LEAKY_PARTS))


def _listed(t, rows, schema):
    return t.spark.createDataFrame(rows, schema)


@query("select benchmark_id, award_id, title_clean, start_year, state from $benchmark")
def safe_projection(t):
    return joins.safe_columns(t.benchmark, ["benchmark_id", "award_id", "not_there", "title_clean", "state"], optional="start_year", after="title_clean")


@query(f"select c as column, case when starts_with(c, 'target_') then 'target' when starts_with(c, 'split_') then 'split' when starts_with(c, 'label_') then 'label' when c like '%\\_id' escape '\\' then 'identifier' when c like '%\\_clean' escape '\\' then 'text' when c in ('state', 'start_year') then 'feature' when {_LEAKY} then 'leakage' else 'other' end as role from {_COLUMNS}")
def column_roles(t):
    return _listed(t, joins.column_roles(t.benchmark, {"state", "start_year"}), "column string, role string")


@query(f"select c as column, {_LEAKY} as leaky from {_COLUMNS}")
def leak_filter(t):
    return _listed(t, [(c, joins.is_leaky(c)) for c in t.benchmark.columns], "column string, leaky boolean")


@query("select * exclude (label_source, split_random_cluster_stratified, split_temporal_cluster_safe, split_edu_to_eng_cluster_safe, split_cross_program_cluster_safe, split_cold_start_pi_cluster_safe, split_cold_start_institution_cluster_safe, target_mmr_binary) from $benchmark")
def drop_generated(t):
    return joins.drop_generated(t.benchmark, ["label_source", "not_there"], ["split_", "target_"])


@query(f"select c as column from (select * from {_COLUMNS} union all select unnest(['g_degree', 'm_size', 'cat_kind', 'g_candidate_share'])) where (starts_with(c, 'g_') or starts_with(c, 'm_') or starts_with(c, 'cat_')) and not {_LEAKY}")
def feature_columns(t):
    rows = t.benchmark.withColumns({c: F.lit(1) for c in ("g_degree", "m_size", "cat_kind", "g_candidate_share")})
    return _listed(t, [(c,) for c in joins.select_features(rows)], "column string")


@query("select benchmark_id, state, start_year from $benchmark")
def drop_all_missing(t):
    rows = t.benchmark.select("benchmark_id", "state", "start_year", F.lit(None).cast("double").alias("g_never"))
    return reports.drop_all_missing(rows, ["state", "start_year", "g_never"])


@query("select * from (values ('Program(s)', 'f_Program_s'), ('NSF Org.', 'f_NSF_Org'), ('  x  ', 'f_x')) v(name, safe)")
def column_names(t):
    return _listed(t, [(n, text.column_name(n, "f_")) for n in ("Program(s)", "NSF Org.", "  x  ")], "name string, safe string")




@query("""select record_id, case when v in ('', 'nan', 'none', 'null') then null when v in ('true', 'yes') then '1' when v in ('false', 'no') then '0' when try_cast(v as double) = floor(try_cast(v as double)) then try_cast(v as double)::bigint::varchar else v end as label
    from (select record_id, lower(trim(case record_id % 6 when 0 then team_size::varchar || '.0' when 1 then state when 2 then 'Yes' when 3 then ' false' when 4 then 'NaN' else null end)) as v from $awards)""")
def class_labels(t):
    kind = F.col("record_id") % 6
    cell = F.when(kind == 0, F.concat(F.col("team_size").cast("string"), F.lit(".0"))).when(kind == 1, F.col("state")).when(kind == 2, "Yes").when(kind == 3, " false").when(kind == 4, "NaN")
    return t.awards.select("record_id", text.class_label(cell).alias("label"))


@query(f"""select record_id, coalesce('element:' || {s.codes('programelementcodes')}[1], 'name:' || nullif({s.label('programs')}, ''), 'missing_program') as primary_program_key,
    case when len({s.codes('programelementcodes')}) > 0 then 'ProgramElementCode' when {s.label('programs')} <> '' then 'ProgramNameFallback' else 'MissingProgram' end as primary_program_source,
    coalesce('element_' || {s.codes('programelementcodes')}[1], 'name_' || left(nullif({s.id_text('programs')}, ''), 80), 'unknown_program') as history_key from $awards""")
def program_key(t):
    key, source = text.primary_program("programelementcodes", "programs")
    return t.awards.select("record_id", key.alias("primary_program_key"), source.alias("primary_program_source"), text.history_program("programelementcodes", "programs").alias("history_key"))


def _names_sql(x: str) -> str:
    parts = f"list_filter(list_transform(regexp_split_to_array({s.squeeze(x)}, '[;|]'), lambda p: {{'k': trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')), 'v': trim(p)}}), lambda p: p.k <> '')"
    return f"list_filter({parts}, lambda p, i: list_position(list_transform({parts}, lambda q: q.k), p.k) = i)"


_PROGRAM_ROWS = f"""(select distinct award_id, p.source as source, p.code as program_code, p.name as program_name from (select award_id, unnest(case when len({s.codes('programelementcodes')}) > 0 then list_transform({s.codes('programelementcodes')}, lambda c: {{'source': 'code', 'code': c, 'name': ''}})
    when len({_names_sql('programs')}) > 0 then list_transform({_names_sql('programs')}, lambda n: {{'source': 'name', 'code': '', 'name': n.v}}) else [{{'source': 'unknown', 'code': '', 'name': 'unknown_program'}}] end) as p from $awards))"""


@query(f"select award_id, source, program_code, program_name, {s.stable_id('program', '(program_code || program_name)')} as program_id from {_PROGRAM_ROWS}")
def edges_program_all(t):
    return edges.program_edges(t.awards, "award_id", "programelementcodes", "programs")


@query(f"select record_id, u.n.v as name from (select record_id, unnest({_names_sql('programs')}) as n from $awards) u")
def program_names(t):
    return t.awards.select("record_id", F.explode(text.names_once("programs")).alias("name"))


# cells as they are typed: several people with commas between them, addresses, line ends, tags of a table export
_CELL = """case record_id % 5 when 0 then coalesce(pi_clean, '') || ', ' || 'Ann B. Cole, Dora Fenn' when 1 then coalesce(pi_clean, '') || ' a' || record_id || '@x.example, Gil Hart b' || record_id || '@y.example' when 2 then 'Hart, Gil' when 3 then coalesce(pi_clean, '') || '   and   Ida Jones' || chr(10) || 'Kay Lunn / Max Nord' else coalesce(pi_clean, '') || ' | Ola Pike; Ola Pike' end"""


def _cell():
    name, kind, no = F.coalesce("pi_clean", F.lit("")), F.col("record_id") % 5, F.col("record_id").cast("string")
    mails = F.concat(name, F.lit(" a"), no, F.lit("@x.example, Gil Hart b"), no, F.lit("@y.example"))
    return F.when(kind == 0, F.concat(name, F.lit(", Ann B. Cole, Dora Fenn"))).when(kind == 1, mails).when(kind == 2, "Hart, Gil").when(kind == 3, F.concat(name, F.lit("   and   Ida Jones\nKay Lunn / Max Nord"))).otherwise(F.concat(name, F.lit(" | Ola Pike; Ola Pike")))


_TOK = lambda x: f"len(regexp_extract_all({s.clean_name(x)}, '[A-Za-z]+'))"
_PEOPLE_CELLS = f"""with cells as (select record_id, {_CELL} as cell from $awards),
    a as (select record_id, unnest(string_split(regexp_replace(regexp_replace(cell, '\\r\\n|\\r|\\n|\\s*[|/]\\s*', ';', 'g'), '\\s{{2,}}and\\s{{2,}}', ';', 'g'), ';')) as p from cells),
    b as (select record_id, unnest(case when len(regexp_extract_all(p, '{s.EMAIL}')) >= 2 then string_split(regexp_replace(p, '({s.EMAIL})', '\\1' || chr(1), 'g'), chr(1)) else [p] end) as p from a),
    c as (select record_id, trim(regexp_replace(p, '\\s+', ' ', 'g'), ' ,;') as p, list_filter(list_transform(string_split(trim(p, ' ,;'), ','), lambda x: trim(x)), lambda x: x <> '') as parts from b),
    d as (select record_id, unnest(case when len(list_filter(parts[2:], lambda x: {_TOK('x')} >= 2)) > 0 or (len(parts) >= 3 and {_TOK('parts[1]')} >= 2) then parts else [p] end) as p from c where p <> ''),
    n as (select record_id, {s.clean_name('p')} as name, {s.first_email('p')} as email from d)
    select distinct record_id, {s.person_id('name', 'email')} as person_id from n where name <> '' or email <> ''"""


@query(_PEOPLE_CELLS)
def people_cells(t):
    return edges.people(t.awards.select("record_id", _cell().alias("cell")), "record_id", "cell").select("record_id", "person_id")


@query("select record_id, coalesce(c.person_id, '') as person_id, coalesce(c.name, '') as name, coalesce(c.email, '') as email from (select record_id, unnest(co_pi_records) as c from $awards) where c.person_id <> '' or c.name <> '' or c.email <> ''")
def literal_records(t):
    """The list of records of each award, written as a literal and read again."""
    quoted = lambda c: F.when(c.isNull(), "None").otherwise(F.concat(F.lit("'"), F.regexp_replace(c, r"(['\\])", r"\\$1"), F.lit("'")))
    item = lambda r: F.concat(F.lit("{'person_id': "), quoted(r["person_id"]), F.lit(", 'name': "), quoted(r["name"]), F.lit(", 'email': "), quoted(r["email"]), F.lit("}"))
    cell = F.concat(F.lit("["), F.array_join(F.transform("co_pi_records", item), ", "), F.lit("]"))
    return t.awards.select("record_id", F.explode(people.literal_people(cell)).alias("r")).select("record_id", "r.*")


@query(f"select award, kind, entity from {_ENTITIES}")
def entity_table(t):
    return _entities(t)


@query("select d.doc_id, d.institution_id, i.n_awards from documents d left join (select institution_id, count(*) as n_awards from $awards group by 1) i on i.institution_id is not distinct from d.institution_id")
def attached_counts(t):
    sizes = t.awards.groupBy("institution_id").agg(F.count("*").alias("n_awards"))
    return attach(t.documents.select("doc_id", "institution_id"), sizes, ["institution_id"])


@query("select e.edge_id, e.institution_id, i.name from $edges e join (select institution_id, min(organization_clean) as name from $awards group by 1) i on i.institution_id = e.institution_id")
def dictionary_lookup(t):
    names = t.awards.groupBy("institution_id").agg(F.min("organization_clean").alias("name"))
    return lookup(t.edges.select("edge_id", "institution_id"), names, "institution_id").select("edge_id", "institution_id", "name")


_KEY = "case when regexp_matches(award_id, '^0+$') then '0' else ltrim(regexp_replace(award_id, '[^0-9A-Za-z]', '', 'g'), '0') end"


@query(f"""with g as (select {_KEY} as k, count(*) as n_edges, min(start_year) as first_year from $edges where trim(award_id) <> '' group by 1), m as (select {_KEY} as k, count(*) as n_texts from documents where trim(award_id) <> '' group by 1)
    select b.benchmark_id, g.n_edges as graph__n_edges, g.first_year as graph__first_year, m.n_texts as meta__n_texts from (select benchmark_id, {_KEY} as k from $benchmark) b left join g using (k) left join m using (k)""")
def feature_fusion(t):
    graph = t.edges.where("trim(award_id) <> ''").groupBy("award_id").agg(F.count("*").alias("n_edges"), F.min("start_year").alias("first_year"))
    meta = t.documents.where("trim(award_id) <> ''").groupBy("award_id").agg(F.count("*").alias("n_texts"), F.min("doc_id").alias("candidate_id"))
    return joins.fuse(t.benchmark.select("benchmark_id", "award_id"), "award_id", {"graph": graph, "meta": meta}, "award_id")[0].drop("award_id")


@query("""with k as (select state as v from $awards where state is not null group by 1 order by count(*) desc, 1 limit 2), c as (select u as v from (select unnest(list_distinct(list_filter(string_split(coalesce(programelementcodes, ''), '|'), lambda x: x <> ''))) as u from $awards) group by 1 order by count(*) desc, 1 limit 2)
    select record_id, round(case when start_year is null then 0 else (start_year - min(start_year) over ())::double / (max(start_year) over () - min(start_year) over ()) end, 6) as x_year, round(ln(1 + greatest(coalesce(award_amount, 0), 0)), 6) as x_award_amount_log1p,
    coalesce((state = (select v from k order by (select count(*) from $awards a where a.state = v) desc, v limit 1))::int, 0)::double as first_state, coalesce((state in (select v from k))::int, 0)::double as any_top_state from $awards""")
def node_features(t):
    out = experiments.award_node_features(t.awards, "record_id", "start_year", ["award_amount"], ["state"], top=2)
    states = [c for c in out.columns if c.startswith("x_state")]
    top = states[:2]
    return out.select("record_id", F.round("x_year", 6).alias("x_year"), F.round("x_award_amount_log1p", 6).alias("x_award_amount_log1p"), F.col(f"`{top[0]}`").cast("double").alias("first_state"), F.greatest(*[F.col(f"`{c}`").cast("double") for c in top]).alias("any_top_state"))


@query("""with f as (select institution_id, ln(1 + count(distinct award_id)) as c, min(start_year) as lo, max(start_year) as hi from $awards group by 1) select institution_id, lo as first_year, hi as last_year, round((c - min(c) over ()) / (max(c) over () - min(c) over ()), 6) as log_count_scaled,
    round(coalesce((lo - min(lo) over ())::double / (max(lo) over () - min(lo) over ()), 0), 6) as first_year_scaled, round(coalesce((hi - min(hi) over ())::double / (max(hi) over () - min(hi) over ()), 0), 6) as last_year_scaled from f""")
def entity_features_all(t):
    """Entities without any year too: their scaled years are 0."""
    out = edges.entity_features(t.awards, "institution_id", "award_id", "start_year")
    return out.select("institution_id", "first_year", "last_year", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in ("log_count", "first_year", "last_year")])


@query(f"""select benchmark_id, coalesce((label_mmr_class in ('explicit_mmr', 'implicit_mmr'))::int, 0)::int as mmr, case label_qual_signal when 'yes' then 1 when 'no' then 0 end as qual from $benchmark where label_mmr_class = 'unclear' or label_qual_signal = 'unclear'""")
def unclear_targets(t):
    """The rows that say unclear: no positive class, and no value of the signal."""
    rows = signals.label_targets(t.benchmark.where("label_mmr_class = 'unclear' or label_qual_signal = 'unclear'"))
    return rows.select("benchmark_id", F.coalesce(F.col("target_mmr"), F.lit(0)).cast("int").alias("mmr"), F.col("target_qual").alias("qual"))


@query("select d.doc_id, d.n_chars, (e.vec_id is not null)::int as has_text_embedding, round(coalesce(e.embedding[2], 0)::double, 5) as second from documents d left join embeddings e on e.vec_id = d.doc_id")
def text_node_features(t):
    out = experiments.with_text_features(t.documents.select("doc_id", "n_chars"), "doc_id", t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), "embedding", 64)
    return out.select("doc_id", "n_chars", "has_text_embedding", F.round(F.get("embedding", F.lit(1)).cast("double"), 5).alias("second"))


@query("select o_orderkey, round(coalesce(embedding[1], 0)::double, 5) as emb_000, round(coalesce(embedding[2], 0)::double, 5) as emb_001, round(coalesce(embedding[3], 0)::double, 5) as emb_002 from orders left join embeddings on vec_id = o_orderkey")
def vector_export(t):
    aligned = joins.align_vectors(t.orders.select("o_orderkey"), t.embeddings.withColumnRenamed("vec_id", "o_orderkey"), "o_orderkey", "embedding", 64)
    out = features.expand_vector(aligned.select("o_orderkey", "embedding"), "embedding", 3)
    return out.select("o_orderkey", *[F.round(F.col(c).cast("double"), 5).alias(c) for c in ("emb_000", "emb_001", "emb_002")])


@query("""with m as (select avg(award_amount) as a, avg(team_size) as t from $awards), f as (select record_id, coalesce(award_amount, a) as x, coalesce(team_size, t)::double as y from $awards, m)
    select record_id, round((x - avg(x) over ()) / stddev_samp(x) over (), 5) as amount, round((y - avg(y) over ()) / stddev_samp(y) over (), 5) as team from f""")
def scaled_numbers(t):
    rows = t.awards.select("record_id", F.col("award_amount").cast("double").alias("award_amount"), F.col("team_size").cast("double").alias("team_size"))
    out = features.preprocessing(["award_amount", "team_size"], [], fill="mean").fit(rows).transform(rows).withColumn("v", vector_to_array("features"))
    return out.select("record_id", F.round(F.get("v", F.lit(0)), 5).alias("amount"), F.round(F.get("v", F.lit(1)), 5).alias("team"))


@query("""with c as (select label_mmr_class as y, case when label_qual_signal = 'yes' and label_quant_signal = 'yes' then 'implicit_mmr' when label_qual_signal = 'yes' then 'qual_only' when label_quant_signal = 'yes' then 'quant_only' else 'no_method_signal' end as p from $benchmark where label_mmr_class is not null),
    l as (select distinct y as label from c union select distinct p from c), r as (select label, coalesce(2.0 * count(*) filter (where y = label and p = label) / nullif(count(*) filter (where y = label) + count(*) filter (where p = label), 0), 0)::double as f1, count(*) filter (where y = label) as support from l, c group by 1)
    select (select count(*) from c) as n, round((select avg((y = p)::int) from c), 6) as accuracy, round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1 from r""")
def multiclass_metrics(t):
    out = metrics.summary_metrics(metrics.confusion_counts(_labelled(t)))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query(f"""with c as (select y_true as y, y_pred as p, score from {_SCORED}), r as (select v.k, coalesce(2.0 * count(*) filter (where y = k and p = k) / nullif(count(*) filter (where y = k) + count(*) filter (where p = k), 0), 0)::double as f1, count(*) filter (where y = k) as support,
    coalesce(count(*) filter (where y = k and p = k) / nullif(count(*) filter (where p = k), 0)::double, 0) as precision, coalesce(count(*) filter (where y = k and p = k) / nullif(count(*) filter (where y = k), 0)::double, 0) as recall from c, (values (0), (1)) v(k) group by 1)
    select (select count(*) from c) as n, round((select avg((y = p)::int) from c), 6) as accuracy, round(avg(f1), 6) as macro_f1, round(sum(f1 * support) / sum(support), 6) as weighted_f1, round(max(f1) filter (where k = 1), 6) as f1_pos, round(max(precision) filter (where k = 1), 6) as precision_pos, round(max(recall) filter (where k = 1), 6) as recall_pos,
    round((select avg(case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end) from c a, c b where a.y = 1 and b.y = 0), 6) as roc_auc from r""")
def binary_summary(t):
    out = metrics.binary_metrics(_scored(t), score="score").drop("average_precision")
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns if c != "n"])


@query("""with o as (select l.c, (e.label = l.c)::int as y, e.embedding[l.c + 1]::double as s from embeddings e, (select distinct label as c from embeddings) l), a as (select p.c, avg(case when p.s > n.s then 1.0 when p.s = n.s then 0.5 else 0 end) as auc from o p, o n where p.c = n.c and p.y = 1 and n.y = 0 group by 1)
    select round(avg(auc), 6) as macro_auc, count(*)::int as classes from a""")
def macro_auc(t):
    rows = t.embeddings.select(F.col("label").cast("string").alias("y_true"), F.col("embedding").cast("array<double>").alias("scores"))
    classes = sorted((r["label"] for r in metrics.label_index(rows, "y_true").collect()), key=int)
    value = metrics.macro_ovr_auc(rows, classes)
    return _listed(t, [(round(value, 6) if value is not None else None, len(classes))], "macro_auc double, classes int")


@query("select vec_id, round(embedding[2]::double, 5) as a, 0.0::double as b, round(embedding[1]::double, 5) as c from embeddings")
def aligned_scores(t):
    out = metrics.align_scores(t.embeddings.select("vec_id", F.col("embedding").alias("scores")), "vec_id", ["c", "a"], ["a", "b", "c"])
    return out.select("vec_id", *[F.round(F.get("scores", F.lit(k)).cast("double"), 5).alias(n) for k, n in enumerate("abc")])


@query("""select 'label_mmr_class' as target, case when count(distinct label_mmr_class) <= 2 then 'binary' else 'multiclass' end as task from $benchmark union all select 'target_mmr_binary', case when count(distinct target_mmr_binary) <= 2 then 'binary' else 'multiclass' end from $benchmark union all select 'label_qual_signal', 'binary'""")
def task_types(t):
    rows = [(c, metrics.infer_task(t.benchmark, c, how)) for c, how in (("label_mmr_class", "auto"), ("target_mmr_binary", "auto"), ("label_qual_signal", "binary"))]
    return _listed(t, rows, "target string, task string")


_TARGET = "nullif(nullif(nullif(nullif(regexp_replace(lower(trim({})), '[\\s-]+', '_', 'g'), ''), 'nan'), 'none'), 'unclear')"


@query(f"""with b as (select benchmark_id, {_TARGET.format('label_qual_signal')} as q, {_TARGET.format('label_mmr_class')} as c from $benchmark) select b.benchmark_id, case q when 'yes' then 1.0 when 'no' then 0.0 end::double as qual, i.i::double as class
    from b left join (select c, row_number() over (order by c) - 1 as i from (select distinct c from b where c is not null)) i using (c)""")
def prepared_targets(t):
    rows = metrics.prepared_target(t.benchmark.select("benchmark_id", "label_qual_signal", "label_mmr_class"), "label_qual_signal", "binary", name="qual")
    return metrics.prepared_target(rows, "label_mmr_class", "multiclass", name="class").select("benchmark_id", "qual", "class")


@query("""with m as (select distinct 'institution' as kind, institution_id as entity, record_id as idx from $awards where institution_id is not null union select distinct 'org', nsforganization, record_id from $awards where nsforganization is not null), y as (select record_id as idx, start_year as year from $awards),
    k as (select kind, idx as dst, unnest(list(idx) over (partition by kind, entity order by year nulls first, idx rows between 5 preceding and 1 preceding)) as src from m join y using (idx) where kind = 'institution'
        union all select kind, idx, unnest(list(idx) over (partition by kind, entity order by year nulls first, idx rows between 2 preceding and 1 preceding)) from m join y using (idx) where kind = 'org'),
    e as (select src, dst, case when bool_or(kind = 'institution') then 'institution' else 'org' end as kind from k group by 1, 2), g as (select kind, entity, count(*) as n from m group by 1, 2)
    select kind, count(*) as n_groups, count(*) filter (where n = 1) as n_singletons, (select count(*) from e where e.kind = g.kind) as n_edges_added from g group by 1""")
def last_k_summary(t):
    inst = t.awards.where("institution_id is not null").select(F.lit("institution").alias("kind"), F.col("institution_id").alias("entity"), F.col("record_id").alias("idx"), F.col("start_year").alias("year"))
    org = t.awards.where("nsforganization is not null").select(F.lit("org").alias("kind"), F.col("nsforganization").alias("entity"), F.col("record_id").alias("idx"), F.col("start_year").alias("year"))
    return history.last_k_summary(inst.unionByName(org), {"institution": 5, "org": 2})


@query("""with c as (select label_mmr_class as y, count(*) as n from $benchmark where label_mmr_class is not null group by 1), s as (select y, coalesce(sum(n) over (order by y rows between unbounded preceding and 1 preceding), 0) as low, sum(n) over (order by y) as high from c)
    select y as y_pred, (high - low)::bigint as n_places from s""")
def drawn_class_shares(t):
    """The places of each class in the draw of the stratified dummy model: as many as it has training rows."""
    n = t.benchmark.where("label_mmr_class is not null").count()
    drawn = models.draw_classes(t.benchmark, t.spark.range(max(n, 1)).withColumnRenamed("id", "key"), "label_mmr_class", "key")
    assert drawn.where("y_pred is null").count() == 0 or n == 0
    return t.benchmark.where("label_mmr_class is not null").groupBy(F.col("label_mmr_class").alias("y_pred")).agg(F.count("*").alias("n_places")).join(drawn.select("y_pred").distinct(), "y_pred")


def _by_split(t):
    rows = t.benchmark.withColumn("split", F.lower(F.trim("split_random_cluster_stratified"))).withColumn("x", F.concat_ws(" ", "title_clean", "abstract_clean"))
    return rows.where("label_qual_signal in ('yes', 'no')")


@query()
def svm_calibrated(t):
    rows = _by_split(t)
    model, _ = models.term_classifier(rows.where("split = 'train'").select("x", "label_qual_signal"), "x", "label_qual_signal", "svm")
    score = models.calibrated(model, rows.where("split = 'validation'").select("x", "label_qual_signal"), "x", "label_qual_signal", "yes")
    return score(rows.where("split = 'test'").select("benchmark_id", "x")).select("benchmark_id", F.round("score", 4).alias("score"))


@query()
def term_lr(t):
    rows = _by_split(t)
    model, labels = models.term_classifier(rows.where("split = 'train'").select("x", "label_qual_signal"), "x", "label_qual_signal")
    return models.classify(model, rows.where("split = 'test'").select("benchmark_id", "x"), "x", labels).select("benchmark_id", "y_pred")


_BASE = f"""base as (select award_id, start_year as year, person_id as lead, institution_id as institution, coalesce({s.codes('programelementcodes')}[1], '') as program, coalesce(upper(trim(nsforganization)), '') as org, coalesce(upper(trim(nsfdirectorate)), '') as directorate, coalesce(trim(state), '') as state, coalesce(awardinstrument, '') as instrument
    from (select *, row_number() over (partition by award_id order by record_id) as k from $awards where award_id is not null) where k = 1 and start_year is not null),
    e as (select distinct award_id, person_id as person from $edges where trim(person_id) <> ''), team as (select * from e union select award_id, lead from base where trim(lead) <> '' and award_id not in (select award_id from e)),
    d as materialized (select t.award_id, t.person, b.year, b.institution, b.program, b.org, b.directorate, b.state from team t join base b using (award_id)), met as materialized (select distinct x.person as a, y.person as b, x.year from d x join d y on x.award_id = y.award_id and x.person <> y.person),
    pf as materialized (select person, year, (select count(*) from d o where o.person = p.person and o.year < p.year) as n, (select count(distinct b) from met where a = p.person and met.year < p.year) as mates, (select count(distinct institution) from d o where o.person = p.person and o.year < p.year and trim(institution) <> '') as insts,
        (select count(distinct program) from d o where o.person = p.person and o.year < p.year and trim(program) <> '') as progs, (select min(year) from d o where o.person = p.person and o.year < p.year) as lo, (select max(year) from d o where o.person = p.person and o.year < p.year) as hi from (select distinct person, year from d) p),
    tf as materialized (select d.award_id, avg((pf.n > 0)::int) as seen, {', '.join(f"sum(pf.{c})::double as {c}_sum, avg(pf.{c}) as {c}_mean, max(pf.{c})::double as {c}_max, min(pf.{c})::double as {c}_min, count(*) filter (where pf.{c} <> 0) as {c}_nonzero" for c in ('n', 'mates', 'insts', 'progs'))} from d join pf on pf.person = d.person and pf.year = d.year group by 1),
    pairs as (select x.award_id, x.year, x.person as a, y.person as b from d x join d y on x.award_id = y.award_id and x.person < y.person), pn as (select award_id, (select count(*) from pairs q where q.a = p.a and q.b = p.b and q.year < p.year) as n from pairs p),
    pp as materialized (select award_id, sum(n)::double as s, avg(n) as m, max(n)::double as hi, min(n)::double as lo, count(*) filter (where n <> 0) as nz from pn group by 1)"""
_BLOCK = lambda c, o: f"(select count(*) from base o where o.{c} = b.{c} and o.year < b.year), (select count(distinct person) from d where d.{c} = b.{c} and d.year < b.year), (select count(distinct {o}) from d where d.{c} = b.{c} and d.year < b.year and trim({o}) <> ''), (select count(distinct year) from base o where o.{c} = b.{c} and o.year < b.year)"
_SINCE = lambda c, f: f"coalesce(b.year - (select {f}(year) from base o where o.{c} = b.{c} and o.year < b.year), 0)"
_KNOWN = lambda c, other: f"coalesce(nullif(trim(b.{c}), ''), '{other}')"
_STATS = ("sum", "mean", "max", "min", "nonzero")
_WIDE: dict[str, str] = {
    "award_id": "b.award_id", "year": "b.year", "m_team_size": "(select count(*) from d where d.award_id = b.award_id)", "cat_institution": _KNOWN("institution", "unknown_institution"), "cat_program": _KNOWN("program", "unknown_program"), "cat_org": _KNOWN("org", "unknown"),
    "cat_directorate": _KNOWN("directorate", "unknown"), "cat_state": _KNOWN("state", "unknown_state"), "cat_instrument": _KNOWN("instrument", "unknown"), "m_start_year": "b.year", "m_num_co_pis": "greatest((select count(*) from d where d.award_id = b.award_id) - 1, 0)",
    "m_has_copi": "((select count(*) from d where d.award_id = b.award_id) > 1)::int", "m_num_current_participants": "(select count(*) from d where d.award_id = b.award_id)",
    "g_lead_prior_awards": "coalesce(l.n, 0)", "g_lead_prior_collaborators": "coalesce(l.mates, 0)", "g_lead_prior_institutions": "coalesce(l.insts, 0)", "g_lead_prior_programs": "coalesce(l.progs, 0)", "g_lead_years_since_first": "coalesce(b.year - l.lo, 0)", "g_lead_years_since_last": "coalesce(b.year - l.hi, 0)",
    "g_lead_cold_start": "(coalesce(l.n, 0) = 0)::int", "g_lead_seen_before": "(coalesce(l.n, 0) > 0)::int", "g_lead_program_prior_awards": "(select count(*) from base o where concat_ws('|', o.lead, o.program) = concat_ws('|', b.lead, b.program) and o.year < b.year)",
    "g_team_seen_before_fraction": "coalesce(tf.seen, 0)", **{f"g_team_prior_{n}_{x}": f"coalesce(tf.{c}_{x}, 0)" for c, n in (("n", "awards"), ("mates", "collaborators"), ("insts", "institutions"), ("progs", "programs")) for x in _STATS},
    **{f"g_pair_prior_awards_{x}": f"coalesce(pp.{c}, 0)" for x, c in zip(_STATS, ("s", "m", "hi", "lo", "nz"))}, "g_team_any_prior_pair": "(coalesce(pp.nz, 0) > 0)::int",
}
for _c, _n, _o, _w in (("institution", "inst", "program", "programs"), ("program", "prog", "institution", "institutions"), ("org", "org", "institution", "institutions"), ("directorate", "dir", "institution", "institutions"), ("state", "state", "program", "programs")):
    _WIDE |= dict(zip((f"g_{_n}_prior_awards", f"g_{_n}_prior_people", f"g_{_n}_prior_{_w}", f"g_{_n}_prior_years"), _BLOCK(_c, _o).split(", (select ")))
    _WIDE |= {k: v if v.startswith("(select") else "(select " + v for k, v in _WIDE.items() if k.startswith(f"g_{_n}_prior")}
    if _c in ("institution", "program"):
        _WIDE |= {f"g_{_n}_years_since_first": _SINCE(_c, "min"), f"g_{_n}_years_since_last": _SINCE(_c, "max"), f"g_{_n}_cold_start": f"({_WIDE[f'g_{_n}_prior_awards']} = 0)::int", f"g_{_n}_seen_before": f"({_WIDE[f'g_{_n}_prior_awards']} > 0)::int"}
_TEXT = ("award_id", "cat_institution", "cat_program", "cat_org", "cat_directorate", "cat_state", "cat_instrument")
_LOGS = ", ".join(f"ln(1 + greatest({c}, 0)) as {c}_log1p" for c in _WIDE if wants_log(c))
_WIDE_SQL = f"with {_BASE}, w as (select {', '.join(f'{v} as {k}' for k, v in _WIDE.items())} from base b left join pf l on l.person = b.lead and l.year = b.year left join tf on tf.award_id = b.award_id left join pp on pp.award_id = b.award_id), x as (select *, {_LOGS} from w) select {', '.join(_TEXT)}, round(columns(lambda c: c not in {_TEXT!r})::double, 5) from x"


@query(_WIDE_SQL)
def history_row(t):
    rows = t.awards.where("award_id is not null").groupBy("award_id").agg(F.min_by(F.struct("start_year", "person_id", "institution_id", "programelementcodes", "nsforganization", "nsfdirectorate", "state", "awardinstrument"), "record_id").alias("r")).select("award_id", "r.*")
    program = F.coalesce(F.get(codes("programelementcodes"), F.lit(0)), F.lit(""))
    awards = rows.select("award_id", F.col("start_year").alias("year"), F.col("person_id").alias("lead"), F.col("institution_id").alias("institution"), program.alias("program"), F.upper(F.trim("nsforganization")).alias("org"), F.upper(F.trim("nsfdirectorate")).alias("directorate"), F.trim("state").alias("state"), F.col("awardinstrument").alias("instrument"))
    out = history.history_features(awards, t.edges.select("award_id", F.col("person_id").alias("person")).distinct())
    return out.select(*_TEXT, *[F.round(F.col(c).cast("double"), 5).alias(c) for c in out.columns if c not in _TEXT])


@query()
def annotation_representatives(t):
    rows = t.flagged.join(t.awards.select("record_id", "project_text_id"), "record_id")
    forced = rows.where("design_label_candidate = 1")
    return sampling.annotation_sample(rows, "record_id", "project_text_id", "candidate_stratum", 150, forced, mode="cluster_representative", abstract="has_abstract").select("annotation_id", "record_id", "annotation_duplicate_mode")
