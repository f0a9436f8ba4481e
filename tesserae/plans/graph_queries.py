"""Queries of edge tables, the typed graph, history features and walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions.lexicons import ENTITY_WEIGHTS
from tesserae.functions.text import codes
from tesserae.operators import edges, history, order, walks
from tesserae.plans import sql as s
from tesserae.plans.registry import query


@query(f"""with p as (select award_id, pi_clean as name, coalesce(pi_email_extracted, '') as email, 'PI' as role from $awards union all select award_id, c.name, coalesce(c.email, ''), 'Co-PI' from (select award_id, unnest(co_pi_records) as c from $awards)),
    q as (select award_id, role, {s.clean_name('name')} as name, email from p) select distinct award_id, {s.person_id('name', 'email')} as person_id, role from q where name <> '' or trim(email) <> ''""")
def edges_award_person(t):
    return edges.person_edges(t.awards, "award_id", "pi_clean", "pi_email_extracted", "co_pi_records", "record_id").select("award_id", "person_id", "role")


@query("""with m as (select distinct award_id, pi_id, pi_name, start_year from $edges where award_id is not null and pi_id is not null), p as (select a.award_id, a.pi_id as pi_id_1, a.pi_name as pi_name_1, b.pi_id as pi_id_2, b.pi_name as pi_name_2, least(a.start_year, b.start_year) as y from m a join m b on a.award_id = b.award_id and a.pi_id < b.pi_id)
    select pi_id_1, pi_name_1, pi_id_2, pi_name_2, count(distinct award_id) as award_count, min(y) as first_year, max(y) as last_year, coalesce(string_agg(distinct y::varchar, '|' order by y::varchar), '') as award_years, string_agg(distinct award_id, '|' order by award_id) as award_ids from p group by all""")
def edges_collab(t):
    return edges.collaboration_edges(t.edges)


@query("select distinct award_id, institution_id, organization_clean, state, start_year from $awards")
def edges_institution(t):
    return edges.institution_edges(t.awards, ["award_id", "institution_id", "organization_clean", "state", "start_year"])


_PROGRAMS = f"""(select distinct award_id, source, code as program_code, name as program_name from (select award_id, unnest(case when len({s.codes('programelementcodes')}) > 0 then list_transform({s.codes('programelementcodes')}, lambda c: {{'source': 'code', 'code': c, 'name': ''}})
    when trim(coalesce(programs, '')) <> '' then [{{'source': 'name', 'code': '', 'name': {s.squeeze('programs')}}}] else [{{'source': 'unknown', 'code': '', 'name': 'unknown_program'}}] end, recursive := true) from $awards where coalesce(programs, '') not similar to '.*[;|].*'))"""


@query(f"select award_id, source, program_code, program_name, {s.stable_id('program', '(program_code || program_name)')} as program_id from {_PROGRAMS}")
def edges_program(t):
    return edges.program_edges(t.awards.where(~F.coalesce("programs", F.lit("")).rlike("[;|]")), "award_id", "programelementcodes", "programs")


def _facts(t):
    rows = t.awards.where("award_id is not null").groupBy("award_id").agg(F.min_by(F.struct("person_id", "co_pi_records", "institution_id", "programelementcodes", "nsforganization", "nsfdirectorate", "state", "start_year"), "record_id").alias("r")).select("award_id", "r.*")
    return rows.select(F.col("award_id").alias("award"), F.col("person_id").alias("lead"), F.transform("co_pi_records", lambda c: c["person_id"]).alias("other"), F.col("institution_id").alias("institution"), codes("programelementcodes").alias("program"), F.upper(F.trim("nsforganization")).alias("org"), F.upper(F.trim("nsfdirectorate")).alias("directorate"), F.trim("state").alias("state"), F.col("start_year").cast("string").alias("year"))


_FACTS = f"(select award_id as award, person_id as lead, list_transform(co_pi_records, lambda c: c.person_id) as other, institution_id as institution, {s.codes('programelementcodes')} as program, upper(trim(nsforganization)) as org, upper(trim(nsfdirectorate)) as directorate, trim(state) as state, start_year::varchar as year from (select *, row_number() over (partition by award_id order by record_id) as k from $awards where award_id is not null) where k = 1)"
_TYPED = " union ".join(f"select '{a}' as src_type, '{rel}' as rel, '{b}' as dst_type, ({x})::varchar as src, ({y})::varchar as dst from {_FACTS}" for rel, a, b, x, y in [
    ("led_by", "award", "person", "award", "lead"), ("co_led_by", "award", "person", "award", "unnest(other)"), ("at", "award", "institution", "award", "institution"), ("funded_by", "award", "program", "award", "unnest(program)"), ("managed_by", "award", "org", "award", "org"), ("in_directorate", "award", "directorate", "award", "directorate"),
    ("in_state", "award", "state", "award", "state"), ("in_year", "award", "year", "award", "year"), ("belongs_to", "program", "org", "unnest(program)", "org"), ("part_of", "org", "directorate", "org", "directorate"), ("located_in", "institution", "state", "institution", "state"),
])
_TYPED = f"(select * from ({_TYPED}) where trim(src) <> '' and trim(dst) <> '')"


@query(f"select * from {_TYPED} union all select dst_type, 'rev_' || rel, src_type, dst, src from {_TYPED}")
def hetero_edges(t):
    return edges.typed_graph(_facts(t))


@query(f"select src_type, rel, dst_type, count(*) as n_raw, count(distinct (src, dst)) as n_distinct from {_TYPED} group by all")
def edge_summary(t):
    return edges.edge_summary(edges.typed_graph(_facts(t), reverse=False))


@query("select institution_id, (row_number() over (order by institution_id) - 1) as idx from (select distinct institution_id from $awards where institution_id is not null and lower(trim(institution_id)) not in ('', 'nan'))")
def node_index(t):
    return order.dense_index(t.awards, "institution_id")


@query(f"with n as (select type, key, row_number() over (partition by type order by key) - 1 as idx from (select src_type as type, src as key from {_TYPED} union select dst_type, dst from {_TYPED})) select e.rel, a.idx as src_idx, b.idx as dst_idx from {_TYPED} e join n a on a.type = src_type and a.key = src join n b on b.type = dst_type and b.key = dst")
def indexed_edges(t):
    return edges.indexed_edges(edges.typed_graph(_facts(t), reverse=False)).select("rel", "src_idx", "dst_idx")


@query("""with m as (select distinct award_id, pi_id from $edges), p as (select distinct a.pi_id as a, b.pi_id as b from m a join m b on a.award_id = b.award_id and a.pi_id < b.pi_id), d as (select k, count(*) as d from (select a as k from p union all select b from p) group by 1), n as (select distinct pi_id as k from $edges)
    select count(*) as n_nodes, (sum(coalesce(d, 0)) / 2)::bigint as n_edges, avg(coalesce(d, 0)) as mean_degree, median(coalesce(d, 0))::double as median_degree, max(coalesce(d, 0)) as max_degree, count(*) filter (where coalesce(d, 0) = 0) as n_isolated from n left join d using (k)""")
def degree_stats(t):
    pairs = edges.pair_members(t.edges, "award_id", "pi_id").select("a", "b").distinct()
    return edges.degree_stats(t.edges, "pi_id", pairs)


def _entities(t):
    f = _facts(t)
    return edges.entity_table(f, "award", {"person": F.array_append(F.coalesce("other", F.array().cast("array<string>")), F.col("lead")), "institution": F.col("institution"), "program": F.col("program"), "org": F.col("org"), "state": F.col("state")})


_ENTITIES = f"(select distinct award, kind, entity from (select award, 'person' as kind, unnest(list_append(other, lead)) as entity from {_FACTS} union all select award, 'institution', institution from {_FACTS} union all select award, 'program', unnest(program) from {_FACTS} union all select award, 'org', org from {_FACTS} union all select award, 'state', state from {_FACTS}) where trim(entity) <> '')"


@query(f"""with e as (select *, count(*) over (partition by kind, entity) as n, row_number() over (partition by kind, entity order by sha1(award || '|' || kind || '|' || entity || '|42'), award) as r from {_ENTITIES}), k as (select * from e where n <= 30 or r <= 20)
    select a.award as a, b.award as b, sum(case a.kind when 'person' then 3.0 when 'state' then 0.25 when 'org' then 0.5 else 1.0 end)::double as weight, count(*) as n_shared from k a join k b on a.kind = b.kind and a.entity = b.entity and a.award < b.award group by 1, 2""")
def projection_capped(t):
    return edges.project(_entities(t), "award", ENTITY_WEIGHTS, cap=30, max_pairs=200)


@query(f"""with e as (select *, count(*) over (partition by kind, entity) as n, row_number() over (partition by kind, entity order by sha1(award || '|' || kind || '|' || entity || '|42'), award) as r from {_ENTITIES}), k as (select * from e where n <= 250 or r <= 100)
    select a.award as a, b.award as b, sum(case a.kind when 'person' then 3.0 when 'state' then 0.25 when 'org' then 0.5 else 1.0 end)::double as weight, count(*) as n_shared from k a join k b on a.kind = b.kind and a.entity = b.entity and a.award < b.award group by 1, 2""")
def award_projection(t):
    return edges.project(_entities(t), "award", ENTITY_WEIGHTS)


@query(f"select 'award' as src_type, award as src, kind as dst_type, entity as dst from {_ENTITIES} union select kind, entity, 'award', award from {_ENTITIES}")
def bipartite_links(t):
    return edges.bipartite(_entities(t), "award")


@query("""with f as (select institution_id, ln(1 + count(distinct award_id)) as c, min(start_year) as lo, max(start_year) as hi from $awards group by 1)
    select institution_id, round(c, 6) as log_count, round((c - min(c) over ()) / (max(c) over () - min(c) over ()), 6) as log_count_scaled, round((coalesce(lo, 0) * 1.0 - min(lo) over ()) / (max(lo) over () - min(lo) over ()), 6) as first_year_scaled from f where lo is not null""")
def entity_features(t):
    out = edges.entity_features(t.awards, "institution_id", "award_id", "start_year")
    return out.where("first_year is not null").select("institution_id", F.round("log_count", 6).alias("log_count"), F.round("log_count_scaled", 6).alias("log_count_scaled"), F.round("first_year_scaled", 6).alias("first_year_scaled"))


@query("with p as (select distinct award_id, person_id from $edges) select award_id, person_id from p union select a.award_id, a.person_id from $awards a where trim(coalesce(a.person_id, '')) <> '' and not exists (select 1 from p where p.award_id = a.award_id)")
def lead_fallback(t):
    return edges.lead_fallback(t.edges.select("award_id", "person_id").distinct(), t.awards, "award_id", "person_id")


# history: the SQL looks back for every row by itself, as an independent way
@query("""with r as (select institution_id as k, start_year as year from $awards where institution_id is not null and start_year is not null), q as (select distinct k, year from r)
    select k, year, (select count(*) from r where r.k = q.k and r.year < q.year) as prior_count, (select min(year) from r where r.k = q.k and r.year < q.year) as prior_first_year, (select max(year) from r where r.k = q.k and r.year < q.year) as prior_last_year from q""")
def prior_counts(t):
    rows = t.awards.where("institution_id is not null and start_year is not null").select(F.col("institution_id").alias("k"), F.col("start_year").alias("year"))
    return history.prior_counts(rows, rows, ["k"], "year")


@query("""with r as (select distinct institution_id as k, pi_id as o, start_year as year from $edges where start_year is not null), q as (select distinct k, year from r)
    select q.k, q.year, count(distinct r.o) as prior_distinct from q left join r on r.k = q.k and r.year < q.year group by 1, 2""")
def prior_distinct(t):
    rows = t.edges.where("start_year is not null").select(F.col("institution_id").alias("k"), F.col("pi_id").alias("o"), F.col("start_year").alias("year"))
    return history.prior_distinct(rows, rows, "k", "o", "year")


@query("""with m as (select distinct award_id, pi_id, start_year from $edges where start_year is not null), p as (select distinct a.award_id, a.pi_id as a, b.pi_id as b, a.start_year as year from m a join m b on a.award_id = b.award_id and a.pi_id < b.pi_id),
    n as (select p.award_id, p.a, p.b, p.year, count(q.award_id) as n from p left join p q on q.a = p.a and q.b = p.b and q.year < p.year group by all)
    select t.award_id, coalesce(sum(n.n), 0)::double as g_pair_sum, coalesce(max(n.n), 0)::double as g_pair_max, count(*) filter (where n.n > 0)::int as g_pair_nonzero from (select distinct award_id from m) t left join n using (award_id) group by 1""")
def pair_history(t):
    return history.pair_history(t.edges, "award_id", "pi_id", "start_year").select("award_id", "g_pair_sum", "g_pair_max", "g_pair_nonzero")


def _history(t):
    rows = t.awards.where("award_id is not null").groupBy("award_id").agg(F.min_by(F.struct("start_year", "person_id", "institution_id", "programelementcodes"), "record_id").alias("r")).select("award_id", "r.*")
    awards = rows.select("award_id", F.col("start_year").alias("year"), F.col("person_id").alias("lead"), F.col("institution_id").alias("institution"), F.coalesce(F.get(codes("programelementcodes"), F.lit(0)), F.lit("")).alias("program"))
    team = t.edges.select("award_id", F.col("person_id").alias("person")).distinct()
    return history.history_features(awards, team)


_HIST = f"""with base as (select award_id, start_year as year, person_id as lead, institution_id as institution, coalesce({s.codes('programelementcodes')}[1], '') as program from (select *, row_number() over (partition by award_id order by record_id) as k from $awards where award_id is not null) where k = 1 and start_year is not null),
    e as (select distinct award_id, person_id as person from $edges where trim(person_id) <> ''), team as (select * from e union select award_id, lead from base where trim(lead) <> '' and award_id not in (select award_id from e)), d as (select t.award_id, t.person, b.year, b.institution, b.program from team t join base b using (award_id))
    select b.award_id, b.year, (select count(*) from d where d.award_id = b.award_id) as m_team_size, (select count(*) from d where d.person = b.lead and d.year < b.year) as g_lead_prior_awards,
    (select count(distinct o.person) from d join d o on o.award_id = d.award_id and o.person <> d.person where d.person = b.lead and d.year < b.year) as g_lead_prior_collaborators, (select count(distinct d.program) from d where d.person = b.lead and d.year < b.year and d.program <> '') as g_lead_prior_programs,
    (select count(*) from base o where o.institution = b.institution and o.year < b.year) as g_inst_prior_awards, (select count(distinct d.person) from d where d.institution = b.institution and d.year < b.year) as g_inst_prior_people,
    coalesce(b.year - (select min(o.year) from base o where o.institution = b.institution and o.year < b.year), 0)::int as g_inst_years_since_first, (select count(*) from base o where o.program = b.program and o.year < b.year) as g_prog_prior_awards,
    ((select count(*) from base o where o.institution = b.institution and o.year < b.year) = 0)::int as g_inst_cold_start, round(ln(1 + (select count(*) from base o where o.program = b.program and o.year < b.year)), 6) as g_prog_prior_awards_log1p,
    coalesce((select sum((select count(*) from d x where x.person = d.person and x.year < d.year)) from d where d.award_id = b.award_id), 0)::double as g_team_prior_awards_sum from base b"""


@query(_HIST)
def history_features(t):
    cols = ["award_id", "year", "m_team_size", "g_lead_prior_awards", "g_lead_prior_collaborators", "g_lead_prior_programs", "g_inst_prior_awards", "g_inst_prior_people", "g_inst_years_since_first", "g_prog_prior_awards", "g_inst_cold_start", "g_team_prior_awards_sum"]
    return _history(t).select(*cols, F.round("g_prog_prior_awards_log1p", 6).alias("g_prog_prior_awards_log1p"))


@query("""with m as (select distinct 'institution' as kind, institution_id as entity, record_id as idx, start_year as year from $awards where institution_id is not null union select distinct 'org', nsforganization, record_id, start_year from $awards where nsforganization is not null),
    l as (select kind, idx as dst, unnest(list(idx) over (partition by kind, entity order by year nulls first, idx rows between 5 preceding and 1 preceding)) as src, row_number() over (partition by kind, entity order by year nulls first, idx) as rn from m),
    k as (select kind, src, dst from (select l.*, 1 as x from l) where kind = 'institution' union all select kind, src, dst from (select kind, idx as dst, unnest(list(idx) over (partition by kind, entity order by year nulls first, idx rows between 2 preceding and 1 preceding)) as src from m) where kind = 'org')
    select src, dst, case when bool_or(kind = 'institution') then 'institution' else 'org' end as kind from k group by 1, 2""")
def last_k_prior_edges(t):
    inst = t.awards.where("institution_id is not null").select(F.lit("institution").alias("kind"), F.col("institution_id").alias("entity"), F.col("record_id").alias("idx"), F.col("start_year").alias("year"))
    org = t.awards.where("nsforganization is not null").select(F.lit("org").alias("kind"), F.col("nsforganization").alias("entity"), F.col("record_id").alias("idx"), F.col("start_year").alias("year"))
    return history.last_k_links(inst.unionByName(org), {"institution": 5, "org": 2})


@query("""with p as (select distinct a.pi_id as src, b.pi_id as dst from (select distinct award_id, pi_id from $edges) a join (select distinct award_id, pi_id from $edges) b on a.award_id = b.award_id and a.pi_id <> b.pi_id), f as (select pi_id as src, count(*)::double as v from $edges group by 1)
    select dst as node, round(avg(v), 6) as first from p join f using (src) group by 1""")
def mean_messages(t):
    pairs = edges.pair_members(t.edges, "award_id", "pi_id").select("a", "b").distinct()
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a"))
    features = t.edges.groupBy(F.col("pi_id").alias("node")).agg(F.array(F.count("*").cast("double")).alias("vec"))
    return edges.mean_messages(both, features, dim=1).select("node", F.round(F.get("vec", F.lit(0)), 6).alias("first"))


@query()
def walks_metapath(t):
    links = edges.bipartite(_entities(t), "award")
    paths = [f"award-{kind}-award" for kind in ("person", "institution", "program", "org")]
    parts = [walks.metapath_walks(links, walks.parse_metapath(p), n_walks=8, loops=10).withColumn("metapath", F.lit(p)) for p in paths]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query()
def walks_node2vec(t):
    pairs = edges.project(_entities(t), "award", {"person": 3.0, "program": 1.0}, spread=True)
    return walks.node2vec_walks(pairs, length=20, n_walks=8, q=2.0, nodes=_facts(t).select("award"))


@query()
def walk_vectors(t):
    paths, nodes = walks.numbered_walks(edges.bipartite(_entities(t), "award"), ["award", "institution", "award"], n_walks=8, loops=10)
    vectors = walks.walk_vectors(paths).select(F.col("node").cast("int").alias("no"), "vec")
    return vectors.join(nodes, "no").select("node", "vec")
