"""Queries of the scalar functions and text signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import numeric, people, signals, text
from tesserae.functions.lexicons import CLASSES, RULES
from tesserae.functions.text import lexicon_pattern
from tesserae.operators import edges as edge_ops
from tesserae.plans import sql as s
from tesserae.plans.registry import query


@query(f"select doc_id, {s.squeeze('text')} as squeezed, {s.search_text('text')} as search from documents")
def normalize_text(t):
    return t.documents.select("doc_id", text.squeeze("text").alias("squeezed"), text.search_text("text").alias("search"))


@query(f"select record_id, {s.fold('title_clean')} as folded, {s.id_text('title_clean')} as id_text, {s.stable_id('inst', 'organization_clean')} as inst_id from $awards")
def ascii_fold(t):
    return t.awards.select("record_id", text.ascii_fold(F.regexp_replace(F.coalesce("title_clean", F.lit("")), r"(?U)\s+", " ")).alias("folded"), text.id_text("title_clean").alias("id_text"), text.stable_id("inst", "organization_clean").alias("inst_id"))


@query(f"select doc_id, case when {s.squeeze('text')} = '' then 0 else len(string_split({s.squeeze('text')}, ' ')) end::int as words from documents")
def word_count(t):
    return t.documents.select("doc_id", text.word_count("text").alias("words"))


@query(f"select edge_id, {s.first_email('pi_email')} as email, {s.clean_name('pi_name')} as name, len(regexp_extract_all({s.clean_name('pi_name')}, '[A-Za-z]+'))::int as tokens, {s.person_id('pi_name', 'pi_email')} as person from $edges")
def person_id_hash(t):
    return t.edges.select("edge_id", text.first_email("pi_email").alias("email"), text.clean_name("pi_name").alias("name"), text.name_tokens("pi_name").alias("tokens"), text.person_id("pi_name", "pi_email").alias("person"))


@query(f"select doc_id, u.e as email from (select doc_id, list_distinct(list_transform(regexp_extract_all(text, '{s.EMAIL}'), lambda e: lower(e))) as es from documents) d, unnest(d.es) as u(e)")
def email_extract(t):
    return t.documents.select("doc_id", F.explode(text.emails("text")).alias("email"))


@query(f"select record_id, array_to_string({s.codes('programelementcodes')}, '|') as codes, coalesce({s.codes('programelementcodes')}[1], '') as first_code from $awards")
def code_split(t):
    c = text.codes("programelementcodes")
    return t.awards.select("record_id", F.array_join(c, "|").alias("codes"), F.coalesce(F.get(c, F.lit(0)), F.lit("")).alias("first_code"))


@query(f"select record_id, {s.label('candidate_stratum')} as stratum, {s.label('nsforganization')} as unit from $flagged")
def label_normalize(t):
    return t.flagged.select("record_id", text.label("candidate_stratum").alias("stratum"), text.label("nsforganization").alias("unit"))


_STRICT = """case when regexp_matches(v, '^[0-9]+(\\.[0-9]+)?[eE]\\+?[0-9]+$') then cast(cast(try_cast(v as double) as bigint) as varchar) else regexp_replace(regexp_replace(v, '\\.0+$', ''), '[^0-9A-Za-z]', '', 'g') end"""


@query(f"select record_id, regexp_replace(v, '[^0-9]', '', 'g') as digits, regexp_replace(v, '\\.0+$', '') as plain, {_STRICT} as strict, case when regexp_matches({_STRICT}, '^0+$') then '0' else ltrim({_STRICT}, '0') end as match from (select record_id, {s.unwrap('awardnumber')} as v from $awards)")
def award_keys(t):
    return t.awards.select("record_id", *[text.award_key("awardnumber", m).alias(m) for m in ("digits", "plain", "strict", "match")])


@query("""select record_id, year(start_date)::int as start_year, date_diff('day', start_date, end_date)::int as days, coalesce((date_diff('day', start_date, end_date) < 0)::int, 0) as negative,
    round(date_diff('day', start_date, end_date) / 30.4375, 6) as months, case when end_date is null then 'unknown' when end_date < date '2020-01-01' then 'expired' else 'active' end as activity from $awards""")
def date_parts(t):
    days, months, negative = numeric.duration("start_date", "end_date")
    return t.awards.select("record_id", F.year("start_date").alias("start_year"), days.alias("days"), negative.alias("negative"), F.round(months, 6).alias("months"), numeric.activity("end_date", F.lit("2020-01-01").cast("date")).alias("activity"))


@query("""select o_orderkey, round(o_totalprice, 2) as back, year(o_orderdate)::int as y, -round(o_totalprice, 2) as negative from orders""")
def money_and_date_parse(t):
    shown = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    rows = t.orders.select("o_orderkey", shown.alias("m"), F.date_format("o_orderdate", "M/d/yyyy").alias("d"))
    return rows.select("o_orderkey", numeric.parse_money("m").alias("back"), numeric.parse_year("d").alias("y"), numeric.parse_money(F.concat(F.lit("("), "m", F.lit(")"))).alias("negative"))


@query("""select c_custkey, round(ln(1 + greatest(coalesce(c_acctbal, 0), 0)), 6) as logged, round(1 / (1 + exp(-c_acctbal / 1000)), 6) as squashed,
    round((c_acctbal - min(c_acctbal) over ()) / (max(c_acctbal) over () - min(c_acctbal) over ()), 6) as scaled from customer""")
def numeric_transforms(t):
    rows = numeric.minmax(t.customer, ["c_acctbal"])
    return rows.select("c_custkey", F.round(numeric.safe_log1p("c_acctbal"), 6).alias("logged"), F.round(numeric.sigmoid(F.col("c_acctbal") / 1000), 6).alias("squashed"), F.round("c_acctbal_scaled", 6).alias("scaled"))


@query("""select l_orderkey, round(sum(l_quantity), 6) as q_sum, round(avg(l_quantity), 6) as q_mean, max(l_quantity) as q_max, min(l_quantity) as q_min, count(*) filter (where l_quantity <> 0)::int as q_nonzero from lineitem group by 1""")
def summarize_list(t):
    lists = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("qs"))
    total, mean, most, least, nonzero = numeric.summarize_list("qs", "q")
    return lists.select("l_orderkey", F.round(total, 6).alias("q_sum"), F.round(mean, 6).alias("q_mean"), most, least, nonzero)


@query("""with n as (select vec_id, sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))) as l from embeddings)
    select e.vec_id, round(n.l, 4) as length, round(e.embedding[1]::double / n.l, 5) as first_scaled, round(1 / list_sum(list_transform(e.embedding, lambda v: exp(v::double - e.embedding[1]::double))), 6) as first_softmax from embeddings e join n using (vec_id)""")
def vector_transforms(t):
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    wide = F.transform("embedding", lambda v: v.cast("double"))
    return t.embeddings.select("vec_id", F.round(length, 4).alias("length"), F.round(F.get(numeric.l2_normalize("embedding"), F.lit(0)), 5).alias("first_scaled"), F.round(F.get(numeric.softmax(wide), F.lit(0)), 6).alias("first_softmax"))


_NORM = s.search_text("coalesce(title_clean, '') || ' ' || coalesce(abstract_clean, '')")
_FLAG_SQL = ", ".join(f"regexp_matches(norm, '{lexicon_pattern(*lists)}')::int as {name}" for name, lists in signals.FLAGS.items())


@query(f"select record_id, {_FLAG_SQL} from (select record_id, {_NORM} as norm from $awards)")
def lexicon_flags(t):
    return _signals(t).select("record_id", *signals.FLAGS)


def _signals(t):
    norm = text.search_text(F.concat_ws(" ", F.coalesce("title_clean", F.lit("")), F.coalesce("abstract_clean", F.lit(""))))
    return signals.add_signals(t.awards.select("record_id", norm.alias("norm")), "norm")


def _any(words: list[str], starts: bool) -> str:
    return "bool_or(regexp_matches(o.w, '^(" + "|".join(words) + (")'))" if starts else ")$'))")


from tesserae.functions import lexicons as lex  # noqa: E402

# the rule by a join of word positions: another way to the same result
_NEAR_SQL = f"""with docs as (select record_id, {_NORM} as norm from $awards), words as (select record_id, unnest(string_split(norm, ' ')) as w, unnest(range(len(string_split(norm, ' ')))) as i from docs),
    verbs as (select * from words where regexp_matches(w, '^({'|'.join(lex.STRONG_VERBS + lex.WEAK_VERBS)})')),
    near as (select v.record_id, v.i, regexp_matches(any_value(v.w), '^({'|'.join(lex.STRONG_VERBS)})') as strong, {_any(lex.NEAR_QUAL, True)} as qual, {_any(lex.NEAR_QUANT, True)} as quant, {_any(lex.NEAR_CONTEXT, False)} as ctx, {_any(lex.NEAR_GENERIC, False)} as gen,
        ' ' || string_agg(o.w, ' ' order by o.i) || ' ' as around from verbs v join words o on o.record_id = v.record_id and o.i between v.i - {lex.WINDOW} and v.i + {lex.WINDOW} group by v.record_id, v.i),
    hit as (select record_id, bool_or((qual and quant and ctx) or (strong and ctx and regexp_matches(around, ' ({'|'.join(lex.NEAR_MMR)}) ')) or (strong and qual and quant and not gen)) as h from near group by 1)
    select d.record_id, (coalesce(h.h, false) or regexp_matches(' ' || d.norm || ' ', ' ({'|'.join(lex.DIRECT_STRONG)}) '))::int as near from docs d left join hit h using (record_id)"""


@query(_NEAR_SQL)
def proximity_window(t):
    norm = text.search_text(F.concat_ws(" ", F.coalesce("title_clean", F.lit("")), F.coalesce("abstract_clean", F.lit(""))))
    return t.awards.select("record_id", signals.near_integration(norm).cast("int").alias("near"))


_LADDER = f"""with f as (select record_id, {_FLAG_SQL} from (select record_id, {_NORM} as norm from $awards)), near as ({_NEAR_SQL}),
    g as (select f.*, near.near, greatest(qual_signal_candidate * quant_signal_candidate, implicit_mmr_phrase_candidate) as imp from f join near using (record_id)),
    h as (select *, greatest(design_label_candidate, near * greatest(explicit_mmr_candidate, imp, integration_direct_strong_candidate)) as di from g),
    i as (select *, greatest(di, explicit_mmr_candidate, imp) as a from h)
    select record_id, imp as implicit_mmr_candidate, di as design_integration_candidate, case when di = 1 then 'design_integration_enriched' when explicit_mmr_candidate = 1 then 'explicit_mmr' when imp = 1 then 'implicit_mmr'
    when qual_signal_candidate = 1 and quant_signal_candidate = 0 then 'qual_only_hard_negative' when quant_signal_candidate = 1 and qual_signal_candidate = 0 then 'quant_only_hard_negative'
    when method_heavy_candidate = 1 then 'method_heavy_background' else 'random_background' end as candidate_stratum from i"""


@query(_LADDER)
def stratum_ladder(t):
    return _signals(t).select("record_id", "implicit_mmr_candidate", "design_integration_candidate", "candidate_stratum")


def _hit(name: str) -> str:
    return f"regexp_matches(t, '(?i){RULES[name]}')"


@query(f"""select record_id, case when {_hit('explicit')} then 'explicit_mmr' when {_hit('qual')} and {_hit('quant')} then 'implicit_mmr' when {_hit('qual')} then 'qual_only' when {_hit('quant')} then 'quant_only'
    when {_hit('method')} then 'multi_method_not_mmr' else 'no_method_signal' end as predicted, {_hit('design')}::int as design, {_hit('integration')}::int as integration
    from (select record_id, coalesce(title_clean, '') || ' [SEP] ' || coalesce(abstract_clean, '') as t from $awards)""")
def rule_classifier(t):
    rows = t.awards.select("record_id", F.concat(F.coalesce("title_clean", F.lit("")), F.lit(" [SEP] "), F.coalesce("abstract_clean", F.lit(""))).alias("x"))
    return rows.select("record_id", signals.rule_class("x", CLASSES, unicode=False).alias("predicted"), signals.rule_binary("x", "design", unicode=False).alias("design"), signals.rule_binary("x", "integration", unicode=False).alias("integration"))


@query("""select record_id, trim(coalesce(title_clean, '')) || ' [SEP] ' || trim(coalesce(abstract_clean, '')) as both, concat_ws(' [SEP] ', nullif(trim(coalesce(title_clean, '')), ''), nullif(trim(coalesce(abstract_clean, '')), '')) as skipped,
    'query: ' || coalesce(title_clean, '') as prefixed from $awards""")
def text_builder(t):
    return t.awards.select("record_id", text.joined_text("title_clean", "abstract_clean").alias("both"), text.joined_text("title_clean", "abstract_clean", skip_blank=True).alias("skipped"), text.prefixed_text("title_clean").alias("prefixed"))


@query("""select benchmark_id, (label_mmr_class in ('explicit_mmr', 'implicit_mmr'))::int as target_mmr, case label_qual_signal when 'yes' then 1 when 'no' then 0 end as target_qual,
    case label_reporting_completeness when 'low' then 0 when 'medium' then 1 when 'high' then 2 when 'none_no_report' then 0 when 'minimal' then 1 when 'partial' then 2 when 'adequate' then 3 when 'complete' then 4 end as target_reporting,
    coalesce(label_mmr_class, 'unknown') || '|design=' || coalesce(case label_design_present when 'yes' then '1' when 'no' then '0' end, '-1') || '|integration=' || coalesce(case label_integration_present when 'yes' then '1' when 'no' then '0' end, '-1') as stratify_key
    from (select * replace (nullif(label_mmr_class, 'unclear') as label_mmr_class), label_mmr_class as c from $benchmark) where c <> 'unclear' or c is null""")
def label_targets(t):
    rows = signals.label_targets(t.benchmark).where("label_mmr_class <> 'unclear' or label_mmr_class is null")
    return rows.select("benchmark_id", "target_mmr", "target_qual", "target_reporting", "stratify_key")


@query(f"""select benchmark_id, case when v in ('val', 'valid', 'dev', 'validation') then 'validation' when v = '' then 'unknown' else v end as split from
    (select benchmark_id, lower(trim(regexp_replace(coalesce(split_temporal_cluster_safe, ''), '{s.SPACE}', ' ', 'g'))) as v from $benchmark)""")
def split_values(t):
    return t.benchmark.select("benchmark_id", text.split_value("split_temporal_cluster_safe").alias("split"))


@query(f"""with cells as (select record_id, pi_clean || '; ' || coalesce(organizationcity, '') || ' Town | ' || coalesce(pi_email_extracted, '') as cell from $awards),
    parts as (select record_id, unnest(string_split(regexp_replace(cell, '\\s*[|]\\s*', ';', 'g'), ';')) as p from cells), named as (select record_id, {s.clean_name('p')} as name, {s.first_email('p')} as email from parts where trim(p) <> '')
    select distinct record_id, {s.person_id('name', 'email')} as person_id from named where name <> '' or email <> ''""")
def people_split(t):
    cell = F.concat("pi_clean", F.lit("; "), F.coalesce("organizationcity", F.lit("")), F.lit(" Town | "), F.coalesce("pi_email_extracted", F.lit("")))
    return edge_ops.people(t.awards.select("record_id", cell.alias("cell")), "record_id", "cell").select("record_id", "person_id")


@query()
def people_records(t):
    cell = F.concat("pi_clean", F.lit("; "), F.coalesce("organizationcity", F.lit("")), F.lit(" Town"))
    return t.awards.select("record_id", F.size(people.person_records(people.person_parts(cell))).alias("n"), F.array_join(people.person_names(people.person_parts(cell)), "|").alias("names"))
