"""The registered queries of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import entities, format_dedup, mixing, overlap, splits, stratified, subjects, tokens

PI_TIES, INSTITUTION_TIES = ["person_id", "project_cluster_id"], ["organization_clean", "project_cluster_id"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _benchmark(spark, d):
    return _read(spark, d, "methodkg_labeled_benchmark_v3_modeling")


def _awards(spark, d):
    return _read(spark, d, "cleaned_nsf_awards_2000_2025")


def _flagged(spark, d):
    return _read(spark, d, "nsf_awards_with_methodology_flags")


def p1_found(spark, d):
    groups = splits.tied_groups(_benchmark(spark, d), "benchmark_id", PI_TIES)
    return groups.where("first_id <> benchmark_id").select("first_id", "benchmark_id")


def _split(spark, d, ties):
    return splits.grouped_split(_benchmark(spark, d), "benchmark_id", ties, _read(spark, d, "split_targets"))


def p1_split_pi(spark, d):
    return _split(spark, d, PI_TIES)


def p1_split_institution(spark, d):
    return _split(spark, d, INSTITUTION_TIES)


def p1_report(spark, d):
    targets = _read(spark, d, "split_targets")
    parts = [splits.split_report(_split(spark, d, ties), targets).withColumn("tied_by", F.lit(name)) for name, ties in (("person", PI_TIES), ("institution", INSTITUTION_TIES))]
    return parts[0].unionByName(parts[1])


def p2_found(spark, d):
    copies = format_dedup.format_copies(_awards(spark, d), "record_id", ["title_clean", "abstract_clean"])
    return copies.where("first_id <> record_id").select("first_id", "record_id")


def p2_collapsed(spark, d):
    rows = format_dedup.collapse_copies(_awards(spark, d), "record_id", ["title_clean", "abstract_clean"])
    return rows.select("record_id", "award_id", "title_clean", "n_copies")


def p3_found(spark, d):
    return p3_report(spark, d).where("status = 'short'").select("cell_id")


def p3_report(spark, d):
    return stratified.plan_sample(_flagged(spark, d), _read(spark, d, "sample_targets"))[1]


def p3_sample(spark, d):
    return stratified.draw_sample(_flagged(spark, d), _read(spark, d, "sample_targets"))


_P4 = ("benchmark_id", "abstract_clean", "split_temporal_cluster_safe")


def p4_found(spark, d):
    return overlap.overlapping_pairs(_benchmark(spark, d), *_P4)


def p4_rows(spark, d):
    return overlap.overlapping_rows(_benchmark(spark, d), *_P4)


def p4_report(spark, d):
    return overlap.overlap_report(_benchmark(spark, d), *_P4, "nsforganization")


def p5_found(spark, d):
    people = entities.entity_pairs(entities.resolve(entities.person_spellings(_read(spark, d, "award_pi_edges"))))
    places = entities.entity_pairs(entities.resolve(entities.organisation_spellings(_awards(spark, d))))
    return people.select(F.lit("person").alias("entity_kind"), "id_1", "id_2").unionByName(places.select(F.lit("organisation").alias("entity_kind"), "id_1", "id_2"))


def p5_people(spark, d):
    return entities.resolve(entities.person_spellings(_read(spark, d, "award_pi_edges"))).select(F.col("id").alias("person_id"), "entity")


def p5_organisations(spark, d):
    return entities.resolve(entities.organisation_spellings(_awards(spark, d))).select(F.col("id").alias("institution_id"), "entity")


def p6_ids(spark, d):
    return tokens.encode_texts(_read(spark, d, "documents"))


def p6_decoded(spark, d):
    return tokens.decode_texts(tokens.encode_texts(_read(spark, d, "documents")))


def p7_mix(spark, d):
    return mixing.mix_sources(_read(spark, d, "documents"), _read(spark, d, "source_weights"))[0]


def p7_report(spark, d):
    return mixing.mix_sources(_read(spark, d, "documents"), _read(spark, d, "source_weights"))[1]


def _subjects(spark, d):
    return subjects.assign_subjects(_read(spark, d, "documents"), _read(spark, d, "subject_examples"), _read(spark, d, "subject_areas"))


def p8_found(spark, d):
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark, d):
    return subjects.composition(_subjects(spark, d), _read(spark, d, "documents"), _read(spark, d, "subject_areas"))


QUERIES = {f.__name__: f for f in (p1_found, p1_split_pi, p1_split_institution, p1_report, p2_found, p2_collapsed, p3_found, p3_report, p3_sample, p4_found, p4_rows, p4_report, p5_found, p5_people, p5_organisations, p6_ids, p6_decoded, p7_mix, p7_report, p8_found, p8_composition)}

_UNKNOWN = ", ".join(f"'{w}'" for w in splits.NOT_KNOWN)


def _tie(col: str) -> str:
    return f"case when regexp_replace(lower({col}), '[^\\p{{L}}\\p{{N}}]+', '', 'g') not in ('', {_UNKNOWN}) then lower(trim(regexp_replace({col}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g'))) end"


def _groups_sql(ties: list[str]) -> str:
    """Rows and tie values as a graph; the smallest row that reaches a node, by recursion."""
    links = " union ".join(f"select benchmark_id as r, '{k}:' || {_tie(c)} as k from methodkg_labeled_benchmark_v3_modeling" for k, c in enumerate(ties))
    return f"""with recursive b as materialized (select * from ({links}) where k is not null), e as materialized (select r as a, k as b from b union all select k, r from b),
    reach(n, least) using key (n) as (select benchmark_id, benchmark_id from methodkg_labeled_benchmark_v3_modeling union select distinct k, '~' from b
        union select e.b, min(reach.least) from reach join e on e.a = reach.n join recurring.reach old on old.n = e.b where reach.least < old.least group by e.b)
    select least as first_id, benchmark_id from reach join methodkg_labeled_benchmark_v3_modeling on benchmark_id = n where least <> benchmark_id"""


def _canonical(col: str) -> str:
    return f"regexp_replace(lower(nfc_normalize(coalesce({col}, ''))), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"


# the same sequence in either order of the fields, wherever it is cut: groups are the components of records and sequences
_SEQUENCES = f"(select record_id, a || b as x, b || a as y from (select record_id, {_canonical('title_clean')} as a, {_canonical('abstract_clean')} as b from cleaned_nsf_awards_2000_2025) where a || b <> '')"
_COPIES = f"""with recursive s as materialized (select record_id, hash(x) as x, hash(y) as y from {_SEQUENCES}), e as materialized (select record_id::ubigint as r, x as k from s union select record_id::ubigint, y from s),
    reach(n, least) using key (n) as (select distinct k, min(r) from e group by k
        union select e2.k, min(reach.least) from reach join e on e.k = reach.n join e e2 on e2.r = e.r join recurring.reach old on old.n = e2.k where reach.least < old.least group by e2.k),
    c as (select s.record_id, least::bigint as first_id from s join reach on n = x)"""
_LABEL = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_')"
_CELLS = f"""with latest as (select * from (select *, row_number() over (partition by award_id order by last_amendment_date desc nulls last, record_id) as k from nsf_awards_with_methodology_flags where award_id is not null) where k = 1 and has_abstract = 1),
    counts as (select t.cell_id, count(l.record_id) as available from sample_targets t left join latest l on {_LABEL.format("l.candidate_stratum")} = {_LABEL.format("t.candidate_stratum")} and {_LABEL.format("l.nsforganization")} = {_LABEL.format("t.nsforganization")} and l.start_year between t.year_from and t.year_to group by 1)"""

#: SQL where it can say the same over whole tables; the others are tested against brute force, round trips or held-out rows.
ORACLE: dict[str, str] = {
    "p1_found": _groups_sql(PI_TIES),
    "p2_found": f"{_COPIES} select first_id, record_id from c where first_id <> record_id",
    "p2_collapsed": f"{_COPIES}, g as (select first_id, count(*) as n from c group by 1) select a.record_id, a.award_id, a.title_clean, coalesce(g.n, 1) as n_copies from cleaned_nsf_awards_2000_2025 a left join c using (record_id) left join g on g.first_id = a.record_id where c.first_id is null or c.first_id = a.record_id",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p3_found": f"{_CELLS} select cell_id from counts join sample_targets using (cell_id) where available < greatest(min_rows, ceil(target_bp * sample_size / 10000.0))",
}
