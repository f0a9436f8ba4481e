"""Features of what was known before a date: nothing of the same or a later year is visible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.numeric import add_log_copies, summarize_list, years_since
from tesserae.operators.edges import pair_members
from tesserae.operators.order import global_row_number
from tesserae.session import cut_lineage


def prior_counts(events: DataFrame, targets: DataFrame, keys: list[str], year: str = "year", name: str = "prior", years: bool = False) -> DataFrame:
    """``targets (keys, year)`` with events of the key in earlier years: ``<name>_count``, ``_first_year``, ``_last_year``, and with ``years`` ``_years``, the number of these years.

    Events are first reduced to one row per key and year, so the window of a key holds as many rows as there are years, whatever its number of events.
    Targets are distinct (key, year) rows; null keys and years have no history.
    """
    known = events.where(" and ".join(f"{c} is not null" for c in [*keys, year]))
    # events and targets are counted together, so that neither is joined to the other
    rows = known.select(*keys, year, F.lit(1).cast("bigint").alias("_n"), F.lit(0).alias("_probe")).unionAll(targets.select(*keys, year, F.lit(0).cast("bigint"), F.lit(1)))
    both = rows.groupBy(*keys, year).agg(F.sum("_n").alias("_n"), F.max("_probe").alias("_probe"))
    before = Window.partitionBy(*keys).orderBy(year).rangeBetween(Window.unboundedPreceding, -1)
    seen = F.when(F.col("_n") > 0, F.col(year))
    out = both.select(*keys, year, "_probe", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"{name}_count"), F.min(seen).over(before).alias(f"{name}_first_year"), F.max(seen).over(before).alias(f"{name}_last_year"), *([F.count(seen).over(before).alias(f"{name}_years")] if years else []))
    return out.where("_probe = 1").drop("_probe")


def prior_distinct(pairs: DataFrame, targets: DataFrame, key: str, other: str, year: str = "year", name: str = "prior_distinct") -> DataFrame:
    """``targets (key, year)`` with the number of different ``other`` that the key met in earlier years.

    Only the first meeting of each pair counts, so distinct values are plain counts of first meetings. Blank partners are left out.
    """
    met = pairs.where(F.col(key).isNotNull() & F.col(year).isNotNull() & (F.trim(F.col(other).cast("string")) != "")).groupBy(key, other).agg(F.min(year).alias(year))
    return prior_counts(met, targets, [key], year, name).select(key, year, F.col(f"{name}_count").alias(name))


def pair_history(edges: DataFrame, award: str, person: str, year: str, prefix: str = "g_pair") -> DataFrame:
    """``(award, <prefix>_sum, _mean, _max, _min, _nonzero)``: earlier joint awards of all pairs of the team of each award with a year."""
    members = edges.where(F.col(year).isNotNull() & F.col(person).isNotNull())
    pairs = pair_members(members.select(award, person, year).distinct(), award, person, [year]).select(award, "a", "b", F.col(f"{year}_a").alias("year"))
    prior = prior_counts(pairs.select(award, "a", "b", "year").distinct(), pairs, ["a", "b"], "year", "n")
    joined = pairs.join(prior, ["a", "b", "year"], "left").groupBy(award).agg(F.collect_list(F.coalesce("n_count", F.lit(0)).cast("double")).alias("ns"))  # pairs of one team
    teams = members.select(award).distinct().join(joined, award, "left")
    return teams.select(award, *summarize_list("ns", prefix))


def history_features(awards: DataFrame, team: DataFrame) -> DataFrame:
    """One row per award with a year: what was known of its lead, team, institution, program, organisation, directorate and state before that year.

    ``awards``: ``award_id, year, lead, institution, program`` (program: main code) and, as far as there are such columns, ``org, directorate, state, instrument``. ``team``: ``award_id, person`` distinct; awards without team have their
    lead. Gives the award's own categories (``cat_``) and team (``m_``), counts, distinct partners, years with awards, years since first and last appearance, pair history of the team, seen-before and cold-start flags and log copies of all
    count-like columns. Awards without year get no row and are nobody's history.
    """
    more = [c for c in ("org", "directorate", "state", "instrument") if c not in awards.columns]
    awards = awards.withColumns({c: F.lit(None).cast("string") for c in more})
    base = awards.where("year is not null").withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("org", "directorate", "state", "instrument")})
    alone = base.join(team.select("award_id").distinct(), "award_id", "left_anti").where("trim(lead) <> ''").select("award_id", F.col("lead").alias("person"))
    team = team.select("award_id", "person").where("trim(person) <> ''").unionByName(alone).distinct()
    places = ["institution", "program", "org", "directorate", "state"]
    dated = team.join(base.select("award_id", "year", *places), "award_id")
    out = base.select("award_id", "year", "lead", *places, "instrument")
    size = team.groupBy("award_id").agg(F.count("*").alias("m_team_size"))
    out = out.join(size, "award_id", "left").na.fill(0, ["m_team_size"])

    persons = dated.select(F.col("person").alias("k"), "year", "institution", "program")
    person_counts = prior_counts(persons, persons, ["k"], "year", "n")
    mates = pair_members(dated.select("award_id", "person", "year"), "award_id", "person", ["year"]).select("a", "b", F.col("year_a").alias("year"))
    mates = mates.unionByName(mates.select(F.col("b").alias("a"), F.col("a").alias("b"), "year"))
    person_facts = person_counts
    for name, pairs in (("mates", mates.select(F.col("a").alias("k"), F.col("b").alias("o"), "year")), ("insts", persons.select("k", F.col("institution").alias("o"), "year")), ("progs", persons.select("k", F.col("program").alias("o"), "year"))):
        person_facts = person_facts.join(prior_distinct(pairs, persons, "k", "o", "year", f"n_{name}"), ["k", "year"], "left")

    lead = person_facts.select(F.col("k").alias("lead"), "year", *[F.col(c).alias(f"l_{c}") for c in ("n_count", "n_first_year", "n_last_year", "n_mates", "n_insts", "n_progs")])
    out = out.join(lead, ["lead", "year"], "left")
    team_facts = dated.select("award_id", F.col("person").alias("k"), "year").join(person_facts, ["k", "year"], "left").groupBy("award_id").agg(*[F.collect_list(F.coalesce(c, F.lit(0)).cast("double")).alias(c) for c in ("n_count", "n_mates", "n_insts", "n_progs")])
    team_facts = team_facts.select("award_id", F.coalesce(F.aggregate("n_count", F.lit(0.0), lambda a, v: a + (v > 0).cast("double")) / F.nullif(F.size("n_count"), F.lit(0)), F.lit(0.0)).alias("g_team_seen_before_fraction"), *[e for c, n in (("n_count", "g_team_prior_awards"), ("n_mates", "g_team_prior_collaborators"), ("n_insts", "g_team_prior_institutions"), ("n_progs", "g_team_prior_programs")) for e in summarize_list(c, n)])
    out = out.join(team_facts, "award_id", "left")

    blocks = (("institution", "inst", ["person", "program"]), ("program", "prog", ["person", "institution"]), ("org", "org", ["person", "institution"]), ("directorate", "dir", ["person", "institution"]), ("state", "state", ["person", "program"]))
    for col, name, others in blocks:
        if col in more:
            continue
        rows = base.select(F.col(col).alias("k"), "year")
        facts = prior_counts(rows, rows, ["k"], "year", f"{name}", years=True)
        for other in others:
            pairs = dated.select(F.col(col).alias("k"), F.col(other).alias("o"), "year")
            facts = facts.join(prior_distinct(pairs, rows, "k", "o", "year", f"{name}_{other}"), ["k", "year"], "left")
        out = out.join(facts.withColumnRenamed("k", col), [col, "year"], "left")
    lp = base.select(F.concat_ws("|", "lead", "program").alias("k"), "year")
    out = out.withColumn("k", F.concat_ws("|", "lead", "program")).join(prior_counts(lp, lp, ["k"], "year", "lp"), ["k", "year"], "left").drop("k")
    out = out.join(pair_history(dated, "award_id", "person", "year", "g_pair_prior_awards"), "award_id", "left")

    count = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in out.columns else F.lit(0).cast("bigint")
    since = lambda c: years_since("year", c)
    named = {
        "g_lead_prior_awards": count("l_n_count"), "g_lead_prior_collaborators": count("l_n_mates"), "g_lead_prior_institutions": count("l_n_insts"), "g_lead_prior_programs": count("l_n_progs"),
        "g_lead_years_since_first": since("l_n_first_year"), "g_lead_years_since_last": since("l_n_last_year"), "g_lead_cold_start": (count("l_n_count") == 0).cast("int"),
        "g_inst_prior_awards": count("inst_count"), "g_inst_prior_people": count("inst_person"), "g_inst_prior_programs": count("inst_program"), "g_inst_years_since_first": since("inst_first_year"), "g_inst_years_since_last": since("inst_last_year"), "g_inst_cold_start": (count("inst_count") == 0).cast("int"),
        "g_prog_prior_awards": count("prog_count"), "g_prog_prior_people": count("prog_person"), "g_prog_prior_institutions": count("prog_institution"), "g_prog_years_since_first": since("prog_first_year"), "g_prog_years_since_last": since("prog_last_year"), "g_prog_cold_start": (count("prog_count") == 0).cast("int"),
        "g_lead_program_prior_awards": count("lp_count"), "g_inst_prior_years": count("inst_years"), "g_prog_prior_years": count("prog_years"),
        **{f"g_{n}_prior_{w}": count(f"{n}_{c}") for n, cols in (("org", ("person", "institution")), ("dir", ("person", "institution")), ("state", ("person", "program"))) for w, c in zip(("awards", "people", cols[1] + "s", "years"), ("count", *cols, "years"))},
        **{f"g_{n}_seen_before": (count(c) > 0).cast("int") for n, c in (("lead", "l_n_count"), ("inst", "inst_count"), ("prog", "prog_count"))},
        "g_team_any_prior_pair": (count("g_pair_prior_awards_nonzero") > 0).cast("int"),
    }
    team_cols = [c for c in out.columns if c.startswith(("g_team_", "g_pair_"))]
    known = lambda c, other: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(other))
    own = {"cat_institution": known("institution", "unknown_institution"), "cat_program": known("program", "unknown_program"), "cat_org": known("org", "unknown"), "cat_directorate": known("directorate", "unknown"), "cat_state": known("state", "unknown_state"), "cat_instrument": known("instrument", "unknown")}
    others = F.greatest(F.col("m_team_size") - 1, F.lit(0))
    own |= {"m_start_year": F.col("year").cast("int"), "m_num_co_pis": others, "m_has_copi": (others > 0).cast("int"), "m_num_current_participants": F.col("m_team_size")}
    wide = out.select("award_id", "year", F.col("m_team_size"), *[e.alias(n) for n, e in own.items()], *[e.alias(n) for n, e in named.items()], *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in team_cols])
    return add_log_copies(wide)


def last_k_summary(members: DataFrame, k_by_kind: dict[str, int]) -> DataFrame:
    """``(kind, n_groups, n_singletons, n_edges_added)``: groups of each kind, those of one row, and the links that are credited to the kind by ``last_k_links``."""
    sizes = members.where(F.col("entity").isNotNull() & F.col("kind").isin(list(k_by_kind))).groupBy("kind", "entity").agg(F.count_distinct("idx").alias("n"))
    groups = sizes.groupBy("kind").agg(F.count("*").alias("n_groups"), F.count_if(F.col("n") == 1).alias("n_singletons"))
    added = last_k_links(members, k_by_kind).groupBy("kind").agg(F.count("*").alias("n_edges_added"))
    return groups.join(added, "kind", "left").na.fill(0, ["n_edges_added"])


def last_k_links(members: DataFrame, k_by_kind: dict[str, int], bidirectional: bool = False) -> DataFrame:
    """``(src, dst, kind)``: links from each of the up to k predecessors of a row in its group to the row.

    ``members``: ``kind, entity, idx, year``. Order inside a group is (year, idx), null years first; same-year predecessors count. ``k <= 0`` means all
    predecessors (quadratic by definition, for small groups). A link found by several kinds is credited to the first in the order of ``k_by_kind``.
    With ``bidirectional`` every link stands in both directions.
    """
    parts = []
    for rank, (kind, k) in enumerate(k_by_kind.items()):
        rows = members.where((F.col("kind") == kind) & F.col("entity").isNotNull()).select("entity", "idx", "year").distinct()
        if k > 0:
            # rows are numbered over all groups; a predecessor at distance o is an equi-join on the number, so no task holds a whole group
            placed = cut_lineage(global_row_number(rows, ["entity", "year", "idx"], "n").select("entity", "idx", "n"))
            ahead = placed.select("entity", F.col("idx").alias("src"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda o: F.col("n") + o)).alias("n"))
            linked = ahead.join(placed.withColumnRenamed("idx", "dst"), ["entity", "n"]).select("src", "dst")
        else:
            placed = cut_lineage(global_row_number(rows, ["entity", "year", "idx"], "n").select("entity", "idx", "n"))
            spans = placed.groupBy("entity").agg(F.min("n").alias("low"))
            behind = placed.join(spans, "entity").where("n > low").select("entity", F.col("idx").alias("dst"), F.explode(F.sequence("low", F.col("n") - 1)).alias("n"))
            linked = behind.join(placed.withColumnRenamed("idx", "src"), ["entity", "n"]).select("src", "dst")
        parts.append(linked.where("src <> dst").select("src", "dst", F.lit(rank).alias("_rank"), F.lit(kind).alias("kind")))
    if bidirectional:
        parts += [p.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "_rank", "kind") for p in parts]
    return reduce(DataFrame.unionByName, parts).groupBy("src", "dst").agg(F.min_by("kind", "_rank").alias("kind"))
