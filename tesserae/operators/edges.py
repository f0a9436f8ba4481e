"""Edge tables, projections and the typed graph of awards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.lexicons import ENTITY_WEIGHTS
from tesserae.functions.numeric import minmax
from tesserae.functions.people import person_parts
from tesserae.functions.text import clean_name, codes, first_email, names_once, person_id, stable_id
from tesserae.operators.order import dense_index, global_row_number
from tesserae.operators.skew import attach
from tesserae.session import cut_lineage


def people(df: DataFrame, key: str, cell: str, strict_and: bool = True) -> DataFrame:
    """``(key, person_id, name, email, position)`` of the people named in a cell; each id once per key, at its first place."""
    parts = df.select(key, F.posexplode(person_parts(cell, strict_and)).alias("position", "part"))
    named = parts.select(key, "position", clean_name("part").alias("name"), first_email("part").alias("email")).where("name <> '' or email <> ''")
    ids = named.withColumn("person_id", person_id("name", "email"))
    first = F.min_by(F.struct("name", "email", "position"), "position").alias("r")
    return ids.groupBy(key, "person_id").agg(first).select(key, "person_id", "r.*")


def person_edges(awards: DataFrame, key: str, name: str, email: str, others: str, order: str, extra: list[str] = ()) -> DataFrame:
    """Award-person edges ``(key, person_id, name, email, role, *extra)``: the lead and every item of the array column ``others``.

    Ids are derived anew from address or name; a person, role and award occur once (smallest ``order``). Null and empty names without address are no edge.
    """
    lead = awards.select(key, F.col(name).alias("name"), F.coalesce(F.col(email), F.lit("")).alias("email"), F.lit("PI").alias("role"), F.col(order).alias("_o"), *extra)
    rest = awards.select(key, F.explode(others).alias("p"), F.col(order).alias("_o"), *extra).select(key, F.col("p.name").alias("name"), F.coalesce("p.email", F.lit("")).alias("email"), F.lit("Co-PI").alias("role"), "_o", *extra)
    rows = lead.unionByName(rest).withColumn("name", clean_name("name")).where("name <> '' or trim(email) <> ''")
    rows = rows.withColumn("person_id", person_id("name", "email"))
    return keep_columns_first(rows, [key, "person_id", "role"], ["_o", "name", "email"])


def keep_columns_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per ``keys`` by ``order``, without columns that begin with an underscore."""
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) if dict(df.dtypes)[c] == "string" else F.col(c) for c in order]))
    return df.groupBy(*keys).agg(row.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest if not c.startswith("_")])


def pair_members(edges: DataFrame, group: str, member: str, extra: list[str] = ()) -> DataFrame:
    """Unordered pairs of distinct members of a group: ``(group, a, b, *extra of both)`` with a < b. Groups should be small (teams)."""
    m = edges.select(group, F.col(member).alias("m"), *extra).distinct()
    a = m.select(group, F.col("m").alias("a"), *[F.col(c).alias(f"{c}_a") for c in extra])
    b = m.select(group, F.col("m").alias("b"), *[F.col(c).alias(f"{c}_b") for c in extra])
    return a.join(b, group).where("a < b")


def collaboration_edges(edges: DataFrame, award: str = "award_id", person: str = "pi_id", name: str = "pi_name", year: str = "start_year") -> DataFrame:
    """Person-person edges: shared awards, first and last year, joined years and awards. Different spellings give different edges."""
    pairs = pair_members(edges.where(f"{award} is not null and {person} is not null"), award, person, [name, year])
    pairs = pairs.withColumn("y", F.least(f"{year}_a", f"{year}_b"))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda v: v.cast("string")), "|")
    return pairs.groupBy(F.col("a").alias("pi_id_1"), F.col(f"{name}_a").alias("pi_name_1"), F.col("b").alias("pi_id_2"), F.col(f"{name}_b").alias("pi_name_2")).agg(
        F.count_distinct(award).alias("award_count"), F.min("y").alias("first_year"), F.max("y").alias("last_year"), joined("y").alias("award_years"), joined(award).alias("award_ids"),
    )


def institution_edges(awards: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct award-institution rows."""
    return awards.select(*cols).distinct()


def program_edges(awards: DataFrame, key: str, code_cell: str, name_cell: str, extra: list[str] = ()) -> DataFrame:
    """Award-program edges ``(key, source, program_id, program_code, program_name, *extra)``: by code, else by name, else one unknown program."""
    c, n = codes(code_cell), names_once(name_cell)
    by_code = F.transform(c, lambda x: F.struct(F.lit("code").alias("source"), x.alias("code"), F.lit("").alias("name")))
    by_name = F.transform(n, lambda x: F.struct(F.lit("name").alias("source"), F.lit("").alias("code"), x.alias("name")))
    none = F.array(F.struct(F.lit("unknown").alias("source"), F.lit("").alias("code"), F.lit("unknown_program").alias("name")))
    rows = awards.select(key, *extra, F.explode(F.when(F.size(c) > 0, by_code).when(F.size(n) > 0, by_name).otherwise(none)).alias("p"))
    rows = rows.select(key, *extra, F.col("p.source").alias("source"), F.col("p.code").alias("program_code"), F.col("p.name").alias("program_name"))
    return rows.withColumn("program_id", stable_id("program", F.concat(F.col("program_code"), F.col("program_name")))).distinct()


def entity_table(awards: DataFrame, key: str, columns: dict[str, Column]) -> DataFrame:
    """``(key, kind, entity)``: the distinct entities of each award, from one expression per kind (an array or a single value); blanks are left out."""
    def items(kind: str, expr: Column) -> DataFrame:
        rows = awards.select(key, F.lit(kind).alias("kind"), expr.alias("e"))
        return rows.select(key, "kind", F.explode("e").alias("entity")) if dict(rows.dtypes)["e"].startswith("array") else rows.select(key, "kind", F.col("e").cast("string").alias("entity"))

    return reduce(DataFrame.unionByName, [items(k, e) for k, e in columns.items()]).where("trim(entity) <> ''").distinct()


def project(entities: DataFrame, key: str, weights: dict[str, float] = ENTITY_WEIGHTS, cap: int | None = 250, max_pairs: int = 5000, seed: int = 42, spread: bool = False) -> DataFrame:
    """``(a, b, weight, n_shared)``, a < b: awards that share entities, weights added up.

    A group of more than ``cap`` awards is a sample by definition of the operator: its first members by hash, as many as make ``max_pairs`` pairs at most.
    No larger clique is ever formed; ``cap=None`` pairs everything. With ``spread`` such a group has ``max_pairs`` hashed pairs of all its members instead, or all pairs if there are no more.
    """
    weighted = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    rows = entities.where(F.col("kind").isin(list(weights))).select(key, "kind", "entity").distinct()
    drawn = None
    if cap is not None and spread:
        sized = attach(rows, rows.groupBy("kind", "entity").agg(F.count("*").alias("_n")), ["kind", "entity"])
        large = (F.col("_n") > cap) & (F.col("_n") * (F.col("_n") - 1) / 2 > max_pairs)
        drawn = drawn_pairs(sized.where(large).drop("_n"), key, max_pairs, seed)
        rows = sized.where(~large).drop("_n")
    elif cap is not None:
        sizes = rows.groupBy("kind", "entity").agg(F.count("*").alias("_n"))
        keep = int((2 * max_pairs) ** 0.5)  # members that make max_pairs pairs
        hashed = attach(rows, sizes, ["kind", "entity"]).withColumn("_h", F.sha1(F.concat_ws("|", F.col(key).cast("string"), F.col("kind"), F.col("entity"), F.lit(str(seed)))))
        large = hashed.where(F.col("_n") > cap)
        # the smallest hashes are found without gathering the group: a hash bound that leaves a few times the wanted members
        bound = F.col("_n") * F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) < 4 * keep
        first = large.where(bound).withColumn("_r", F.row_number().over(Window.partitionBy("kind", "entity").orderBy("_h", key))).where(F.col("_r") <= keep)
        rows = hashed.where(F.col("_n") <= cap).select(key, "kind", "entity").unionByName(first.select(key, "kind", "entity"))
    a, b = (rows.select("kind", "entity", F.col(key).alias(n)) for n in "ab")
    pairs = a.join(b, ["kind", "entity"]).where("a < b").select("kind", "a", "b")
    pairs = pairs if drawn is None else pairs.unionByName(drawn)
    return pairs.groupBy("a", "b").agg(F.sum(weighted[F.col("kind")]).alias("weight"), F.count("*").alias("n_shared"))


def drawn_pairs(rows: DataFrame, key: str, n_pairs: int, seed: int) -> DataFrame:
    """``(kind, a, b)``, a < b: of each group ``(kind, entity)`` of distinct members ``key``, which must have more than ``n_pairs`` pairs, so many different ones, drawn by hash among all."""
    group = ["kind", "entity"]
    # numbered over all groups, then from 0 per group: no task holds a whole group
    placed = cut_lineage(global_row_number(rows.select(*group, key), [*group, key], "_at"))
    spans = placed.groupBy(*group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    members = placed.join(spans, group).select(*group, (F.col("_at") - F.col("_first")).alias("_i"), F.col(key).alias("_m"))
    number = lambda salt, below: F.pmod(F.xxhash64(F.lit(f"{seed}{salt}"), *group, "_k"), below)
    many = F.col("_n") * (F.col("_n") - 1) / 2 > 4 * n_pairs
    # of a group with many pairs twice as many draws as wanted, of which most differ
    draws = spans.where(many).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(2 * n_pairs + 20)))).withColumn("_i", number("i", F.col("_n"))).withColumn("_j", number("j", F.col("_n") - 1))
    draws = draws.withColumn("_j", F.col("_j") + (F.col("_j") >= F.col("_i")).cast("int")).select(*group, F.least("_i", "_j").alias("_i"), F.greatest("_i", "_j").alias("_j"), "_k")
    # of the others, which have few, all pairs in hashed order
    every = spans.where(~many).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 2))).withColumn("_j", F.explode(F.sequence(F.col("_i") + 1, F.col("_n") - 1)))
    every = every.select(*group, "_i", "_j", F.xxhash64(F.lit(seed), *group, "_i", "_j").alias("_k"))
    first = draws.unionByName(every).groupBy(*group, "_i", "_j").agg(F.min("_k").alias("_k"))
    kept = first.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy("_k", "_i", "_j"))).where(F.col("_r") <= n_pairs)
    pairs = kept.join(members.withColumnRenamed("_m", "a"), [*group, "_i"]).join(members.select(*group, F.col("_i").alias("_j"), F.col("_m").alias("b")), [*group, "_j"])
    return pairs.select("kind", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def bipartite(entities: DataFrame, key: str) -> DataFrame:
    """``(src_type, src, dst_type, dst)``: award-entity links in both directions, each once."""
    there = entities.select(F.lit("award").alias("src_type"), F.col(key).cast("string").alias("src"), F.col("kind").alias("dst_type"), F.col("entity").alias("dst"))
    back = there.select(F.col("dst_type").alias("src_type"), F.col("dst").alias("src"), F.col("src_type").alias("dst_type"), F.col("src").alias("dst"))
    return there.unionByName(back).distinct()


#: Relations of the typed graph: name, source type and destination type. Fixed values.
RELATIONS = [
    ("led_by", "award", "person"), ("co_led_by", "award", "person"), ("at", "award", "institution"), ("funded_by", "award", "program"), ("managed_by", "award", "org"), ("in_directorate", "award", "directorate"),
    ("in_state", "award", "state"), ("in_year", "award", "year"), ("belongs_to", "program", "org"), ("part_of", "org", "directorate"), ("located_in", "institution", "state"),
]


def typed_graph(facts: DataFrame, reverse: bool = True) -> DataFrame:
    """``(src_type, rel, dst_type, src, dst)``, each once, from a wide table with one nullable string column per relation source and destination.

    ``facts`` has the columns ``award, lead, other (array), institution, program (array), org, directorate, state, year``.
    With ``reverse`` every relation also stands as ``rev_<rel>``.
    """
    one = lambda rel, s, d, src, dst: facts.select(F.lit(s).alias("src_type"), F.lit(rel).alias("rel"), F.lit(d).alias("dst_type"), src.alias("src"), dst.alias("dst"))
    c = F.col
    source = {
        "led_by": (c("award"), c("lead")), "co_led_by": (c("award"), F.explode("other")), "at": (c("award"), c("institution")), "funded_by": (c("award"), F.explode("program")), "managed_by": (c("award"), c("org")),
        "in_directorate": (c("award"), c("directorate")), "in_state": (c("award"), c("state")), "in_year": (c("award"), c("year")), "belongs_to": (F.explode("program"), c("org")), "part_of": (c("org"), c("directorate")), "located_in": (c("institution"), c("state")),
    }
    parts = [one(rel, s, d, *source[rel]) for rel, s, d in RELATIONS]
    parts = [p.where("src is not null and dst is not null and trim(src) <> '' and trim(dst) <> ''").distinct() for p in parts]
    edges = reduce(DataFrame.unionByName, parts)
    if not reverse:
        return edges
    back = edges.select(c("dst_type").alias("src_type"), F.concat(F.lit("rev_"), c("rel")).alias("rel"), c("src_type").alias("dst_type"), c("dst").alias("src"), c("src").alias("dst"))
    return edges.unionByName(back)


def indexed_edges(edges: DataFrame, nodes: dict[str, DataFrame] | None = None) -> DataFrame:
    """``edges`` with dense numbers ``src_idx`` and ``dst_idx`` per node type, from 0 in the order of the keys."""
    ends = edges.select(F.col("src_type").alias("t"), F.col("src").alias("k")).union(edges.select("dst_type", "dst")).distinct()
    kinds = sorted(r["t"] for r in ends.select("t").distinct().collect())  # node types of the schema, a handful
    numbered = reduce(DataFrame.unionByName, [dense_index(ends.where(F.col("t") == kind), "k").withColumn("t", F.lit(kind)) for kind in kinds])
    out = edges
    for end in ("src", "dst"):
        out = out.join(numbered.select(F.col("t").alias(f"{end}_type"), F.col("k").alias(end), F.col("idx").alias(f"{end}_idx")), [f"{end}_type", end])
    return out


def edge_summary(edges: DataFrame) -> DataFrame:
    """Raw and distinct edges per relation."""
    return edges.groupBy("src_type", "rel", "dst_type").agg(F.count("*").alias("n_raw"), F.count_distinct("src", "dst").alias("n_distinct"))


def degree_stats(nodes: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """Nodes, edges, mean, median and greatest degree and isolated nodes of an undirected graph ``pairs (a, b)``. The median is taken from the number of nodes of each degree."""
    degree = pairs.select(F.col("a").alias(key)).unionAll(pairs.select("b")).groupBy(key).agg(F.count("*").alias("d"))
    all_ = nodes.select(key).distinct().join(degree, key, "left").na.fill(0, ["d"])
    whole = all_.agg(F.count("*").alias("n_nodes"), (F.sum("d") / 2).cast("bigint").alias("n_edges"), F.avg("d").alias("mean_degree"), F.max("d").alias("max_degree"), F.count_if(F.col("d") == 0).alias("n_isolated"))
    # distinct degrees are few: at most the square root of twice the links
    line = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    held = all_.groupBy("d").agg(F.count("*").alias("n")).withColumn("to", F.sum("n").over(line)).crossJoin(F.broadcast(whole.select(F.col("n_nodes").alias("_all"))))  # one row
    middle = [F.min(F.when(F.col("to") >= F.expr(f"(_all + {k}) div 2"), F.col("d"))) for k in (1, 2)]
    median = held.agg(((middle[0] + middle[1]) / 2).cast("double").alias("median_degree"))
    out = whole.crossJoin(F.broadcast(median))  # one row each
    return out.select("n_nodes", "n_edges", "mean_degree", "median_degree", "max_degree", "n_isolated")


def entity_features(edges: DataFrame, entity: str, award: str, year: str) -> DataFrame:
    """Per entity the awards (log), first and last year, each scaled to [0, 1] over all entities."""
    seen = edges.groupBy(entity).agg(F.log1p(F.count_distinct(award)).alias("log_count"), F.min(year).alias("first_year"), F.max(year).alias("last_year"))
    return minmax(seen, ["log_count", "first_year", "last_year"])


def lead_fallback(edges: DataFrame, awards: DataFrame, key: str, lead: str) -> DataFrame:
    """``edges (key, person_id)`` and, for awards without any, an edge to their lead person if there is one."""
    missing = awards.where(F.trim(F.coalesce(F.col(lead), F.lit(""))) != "").join(edges.select(key).distinct(), key, "left_anti")
    return edges.select(key, "person_id").unionByName(missing.select(key, F.col(lead).alias("person_id"))).distinct()


def mean_messages(edges: DataFrame, features: DataFrame, key: str = "node", vector: str = "vec", dim: int = 64) -> DataFrame:
    """One round of message passing: ``(node, vec)`` with the mean vector of the neighbours that ``edges (src, dst)`` point from. No training."""
    sent = edges.join(features.select(F.col(key).alias("src"), F.col(vector).alias("v")), "src")
    means = F.array(*[F.avg(F.get("v", F.lit(k))) for k in range(dim)])
    return sent.groupBy(F.col("dst").alias(key)).agg(means.alias(vector))
