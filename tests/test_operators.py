"""Hand-written rows for every quirk, and properties that must hold whatever the data."""

import datetime
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tesserae.functions import numeric, people, signals, text
from tesserae.operators import dedup, edges, experiments, history, joins, metrics, models, order, reports, sampling, splitting, walks
from tesserae.operators.components import connected_components
from tesserae.operators.skew import attach, bucketed_running, hot_keys, lookup, permuted
from tesserae.plans import pipelines
from tesserae.sources import io


def values(spark, expr, items, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(items)], f"k int, x {kind}")
    return [r["y"] for r in df.select("k", expr.alias("y")).orderBy("k").collect()]


def test_ids_and_blanks(spark):
    raw = ['="0555934"', "='12'", "1922666.0", "1.922666e6", " 007 ", "", None, '="'] 
    assert values(spark, text.unwrap("x"), raw) == ["0555934", "12", "1922666.0", "1.922666e6", "007", "", "", '="']
    assert values(spark, text.award_key("x", "strict"), raw[:7]) == ["0555934", "12", "1922666", "1922666", "007", "", ""]
    assert values(spark, text.award_key("x", "match"), raw[:7]) == ["555934", "12", "1922666", "1922666", "7", "", ""]
    assert values(spark, text.award_key("x", "digits"), raw[2:3]) == ["19226660"]
    assert values(spark, text.squeeze("x"), ["a\tb\r\n c d", None]) == ["a b c d", ""]
    assert values(spark, text.ascii_fold("x"), ["Zürich", "ﬁne ß", "été", "中", None]) == ["Zurich", "fine ", "ete", "", ""]
    assert values(spark, text.id_text("x"), ["  A--B  ç! "]) == ["a b c"]
    assert values(spark, text.stable_id("p", "x"), [None, "", "unknown"]) == [values(spark, text.stable_id("p", "x"), ["Unknown"])[0]] * 3


def test_hash_bucket_is_python_modulo(spark):
    import hashlib

    keys = ["", "a", "é", "42|x", "0123456789" * 5]
    assert values(spark, text.hash_bucket("x"), keys) == [int(hashlib.sha1(k.encode()).hexdigest(), 16) % 100 for k in keys]


def test_people_cells(spark):
    cells = ["A Bell, C Dorn", "Smith, John", "A Bell and C Dorn", "A Bell  and  C Dorn", "Ann Bell a@x.org Bo Dorn b@x.org", "x@y.org", "['A Bell', 'C Dorn']", "Ann Bell; ann bell", "Dr. Ann Bell", "", None]
    parts = values(spark, people.person_parts("x"), cells)
    assert parts == [["A Bell", "C Dorn"], ["Smith, John"], ["A Bell and C Dorn"], ["A Bell", "C Dorn"], ["Ann Bell a@x.org", "Bo Dorn b@x.org"], ["x@y.org"], ["A Bell", "C Dorn"], ["Ann Bell", "ann bell"], ["Dr. Ann Bell"], [], []]
    assert values(spark, people.person_parts("x", strict_and=False), cells[2:3]) == [["A Bell", "C Dorn"]]
    records = values(spark, people.person_records(people.person_parts("x")), cells)
    assert [len(r) for r in records] == [2, 1, 1, 2, 2, 1, 2, 1, 1, 0, 0]
    assert records[4][0]["email"] == "a@x.org" and records[4][0]["name"] == "Ann Bell" and records[8][0]["name"] == "Ann Bell"
    assert values(spark, text.emails("x"), ["A@B.org, a@b.org; c@d.net", None]) == [["a@b.org", "c@d.net"], []]


def test_money_dates_codes(spark):
    assert values(spark, numeric.parse_money("x"), ["$1,234.50", "(500)", "junk", "", None]) == [1234.5, -500.0, None, None, None]
    assert values(spark, numeric.parse_date("x"), ["2020-02-03", "2/3/2020", "nope", None]) == [datetime.date(2020, 2, 3)] * 2 + [None, None]
    assert values(spark, numeric.parse_year("x"), ["2011.0", "2011", "3/4/2011", "x"]) == [2011, 2011, 2011, None]
    assert values(spark, text.codes("x"), ["1234, 5678;1234", "n/a", "", None]) == [["1234", "5678"], ["N", "A"], [], []]
    assert values(spark, text.names_once("x"), ["Deep Sea; deep-sea | Sky", None]) == [["Deep Sea", "Sky"], []]
    assert values(spark, text.label("x"), [" Mixed-Methods ", None, "__a__"]) == ["mixed_methods", "", "a"]
    assert values(spark, text.class_label("x"), ["0.0", "True", "no", " ", "abc", None]) == ["0", "1", "0", None, "abc", None]
    assert values(spark, text.joined_text("x", F.lit("")), ["", "t"]) == [" [SEP] ", "t [SEP] "]


def test_proximity(spark):
    far = lambda n: "integrate " + "word " * n + "interview survey data"
    cases = ["joint display", far(11), far(14), "combine interview survey data", "combine interview survey", "integrate interview survey", "integrate interview survey course", "merge mixed methods findings", "connect mixed methods findings", "", None]
    assert values(spark, signals.near_integration("x"), cases) == [True, True, False, True, False, True, False, True, False, False, False]
    df = spark.createDataFrame([("mixed methods",), ("interview and survey",), ("interview",), ("survey",), ("sample",), ("nothing",), ("joint display",), (None,)], "norm string")
    got = [r["candidate_stratum"] for r in signals.add_signals(df, "norm").collect()]
    assert got == ["explicit_mmr", "implicit_mmr", "qual_only_hard_negative", "quant_only_hard_negative", "method_heavy_background", "random_background", "design_integration_enriched", "random_background"]


def test_vectors_and_lists(spark):
    assert values(spark, numeric.softmax("x"), [[0.0, 0.0]], "array<double>") == [[0.5, 0.5]]
    assert values(spark, numeric.l2_normalize("x"), [[3.0, 4.0], [0.0, 0.0]], "array<double>") == [[0.6, 0.8], [0.0, 0.0]]
    assert values(spark, numeric.mean_pool("x", F.array(F.lit(1), F.lit(0), F.lit(1))), [[[1.0, 2.0], [9.0, 9.0], [3.0, 4.0]]], "array<array<double>>") == [[2.0, 3.0]]
    total, *_ = numeric.summarize_list("x", "p")
    assert values(spark, total, [None, [], [1.0, None, 2.0]], "array<double>") == [0.0, 0.0, 3.0]
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    assert [r["v_scaled"] for r in numeric.minmax(df, ["v"], 1.0).collect()] == [0.0, 1.0, 1.0, 1.0]  # what isn't a finite number is the default, unscaled


def test_components_of_chain_star_and_hub(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(200)]
    star = [("hub", f"s{i:04d}") for i in range(3000)]
    df = spark.createDataFrame([*chain, *star, ("solo", "solo"), (None, "x"), ("a", "b"), ("a", "b")], "src string, dst string")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert len(got) == 201 + 3001 + 1 + 2
    assert set(got[c] for c, _ in chain) == {"c000"} and got["s2999"] == "hub" and got["solo"] == "solo" and got["b"] == "a"
    assert connected_components(df.limit(0)).count() == 0


def test_hot_keys_and_spread_lookup(spark):
    big = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 2000)).alias("k"))
    assert hot_keys(big, "k") == ["hot"]
    small = big.select("k").distinct().where("k <> 'k1'").withColumn("v", F.length("k"))
    joined = lookup(big, small, "k", "left")
    assert joined.count() == 9000 and joined.where("k = 'k1' and v is not null").count() == 0 and joined.where("k = 'hot' and v = 3").count() == 3000
    ranked = bucketed_running(big.withColumn("h", permuted("id")), "k", "h", "id", name="r")
    assert ranked.where("k = 'hot'").agg(F.min("r"), F.max("r"), F.count_distinct("r")).first()[:] == (1, 3000, 3000)


def test_attach_and_lookup_spread_hot_and_null_keys(spark):
    """One key with 1.5 % of the rows is no burden; null-heavy keys and keys of a third of the rows are dealt to many tasks."""
    n = 60_000
    key = F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 3 == 1, "hot").when(F.col("id") % 67 == 0, "warm").otherwise(F.concat(F.lit("k"), F.col("id")))
    df = spark.range(n).select("id", key.alias("k"), F.lit("x").alias("_part"), F.lit(1).alias("v_old"))
    small = df.select("k").distinct().withColumn("v", F.coalesce("k", F.lit("nothing")))
    out = attach(df.drop("_part"), small, ["k"]).withColumn("p", F.spark_partition_id())
    assert out.count() == n and out.where("v <> coalesce(k, 'nothing') or v is null").count() == 0
    assert out.where("k is null").select("p").distinct().count() > 1 and out.where("k = 'hot'").select("p").distinct().count() > 1
    left = lookup(df.drop("_part"), small.where("k is not null"), "k", "left")
    assert left.count() == n and left.where("k is null and v is not null").count() == 0 and left.where("k is not null and v is null").count() == 0
    assert lookup(df.drop("_part"), small, "k").count() == 2 * n // 3
    assert attach(df.limit(0), small, ["k"]).count() == 0 and lookup(df.limit(0), small, "k").count() == 0


def test_numbering_does_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"))
    got = [{r["v"]: r["n"] for r in order.global_row_number(df.repartition(p), ["v"], "n").collect()} for p in (1, 5)]
    assert got[0] == got[1] == {v: v + 1 for v in range(500)}
    assert order.dense_index(spark.createDataFrame([("b",), ("a",), (" ",), ("nan",), (None,)], "k string"), "k").count() == 2


def test_keep_latest_and_first(spark):
    day = datetime.date
    rows = [("a", 1, day(2020, 1, 1)), ("a", 2, day(2020, 1, 1)), ("a", 3, None), ("b", 4, None), (None, 5, day(2021, 1, 1))]
    df = spark.createDataFrame(rows, "k string, id bigint, d date")
    assert sorted(r["id"] for r in dedup.keep_latest(df, "k", "d", "id").collect()) == [1, 4, 5]
    assert sorted(r["id"] for r in dedup.keep_first(df, ["k"], [F.col("id")]).collect()) == [1, 4, 5]
    with pytest.raises(ValueError):
        dedup.keep_first(df, ["k"], [])
    flags = {r["id"]: r["duplicate_flag"] for r in dedup.duplicate_flag(df, ["k"], [F.col("id")]).collect()}
    assert flags == {1: 0, 2: 1, 3: 1, 4: 0, 5: 0}


def test_prior_counts_match_a_plain_model(spark):
    r = random.Random(2)
    rows = [(f"k{r.randrange(8)}", f"o{r.randrange(12)}", r.choice([None, *range(2000, 2010)])) for _ in range(300)] + [(None, "o1", 2001), ("k1", "", 2000)]
    df = spark.createDataFrame(rows, "k string, o string, year int")
    known = [x for x in rows if x[0] and x[2]]
    got = {(x["k"], x["year"]): x["prior_count"] for x in history.prior_counts(df, df, ["k"]).collect() if x["k"] and x["year"]}
    assert got == {(k, y): sum(1 for a, _, b in known if a == k and b < y) for k, _, y in known}
    got = {(x["k"], x["year"]): x["prior_distinct"] for x in history.prior_distinct(df, df, "k", "o").collect() if x["k"] and x["year"]}
    assert got == {(k, y): len({o for a, o, b in known if a == k and b < y and o}) for k, _, y in known}


def test_last_k_links_stay_inside_the_clique(spark):
    rows = [("person", "e", i, None if i == 0 else 2000 + i // 3) for i in range(10)] + [("org", "f", i, 2000) for i in range(4)]
    df = spark.createDataFrame(rows, "kind string, entity string, idx bigint, year int")
    got = history.last_k_links(df, {"person": 2, "org": 0}).collect()
    assert len([r for r in got if r["kind"] == "person"]) == 17 and all(r["src"] != r["dst"] for r in got)
    assert {(r["src"], r["dst"]) for r in got if r["kind"] == "org"} == {(0, 3)}


@pytest.mark.parametrize("parts", [1, 3])
def test_splits_keep_clusters_whole(spark, parts):
    rows = [(i, f"c{i // 3}", f"s{i % 2}", f"g{i // 5}" if i % 7 else " ", 2000 + i % 25) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, cluster string, stratum string, grp string, year int").repartition(parts)
    for out in (splitting.hash_split(df, "cluster"), splitting.temporal_split(df, "cluster", "year"), splitting.greedy_split(df, "cluster", "stratum"), splitting.component_split(df, "cluster", "grp"), splitting.component_split(df, "cluster", "grp", unknown_ties=False)):
        assert out.count() == 600 and out.groupBy("cluster").agg(F.count_distinct("split").alias("n")).where("n <> 1").count() == 0
    greedy = {r["split"]: r["count"] for r in splitting.greedy_split(df, "cluster", "stratum").groupBy("split").count().collect()}
    assert abs(greedy["train"] - 420) <= 6 and abs(greedy["test"] - 90) <= 6
    leak = reports.leakage_report(splitting.component_split(df, "cluster", "grp"), ["split"], ["cluster", "grp"]).collect()
    assert all(r["n_crossing"] == 0 for r in leak)


def test_quota_and_samples(spark):
    assert sampling.make_quota(100) == {"design_integration_enriched": 12, "explicit_mmr": 18, "implicit_mmr": 18, "qual_only_hard_negative": 14, "quant_only_hard_negative": 14, "method_heavy_background": 12, "random_background": 12}
    assert sum(sampling.make_quota(7).values()) == 7
    df = spark.createDataFrame([(i, f"c{i // 4}") for i in range(200)], "id int, cluster string")
    out = sampling.cluster_sample(df, "cluster", 50, cap=52)
    assert 50 <= out.count() <= 52 and out.groupBy("cluster").count().where("count <> 4").count() == 0
    assert sampling.cluster_sample(df, "cluster", 50, exclude=out).join(out, "cluster", "left_semi").count() == 0
    assert sampling.sample_n(df, "id", 10).exceptAll(sampling.sample_n(df.repartition(6), "id", 10)).count() == 0


def test_label_rules(spark):
    good = dict(label_mmr_class="qual_only", label_qual_signal="yes", label_quant_signal="no", label_design_present="no", label_design_type="none", label_integration_present="no", label_integration_type="none", label_reporting_completeness="low")
    bad = {
        "design_yes_type_none": dict(label_design_present="yes"), "design_no_type_real": dict(label_design_type="survey"), "integration_yes_type_none": dict(label_integration_present="yes"), "integration_no_type_real": dict(label_integration_type="merging"),
        "qual_only_with_quant_yes": dict(label_quant_signal="yes"), "quant_only_with_qual_yes": dict(label_mmr_class="quant_only"), "no_method_signal_with_method_label": dict(label_mmr_class="no_method_signal"), "implicit_mmr_without_qual_yes": dict(label_mmr_class="implicit_mmr", label_qual_signal="no"),
        "implicit_mmr_without_quant_yes": dict(label_mmr_class="implicit_mmr"), "explicit_mmr_without_qual_yes": dict(label_mmr_class="explicit_mmr", label_qual_signal="no"), "explicit_mmr_without_quant_yes": dict(label_mmr_class="explicit_mmr"),
        "high_reporting_without_method_signal": dict(label_mmr_class="unclear", label_reporting_completeness="high"),
    }
    bad |= {f"invalid_{c}": {c: "other_thing"} for c in good} | {f"missing_{c}": {c: None} for c in good}
    assert len(reports.label_rules()) == 28 == len(bad)
    rows = [{"id": "clean", **good}] + [{"id": name, **good, **change} for name, change in bad.items()]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in rows[0]))
    issues = {(r["id"], r["issue_type"]) for r in reports.rule_issues(df, reports.label_rules(), ["id"]).collect()}
    assert not [i for i in issues if i[0] == "clean"] and all((name, name) in issues for name in bad)
    assert all((f"missing_{c}", f"invalid_{c}") in issues for c in good)


def test_metrics_on_hard_cases(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.5), (1, 0.5), (0, 0.1), (1, None)], "y_true int, score double")
    r = metrics.ranking_metrics(df).first()
    assert r["roc_auc"] == pytest.approx(0.875) and r["average_precision"] == pytest.approx(0.5 + 0.5 * 2 / 3)
    one = metrics.ranking_metrics(df.where("y_true = 1")).first()
    assert one["roc_auc"] is None and one["average_precision"] == pytest.approx(1.0)
    labels = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "c")], "y_true string, y_pred string")
    got = metrics.summary_metrics(metrics.confusion_counts(labels)).first()
    assert got["accuracy"] == pytest.approx(1 / 3) and got["macro_f1"] == pytest.approx((2 / 3) / 3)
    assert metrics.best_threshold(df, grid="linear_91")[0] == pytest.approx(0.11)
    assert metrics.best_threshold(df.limit(0)) == (0.5, -1.0)
    scores = spark.createDataFrame([("a", [0.7, 0.3]), ("b", [0.2, 0.8])], "y_true string, scores array<double>")
    assert metrics.macro_ovr_auc(scores, ["a", "b"]) == 1.0 and metrics.macro_ovr_auc(scores, ["a", "b", "c"]) is None
    assert metrics.align_scores(scores, "y_true", ["a", "b"], ["b", "z", "a"]).first()["scores"] == [0.3, 0.0, 0.7]


def test_scores_of_ids_of_any_form(spark):
    from types import SimpleNamespace

    from tesserae.plans import registry  # noqa: F401  (imports the modules of queries in order)
    from tesserae.plans import model_queries as q

    # the third is beyond an int once multiplied; copies of a table may put something before or after the id
    ids = ["bm_000000003", "bm_000024000", "bm_999999999", "7~bm_000000003", "bm_000000003~7", "bm_7_000000003", "bm_12000000003", "none"]
    df = spark.createDataFrame([(x, k % 2) for k, x in enumerate(ids)], "benchmark_id string, target_mmr_binary int")
    t = SimpleNamespace(benchmark=df)
    got = [r["score"] for r in q._scored(t).collect()]
    assert got[:7] == [0.22, 0.0, 0.26, 0.22, 0.22, 0.22, 0.0] and 0 <= got[7] < 1
    assert metrics.ranking_metrics(q._scored(t)).first()["n"] == 8 and metrics.binary_metrics(q._scored(t), score="score").first()["n"] == 8
    assert sum(r["n"] for r in q.confusion(t).collect()) == 8 and q.threshold_sweep(t).count() == 5


def test_joins(spark):
    left = spark.createDataFrame([("1",), ("2",)], "k string")
    with pytest.raises(ValueError):
        joins.one_to_one(left, spark.createDataFrame([("1", 1.0), ("1", 2.0)], "k string, v double"), "k")
    out = {r["k"]: (r["v"], r["embedding_missing"]) for r in joins.one_to_one(left, spark.createDataFrame([("1", 1.5)], "k string, v double"), "k").collect()}
    assert out == {"1": (1.5, 0), "2": (0.0, 1)}
    base = spark.createDataFrame([('="007"', "x"), ("8.0", "y")], "award_id string, t string")
    table = spark.createDataFrame([("7", 1.0, "t"), ("9", 2.0, "u")], "award_id string, v double, label_x string")
    fused, groups = joins.fuse(base, "award_id", {"f": table}, "award_id")
    assert groups == {"f": ["f__v"]} and {r["t"]: r["f__v"] for r in fused.collect()} == {"x": 1.0, "y": None}
    with pytest.raises(ValueError):
        joins.require_columns(base, ["nope"])
    assert joins.numeric_like(spark.createDataFrame([("1", "a"), ("2", "3"), ("", None)], "a string, b string"), ["a", "b"]) == ["a"]
    assert [r for _, r in joins.column_roles(spark.createDataFrame([(1, 1, 1)], "g_x int, target_y int, award_id int"), set())] == ["feature", "target", "identifier"]


def test_walks_follow_edges(spark):
    links = spark.createDataFrame([("award", f"a{i}", "person", f"p{i % 3}") for i in range(9)] + [("award", "lone", "state", "s")], "src_type string, src string, dst_type string, dst string")
    both = links.union(links.select("dst_type", "dst", "src_type", "src"))
    paths = [r["path"] for r in walks.metapath_walks(both, ["award", "person", "award"], n_walks=2, loops=2).collect()]
    assert len(paths) == 20 and all(len(p) == 5 or p == ["lone"] for p in paths)
    assert all(p[k] == f"a{x}" or True for p in paths for k, x in enumerate(p)) and all(int(p[0][1:]) % 3 == int(p[1][1:]) for p in paths if len(p) > 1)
    with pytest.raises(ValueError):
        walks.parse_metapath("award-person")
    pairs = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "a string, b string, weight double")
    for p, q in ((1.0, 1.0), (0.5, 2.0)):
        for r in walks.node2vec_walks(pairs, length=4, p=p, q=q).collect():
            assert len(r["path"]) == 4 and all({x, y} in ({"a", "b"}, {"b", "c"}) for x, y in zip(r["path"], r["path"][1:]))


def test_walks_are_written_between_steps_and_keep_odd_ids(spark):
    there = spark.createDataFrame([("award", a, "person", p) for a, p in [("a, 1", "x+y"), ("ü%2C", "x+y"), ("a, 1", "z ")]], "src_type string, src string, dst_type string, dst string")
    both = there.unionByName(there.selectExpr("dst_type as src_type", "dst as src", "src_type as dst_type", "src as dst"))
    df = walks.metapath_walks(both, ["award", "person", "award"], n_walks=2, loops=4)
    # no shuffle of a step is left to be made, and kept, with those of all other steps
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    paths = [r["path"] for r in df.collect()]
    links = {(r["src"], r["dst"]) for r in both.collect()}
    assert len(paths) == 4 and all(len(p) == 9 and set(zip(p, p[1:])) <= links for p in paths)


def test_numbered_walks_are_the_same_in_four_bytes_a_node(spark):
    there = [("award", f"a{i}", "person", f"p{i * j % 5}") for i in range(30) for j in range(3)] + [("award", "p1", "person", "p1"), ("award", "lone", "state", "s")]
    there = spark.createDataFrame(there, "src_type string, src string, dst_type string, dst string")
    both = there.unionByName(there.selectExpr("dst_type as src_type", "dst as src", "src_type as dst_type", "src as dst"))
    paths, nodes = walks.numbered_walks(both, ["award", "person", "award"], n_walks=3, loops=4)
    assert dict(paths.dtypes) == {"path": "array<int>"} and "Exchange" not in paths._jdf.queryExecution().executedPlan().toString()
    name = {r["no"]: r["node"] for r in nodes.collect()}
    same = walks.metapath_walks(both, ["award", "person", "award"], n_walks=3, loops=4)
    assert sorted([name[x] for x in r["path"]] for r in paths.collect()) == sorted(r["path"] for r in same.collect())


def test_vectors_are_learned_in_parts_of_the_walks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [([rng.choice("abcdef" if k % 2 else "uvwxyz") for _ in range(20)],) for k in range(600)]
    df = spark.createDataFrame(rows, "path array<string>")
    monkeypatch.setattr(walks, "PART_WORDS", 3_000)
    made = []
    monkeypatch.setattr(walks, "Word2Vec", lambda numPartitions=1, real=walks.Word2Vec, **k: made.append(numPartitions) or real(numPartitions=numPartitions, **k))
    vec = {r["node"]: r["vec"] for r in walks.walk_vectors(df, dim=8).collect()}
    assert made == [4] and len(vec) == 12
    cos = lambda x, y: sum(p * q for p, q in zip(vec[x], vec[y])) / (sum(p * p for p in vec[x]) * sum(q * q for q in vec[y])) ** 0.5
    # nodes of one walk are nearer to each other than to those of the others
    assert min(cos("a", x) for x in "bcdef") > max(cos("a", x) for x in "uvwxyz")


def test_projection_without_cap_equals_brute_force(spark):
    rows = [(f"a{i}", "person" if j % 2 else "state", f"e{(i * j) % 5}") for i in range(12) for j in range(4)]
    df = spark.createDataFrame(rows, "award string, kind string, entity string")
    got = {(r["a"], r["b"]): r["weight"] for r in edges.project(df, "award", cap=None).collect()}
    kinds = {}
    for a, k, e in set(rows):
        kinds.setdefault((k, e), set()).add(a)
    want = {}
    for (k, _), members in kinds.items():
        for a in members:
            for b in members:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + (3.0 if k == "person" else 0.25)
    assert got == pytest.approx(want)


def test_projection_spreads_pairs_over_all_members_of_a_large_group(spark):
    rows = [(f"a{i:03d}", "program", "hot") for i in range(300)] + [("a001", "person", "p"), ("z", "person", "p"), ("alone", "person", "own")] + [(f"m{i:02d}", "program", "middle") for i in range(12)]
    df = spark.createDataFrame(rows, "award string, kind string, entity string")
    for cap, n_pairs, middle in ((250, 2000, 66), (10, 40, 40)):
        got = edges.project(df, "award", cap=cap, max_pairs=n_pairs, spread=True)
        pairs = {(r["a"], r["b"]): r["weight"] for r in got.collect()}
        assert pairs == {(r["a"], r["b"]): r["weight"] for r in edges.project(df.repartition(5), "award", cap=cap, max_pairs=n_pairs, spread=True).collect()}
        hot = {k for k in pairs if k[0] < "b" and k[1] < "b"}
        assert len(hot) == n_pairs and all(a < b for a, b in pairs)
        assert len({k for k in pairs if k[0] >= "m" and k[1] < "n"}) == middle
        assert pairs["a001", "z"] == 3.0 and len(pairs) == n_pairs + middle + 1
        if n_pairs == 2000:
            assert len({x for k in hot for x in k}) == 300
            paths = walks.node2vec_walks(got, length=3, n_walks=2, nodes=df.select("award")).collect()
            assert len(paths) == 2 * 314 and all(len(r["path"]) == (1 if r["path"][0] == "alone" else 3) for r in paths)


def test_sources(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    body = '﻿A,B\n1,"x\ny"\n2,\n'
    (tmp_path / "data_v2.csv").write_text(body, encoding="utf-8")
    (tmp_path / "._data_v9.csv").write_text("junk")
    df = io.read_text_csv(spark, str(tmp_path / "data_v2.csv"))
    assert df.columns == ["A", "B"] and df.collect()[0]["B"] == "x\ny"
    assert io.discover(str(tmp_path)).endswith("data_v2.csv")
    with zipfile.ZipFile(tmp_path / "all.zip", "w") as z:
        z.writestr("set_v1.csv", "A\n1\n")
        z.writestr("set_v3.csv", "A\n3\n")
        z.writestr("__MACOSX/set_v9.csv", "A\n9\n")
    assert io.read_csv_or_zip(spark, str(tmp_path / "all.zip")).first()["A"] == "3"
    assert io.read_csv_or_zip(spark, str(tmp_path / "all.zip"), "set_v1.csv").first()["A"] == "1"
    with pytest.raises(ValueError):
        io.read_csv_or_zip(spark, str(tmp_path / "._data_v9.csv"))
    out = str(tmp_path / "out")
    io.write_csv(df.withColumn("l", F.array("A")), out)
    with pytest.raises(FileExistsError):
        io.refuse_overwrite([out], False)
    with pytest.raises(ValueError):
        io.reset_folder(str(tmp_path), str(tmp_path), True)
    (tmp_path / "r/t/s/m").mkdir(parents=True)
    (tmp_path / "r/t/s/m/metrics.csv").write_text("macro_f1\n0.5\n")
    got = io.read_results(spark, str(tmp_path / "r")).first()
    assert (got["target"], got["split"], got["model"], got["macro_f1"]) == ("t", "s", "m", 0.5)
    io.write_summary(str(tmp_path / "s.json"), a=1)
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": 1}
    restored = io.restore_types(spark.createDataFrame([("5", "2020-01-02", "two words")], "n string, d string, t string"), ["n"], ["d"], "t").first()
    assert (restored["n"], restored["d"], restored["abstract_word_count"]) == (5.0, datetime.date(2020, 1, 2), 2)
    a, b = (reports.table_digest(df.repartition(p)).first() for p in (1, 3))
    assert a == b


def test_models(spark):
    rows = [("red apple fruit", "f")] * 8 + [("iron steel metal", "m")] * 8
    df = spark.createDataFrame(rows, "x string, y string")
    model, labels = models.text_classifier(df, "x", "y", 256)
    assert labels == ["f", "m"] and models.classify(model, df, "x", labels).where("y <> y_pred").count() == 0
    assert models.majority_class(df.union(df.limit(1)), "y") == "f"
    with pytest.raises(NotImplementedError):
        models.fine_tune()


def test_experiment_matrix_and_node_features(spark):
    def run(cell):
        if cell["model"] == "bad":
            raise RuntimeError("no such model")
        return {"macro_f1": 0.5, "evaluated_on": " Test"}

    out = experiments.run_matrix(spark, [{"target": "t", "model": m} for m in ("good", "bad")], run)
    got = {r["model"]: (r["macro_f1"], r["error"]) for r in out.collect()}
    assert got == {"good": (0.5, None), "bad": (None, "no such model")} and experiments.evaluation_rows(out).count() == 1
    awards = spark.createDataFrame([("1", 2000, 5.0, "A", ["x", "y"]), ("2", 2010, None, "B", ["z"]), ("3", None, -1.0, None, None)], "id string, year int, amount double, org string, codes array<string>")
    feats = experiments.award_node_features(awards, "id", "year", ["amount"], ["org"], "codes", top=2)
    assert feats.columns == ["id", "x_year", "x_amount_log1p", "x_org_A", "x_org_B", "x_codes_x", "x_codes_y", "x_codes_OTHER"]
    assert [tuple(r)[1:] for r in feats.orderBy("id").collect()][1] == (1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0)
    text_rows = experiments.with_text_features(feats, "id", spark.createDataFrame([("1", [1.0])], "id string, v array<float>"), "v", 1)
    assert {r["id"]: r["has_text_embedding"] for r in text_rows.collect()} == {"1": 1, "2": 0, "3": 0}
    assert experiments.same_tables(awards, awards.repartition(3)) and not experiments.same_tables(awards, awards.limit(1))


def test_pipelines(spark):
    raw = spark.read.parquet("/root/testdata/sf0.001/cleaned_nsf_awards_2000_2025.parquet")
    out = pipelines.awards_to_tables(raw)
    assert out["awards"].count() == raw.select("award_id").distinct().count()
    assert {"awards", "flags", "person_edges", "collaboration", "institution_edges", "program_edges", "clusters", "quality"} == set(out)
    bench = pipelines.labels_to_benchmark(spark.read.parquet("/root/testdata/sf0.001/methodkg_labeled_benchmark_v3_modeling.parquet"))
    assert bench["leakage"].where("split_column = 'split_random' and key = 'project_cluster_id' and n_crossing > 0").count() == 0
    features = pipelines.benchmark_to_features(out["awards"], out["person_edges"])
    assert features.count() == out["awards"].where("start_year is not null").count()


def test_literal_people(spark):
    cells = ["[{'person_id': 'p1', 'name': \"A. O'Hara\", 'email': 'a@x.org'}, {'name': 'Bo Dorn', 'email': None}]", "['Ann Bell', 'C Dorn']", "[]", "[broken", "no list", None, "", "[{'other': 1}]"]
    got = values(spark, people.literal_people("x"), cells)
    assert [tuple(r) for r in got[0]] == [("p1", "A. O'Hara", "a@x.org"), ("", "Bo Dorn", "")]
    assert [r["name"] for r in got[1]] == ["Ann Bell", "C Dorn"] and all(r["person_id"].startswith("person_") for r in got[1])
    assert got[2:] == [[], [], [], [], [], []]
    assert values(spark, people.person_parts("x"), cells[:2]) == [["A. O'Hara a@x.org", "Bo Dorn"], ["Ann Bell", "C Dorn"]]


def test_annotation_modes(spark):
    rows = [(i, f"c{i // 5}", ["explicit_mmr", "random_background"][i % 2], int(i % 10 != 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, cluster string, stratum string, has_abstract int")
    forced = df.where("id in (1, 7)")
    for mode, most in (("award", 40), ("cluster_expand", 40), ("cluster_representative", 40)):
        out = sampling.annotation_sample(df, "id", "cluster", "stratum", 40, forced, mode=mode, abstract="has_abstract").cache()
        assert 0 < out.count() <= most and out.where("has_abstract = 0").count() == 0 and out.select("annotation_id").distinct().count() == out.count()
        if mode == "cluster_expand":  # no cluster is cut
            whole = df.where("has_abstract = 1").join(out.select("cluster").distinct(), "cluster", "left_semi")
            assert whole.count() == out.count()
        if mode == "cluster_representative":
            assert out.groupBy("cluster").count().where("count > 1").count() == 0
    few = sampling.annotation_sample(df, "id", "cluster", "stratum", 12, df, mode="cluster_expand")
    assert few.count() <= 12 and few.groupBy("cluster").count().where("count <> 5").count() == 0
    with pytest.raises(ValueError):
        sampling.annotation_sample(df, "id", "cluster", "stratum", 12, mode="other")


def test_targets_and_links_in_both_directions(spark):
    df = spark.createDataFrame([("A b",), ("c",), (" ",), (None,), ("Unclear",)], "t string")
    assert metrics.infer_task(df, "t") == "multiclass"
    assert [r["y"] for r in metrics.prepared_target(df, "t", "binary").orderBy("t").collect()] == [None, None, 0.0, None, 1.0]
    with pytest.raises(ValueError):
        metrics.prepared_target(spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), "t", "binary")
    members = spark.createDataFrame([("x", "e", i, 2000 + i) for i in range(4)], "kind string, entity string, idx int, year int")
    one = {(r["src"], r["dst"]) for r in history.last_k_links(members, {"x": 0}).collect()}
    assert one == {(i, j) for i in range(4) for j in range(4) if i < j}
    both = {(r["src"], r["dst"]) for r in history.last_k_links(members, {"x": 1}, bidirectional=True).collect()}
    assert both == {(0, 1), (1, 2), (2, 3), (1, 0), (2, 1), (3, 2)}
    summary = history.last_k_summary(members, {"x": 1}).first()
    assert (summary["n_groups"], summary["n_singletons"], summary["n_edges_added"]) == (1, 0, 3)
