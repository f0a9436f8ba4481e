"""Each operator against brute force or a round trip, and the rows that must not break it."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tesserae.llm import entities, format_dedup, mixing, overlap, splits, stratified, subjects, tokens

random.seed(7)
WORDS = [a + b for a in "ka lo mi nu pe ra si to vu ze".split() for b in "ban del fir gos han jul".split()]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


# 1 splits


def union_find(rows):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, *ties in rows:
        for k, v in enumerate(ties):
            v = (v or "").strip().lower()
            if v and v not in ("unknown", "n/a", "-"):
                root[find((k, v))] = find(("row", i))
    groups = {}
    for i, *_ in rows:
        groups.setdefault(find(("row", i)), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_tied_groups_match_union_find(spark):
    r = random.Random(1)
    odd = [None, "", " ", "unknown", "N/A", "-"]
    rows = [(f"b{i:04d}", r.choice([f"P{r.randrange(150)} ", f" p{r.randrange(150)}", *odd]), r.choice([f"c{r.randrange(200)}", *odd])) for i in range(400)]
    # a chain, and a value that ties a third of everything
    rows += [(f"x{i:03d}", f"chain{i // 2}", f"link{(i + 1) // 2}") for i in range(60)] + [(f"y{i:03d}", "hot", f"own{i}") for i in range(230)]
    df = spark.createDataFrame(rows, "benchmark_id string, person_id string, project_cluster_id string")
    got = {x["benchmark_id"]: x["first_id"] for x in splits.tied_groups(df, "benchmark_id", ["person_id", "project_cluster_id"]).collect()}
    assert got == union_find(rows)


def test_hot_tie_value_is_spread(spark):
    df = spark.range(6000).select(F.format_string("b%05d", "id").alias("benchmark_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("p"), F.lit(None).cast("string").alias("c"))
    got = splits.tied_groups(df, "benchmark_id", ["p", "c"]).groupBy("n_rows").count().collect()
    assert {(x["n_rows"], x["count"]) for x in got} == {(2000, 2000), (1, 4000)}


def test_split_keeps_groups_and_shares(spark):
    rows = [(f"b{i:05d}", f"p{i // (1 + i % 4)}", None, "clash") for i in range(3000)]
    df = spark.createDataFrame(rows, "benchmark_id string, person_id string, project_cluster_id string, split string")
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15)], "split_name string, target_share double")
    out = splits.grouped_split(df, "benchmark_id", ["person_id", "project_cluster_id"], targets).cache()
    assert out.count() == 3000
    assert out.groupBy("first_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    for r in splits.split_report(out, targets).collect():
        assert abs(r["actual_share"] - r["target_share"]) < 0.01


def test_split_of_empty_table(spark):
    df = spark.createDataFrame([], "benchmark_id string, person_id string, project_cluster_id string")
    targets = spark.createDataFrame([("train", 1.0)], "split_name string, target_share double")
    assert splits.grouped_split(df, "benchmark_id", ["person_id", "project_cluster_id"], targets).count() == 0


@pytest.mark.parametrize("sizes", [[(1, 1000)], [(50, 3), (7, 40), (1, 13)], [(1000, 1), (1, 500)], []])
def test_bins_hold_every_component_once(sizes):
    bins = splits.difference_bins(sizes, 10)
    held = {}
    for b in bins:
        for size, n in b.items():
            held[size] = held.get(size, 0) + n
    assert held == {s: n for s, n in sizes}
    weights = [sum(s * n for s, n in b.items()) for b in bins]
    if sizes and max(s for s, _ in sizes) * 10 <= sum(s * n for s, n in sizes):
        assert max(weights) - min(weights) <= max(s for s, _ in sizes)


# 2 formatting


def key_of(title, body):
    import unicodedata

    def canon(t):
        t = unicodedata.normalize("NFC", unicodedata.normalize("NFC", t or "").casefold())
        return "".join(c for c in t if unicodedata.category(c)[0] in "LNM" and c not in "️")

    return {canon(title) + canon(body), canon(body) + canon(title)}


def test_format_copies_match_brute_force(spark):
    base = [("A Study of Bees", "Bees are café goers."), ("a study-of BEES!", "Bees are café goers"), ("Bees are café goers.", "A study of bees"), ("A Study of Bees", "Bees are cafe goers."), (None, "A study"), ("", "a STUDY"), ("A study", None), (None, None), ("", " ​"), ("--", "!"), ("straße", "x"), ("STRASSE", "X"), ("a­b", "⁠c"), ("AB", "C"), ("A", "bc"), ("B.C.", "a"), ("bca", None), ("ca", "b"), ("bac", None)]
    rows = [(i, t, b, "clash", 1) for i, (t, b) in enumerate(base)] + [(100 + i, "Same Title", "same, body" + "." * i, "x", 2) for i in range(40)] + [(500, "long " * 20000, "tail", "x", 3), (501, "LONG-" * 20000, "Tail", "x", 3)]
    df = spark.createDataFrame(rows, "record_id bigint, title_clean string, abstract_clean string, key string, n_copies int")
    got = {r["record_id"]: (r["first_id"], r["n_copies"]) for r in format_dedup.format_copies(df, "record_id", ["title_clean", "abstract_clean"]).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, t, b, *_ in rows:
        for k in key_of(t, b) - {""}:
            root[find(k)] = find(("row", i))
    groups = {}
    for i, *_ in rows:
        groups.setdefault(find(("row", i)), []).append(i)
    assert got == {i: (min(g), len(g)) for g in groups.values() for i in g}
    assert format_dedup.collapse_copies(df, "record_id", ["title_clean", "abstract_clean"]).count() == len(groups)


def test_format_copies_of_empty_table(spark):
    df = spark.createDataFrame([], "record_id bigint, title_clean string, abstract_clean string")
    assert format_dedup.format_copies(df, "record_id", ["title_clean", "abstract_clean"]).count() == 0


# 3 sample

AWARD = "record_id bigint, award_id string, last_amendment_date date, start_year int, has_abstract int, candidate_stratum string, nsforganization string, cell_id string"
CELL = "cell_id int, candidate_stratum string, nsforganization string, year_from int, year_to int, target_bp int, min_rows int, sample_size bigint"


def test_sample_follows_targets_and_reports(spark):
    import datetime

    day = datetime.date(2020, 1, 1)
    rows = [(i, f"a{i}", day, 2001, 1, [" Alpha-One ", "alpha_one", "BETA"][i % 3], "due ", None) for i in range(300)]
    rows += [(1000 + i, f"a{i}", None, 2011, 1, "gamma", "DRL", None) for i in range(50)]  # older versions: don't count
    rows += [(2000, "z1", day, 2011, 1, "gamma", "DRL", None), (2001, "z1", day, 2011, 1, "gamma", "DRL", None), (2002, None, day, 2011, 1, "gamma", "DRL", None), (2003, "z2", day, None, 1, "gamma", "DRL", None), (2004, "z3", day, 2011, 0, "gamma", "DRL", None)]
    awards = spark.createDataFrame(rows, AWARD)
    cells = [(1, "alpha_one", "DUE", 2000, 2009, 5000, 0, 100), (2, "beta", "DUE", 2000, 2009, 3000, 0, 100), (3, "gamma", "DRL", 2010, 2020, 2000, 5, 100), (4, "delta", "DRL", 2010, 2020, 0, 2, 100)]
    targets = spark.createDataFrame(cells, CELL)
    _, report = stratified.plan_sample(awards, targets)
    got = {r["cell_id"]: r for r in report.collect()}
    assert {i: r["available"] for i, r in got.items()} == {1: 200, 2: 100, 3: 1, 4: 0}
    assert {i for i, r in got.items() if r["status"] == "short"} == {3, 4}
    assert sum(r["drawn"] for r in got.values()) == 100
    drawn = stratified.draw_sample(awards, targets)
    assert {r["cell_id"]: r["count"] for r in drawn.groupBy("cell_id").count().collect()} == {i: r["drawn"] for i, r in got.items() if r["drawn"]}
    again = stratified.draw_sample(awards.repartition(7), targets)
    assert drawn.select("record_id").exceptAll(again.select("record_id")).count() == 0


def test_unmet_quota_goes_to_siblings_before_cousins():
    cell = lambda i, s, u, bp: {"id": i, "stratum": s, "unit": u, "bp": bp, "least": 0, "size": 100}
    cells = [cell(1, "a", "u", 4000), cell(2, "a", "u", 1000), cell(3, "a", "v", 2000), cell(4, "b", "u", 3000)]
    plan = stratified.allocate(cells, {1: 10, 2: 15, 3: 100, 4: 100})
    assert {i: p["own"] + p["taken"] for i, p in plan.items()} == {1: 10, 2: 15, 3: 45, 4: 30}
    assert stratified.allocate([], {}) == {}


def test_quota_comes_down_the_tree():
    """Against what must hold at every node of small random trees."""
    r = random.Random(5)
    for _ in range(200):
        cells = [{"id": i, "stratum": r.choice("abc"), "unit": r.choice("uvw"), "bp": r.randrange(0, 3000), "least": r.choice([0, 0, 1, 7]), "size": 100} for i in range(r.randrange(1, 12))]
        least = sum(c["least"] for c in cells)
        got = stratified.deal_down(cells, 100)
        assert sum(got.values()) == max(100, least) and all(got[c["id"]] >= c["least"] for c in cells)
        for level in (lambda c: (), lambda c: (c["stratum"],), lambda c: (c["stratum"], c["unit"])):
            for node in {level(c) for c in cells}:
                below = [c for c in cells if level(c) == node]
                child = lambda c: (c["stratum"], c["unit"], c["id"])[: len(node) + 1]
                kids = {child(c) for c in below}
                of = lambda k, f: sum(f(c) for c in below if child(c) == k)
                quota = {k: of(k, lambda c: got[c["id"]]) for k in kids}
                free = [k for k in kids if quota[k] > of(k, lambda c: c["least"])]
                for x in free:  # children above their minimum stand in the proportion of their weights, but for rounding
                    for y in free:
                        wx, wy = of(x, lambda c: c["bp"]), of(y, lambda c: c["bp"])
                        assert not (wx and wy) or quota[x] / wx <= (quota[y] + 1) / wy + 1 / wx
        have = {c["id"]: r.randrange(0, 40) for c in cells}
        plan = stratified.allocate(cells, have)
        drawn = {i: p["own"] + p["taken"] for i, p in plan.items()}
        assert all(drawn[i] <= have[i] for i in drawn) and sum(drawn.values()) == min(max(100, least), sum(have.values()))
        for c in cells:  # nothing goes to cousins while a sibling has rows left
            near = [x for x in cells if x["stratum"] == c["stratum"] and x["unit"] == c["unit"]]
            short = sum(plan[x["id"]]["wanted"] for x in near) - sum(drawn[x["id"]] for x in near)
            assert short <= 0 or all(drawn[x["id"]] == have[x["id"]] for x in near)


def test_latest_rows_with_text_ids(spark):
    df = spark.createDataFrame([("r2", "a", 5), ("r1", "a", 5), ("r0", "a", 4), ("r3", "b", None), ("r4", None, 9)], "id string, award string, d int")
    assert sorted(map(tuple, stratified.latest_rows(df, "award", "d", "id").select("award", "id").collect())) == [("a", "r1"), ("b", "r3")]


def test_sample_of_empty_tables(spark):
    assert stratified.draw_sample(spark.createDataFrame([], AWARD), spark.createDataFrame([(1, "a", "b", 1, 2, 10000, 1, 5)], CELL)).count() == 0
    assert stratified.draw_sample(spark.createDataFrame([], AWARD), spark.createDataFrame([], CELL)).count() == 0


# 4 overlap


def brute_pairs(rows):
    def words(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    out = set()
    for (i, a, s), (j, b, u) in itertools.combinations(rows, 2):
        s, u = ((x or "").strip().lower() for x in (s, u))
        known = ("train", "validation", "test")
        if s in known and u in known and (s == "train") != (u == "train"):
            x, y = words(a), words(b)
            if x and y and overlap._lcs(x, y) > overlap.SHARE * max(len(x), len(y)):
                out.add((min(i, j), max(i, j)))
    return out


def test_overlap_matches_brute_force(spark):
    r, rows = random.Random(3), []
    for i in range(60):
        words = text(90, i).split()
        rows.append((f"b{i:03d}", " ".join(words), r.choice(["train", " TRAIN"])))
        for w in range(len(words)):
            if r.random() < 0.06:
                words[w] = r.choice([words[w].upper() + ",", "typo", ""])
        if i % 2:
            rows.append((f"e{i:03d}", ". ".join(words).title(), r.choice(["test", "Validation "])))
        rows.append((f"h{i:03d}", " ".join(words[:40]) + " " + text(60, 1000 + i), "test"))
    boiler = text(25, 5000)
    rows += [(f"k{i:03d}", text(60, 6000 + i) + " " + boiler, ["train", "test"][i % 2]) for i in range(60)]
    rows += [(f"c{i:03d}", text(50, 7000), ["train", "test"][i % 2]) for i in range(20)]
    rows += [("n1", None, "train"), ("n2", "", "test"), ("n3", " .. ", "test"), ("n4", text(90, 1), None), ("s1", "two words", "train"), ("s2", "Two, words!", "test"), ("l1", "long " + text(3000, 9), "train"), ("l2", text(3000, 9), "validation")]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "benchmark_id string, abstract_clean string, split string, cid string")
    got = {tuple(x) for x in overlap.overlapping_pairs(df, "benchmark_id", "abstract_clean", "split").collect()}
    assert got == brute_pairs(rows)
    hit = {x["benchmark_id"] for x in overlap.overlapping_rows(df, "benchmark_id", "abstract_clean", "split").collect()}
    of = {i: (s or "").strip().lower() for i, _, s in rows}
    assert hit == {x for p in got for x in p if of[x] in ("test", "validation")}


def edited(words, every, seed):
    """The words with one of each run of ``every`` replaced by a word of its own, each at another place of its run."""
    r, out = random.Random(seed), list(words)
    for at in range(0, len(out), every):
        out[min(at + r.randrange(every), len(out) - 1)] = f"own{seed}x{at}"
    return " ".join(out)


def test_overlap_of_hot_group_of_scattered_edits(spark):
    base = text(150, 8000).split()
    rows = [(f"g{i:03d}", edited(base, 10, i), "train" if i < 60 else "test") for i in range(100)]
    df = spark.createDataFrame(rows, "benchmark_id string, abstract_clean string, split string")
    want = brute_pairs(rows)
    assert len(want) == 60 * 40
    got = {tuple(x) for x in overlap.overlapping_pairs(df, "benchmark_id", "abstract_clean", "split").collect()}
    assert got == want


def test_overlap_without_common_runs(spark):
    words = text(120, 9100).split()
    every_fourth = " ".join(f"own{k}" if k % 4 == 3 else w for k, w in enumerate(words))
    rows = [("a1", " ".join(words), "train"), ("a2", every_fourth, "test"), ("b1", "one two three four five six seven", "train"), ("b2", "one two three other five six seven", "test"), ("c1", "red green blue", "train"), ("c2", "red green blue grey", "test"), ("d1", "red green", "validation")]
    df = spark.createDataFrame(rows, "benchmark_id string, abstract_clean string, split string")
    got = {tuple(x) for x in overlap.overlapping_pairs(df, "benchmark_id", "abstract_clean", "split").collect()}
    assert got == brute_pairs(rows) == {("a1", "a2"), ("b1", "b2"), ("c1", "c2"), ("c1", "d1")}


def test_overlap_by_single_words_meets_every_near_pair(spark):
    words = text(120, 9300).split()
    rows = [("a1", " ".join(words), "train"), ("a2", " ".join(f"own{k}" if k % 3 == 2 else w for k, w in enumerate(words)), "test"), ("a3", " ".join(w for k, w in enumerate(words) if k % 3 != 1), "validation")]
    rows += [(f"x{i:03d}", text(120, 9400 + i), ["train", "test"][i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "benchmark_id string, abstract_clean string, split string")
    got = {tuple(x) for x in overlap.overlapping_pairs(df, "benchmark_id", "abstract_clean", "split", k=1, window=1).collect()}
    assert got == brute_pairs(rows) and {("a1", "a2"), ("a1", "a3")} <= got


def test_overlap_of_many_short_runs_and_boilerplate(spark):
    """30 + 30 texts of eight common runs of ten words with three own words after each, and boilerplate in 600 texts."""
    runs = [text(10, 8100 + k) for k in range(8)]
    rows = [(f"r{i:03d}", " ".join(f"{run} own{i}a{k} own{i}b{k} own{i}c{k}" for k, run in enumerate(runs)), "train" if i < 30 else "test") for i in range(60)]
    boiler = text(30, 8200)
    rows += [(f"s{i:03d}", " ".join(f"w{i}x{k}" for k in range(60)) + " " + boiler, ["train", "test"][i % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "benchmark_id string, abstract_clean string, split string")
    got = {tuple(x) for x in overlap.overlapping_pairs(df, "benchmark_id", "abstract_clean", "split").collect()}
    assert got == {(f"r{i:03d}", f"r{j:03d}") for i in range(30) for j in range(30, 60)}


def test_overlap_of_hot_copies_in_squares(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SIDE", 7)
    base = text(80, 8300).split()
    rows = [(f"q{i:03d}", edited(base, 12, i), "train" if i % 3 else "validation") for i in range(60)]
    df = spark.createDataFrame(rows, "benchmark_id string, abstract_clean string, split string")
    got = {tuple(x) for x in overlap.overlapping_pairs(df, "benchmark_id", "abstract_clean", "split").collect()}
    assert got == brute_pairs(rows) and len(got) == 40 * 20


def test_overlap_never_broadcasts_on_an_estimate(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(str(k), f"{text} {k}", ("train", "test")[k % 2]) for k in range(20)], "benchmark_id string, abstract_clean string, split string")
    _, classes = overlap.text_classes(df, "benchmark_id", "abstract_clean", "split")
    for rows in (overlap._grams(classes, 2), overlap.met_pairs(classes)):
        assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()


def test_overlap_in_batches_and_parts_writes_the_words_once(spark, monkeypatch):
    import subprocess

    from tesserae.session import checkpoint_folder

    rng = random.Random(3)
    texts = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(150)]
    rows = []
    for k, text in enumerate(texts * 4):
        new = [w if rng.random() > 0.1 else f"x{rng.randrange(400)}" for w in text] if k % 3 else text
        rows.append((f"r{k}", " ".join(new), ("train", "test", "validation")[k // 150 % 3]))
    df = spark.createDataFrame(rows, "benchmark_id string, abstract_clean string, split string")
    used = lambda: int(subprocess.run(["du", "-sb", checkpoint_folder(spark).removeprefix("file:")], capture_output=True).stdout.split()[0])
    written = []

    def sized(real):
        def run(*args):
            before = used()
            out = real(*args)
            written.append(used() - before)
            return out

        return run

    monkeypatch.setattr(overlap, "cut_lineage", sized(overlap.cut_lineage))
    if hasattr(overlap, "cut_by_key"):
        monkeypatch.setattr(overlap, "cut_by_key", sized(overlap.cut_by_key))
    whole = sorted(map(tuple, overlap.overlapping_pairs(df, "benchmark_id", "abstract_clean", "split").collect()))
    assert len(whole) > 400 and sum(x for x in written if x > 0) < 24 * 60 * 600
    for name, value in (("BATCH_WORDS", 1_000), ("PART_BYTES", 50_000), ("SIDE", 2), ("SEEN", 5)):
        monkeypatch.setattr(overlap, name, value)
    assert sorted(map(tuple, overlap.overlapping_pairs(df, "benchmark_id", "abstract_clean", "split").collect())) == whole


def test_overlap_takes_up_large_batches_in_slices():
    import tracemalloc

    import pyarrow as pa

    n, text = 4_000, list(range(150))
    lists = pa.array([text] * n, pa.list_(pa.int32()))
    seeds = pa.array([[{"p": k, "q": k} for k in range(30)]] * n, pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64())] * 2 + [lists, lists, seeds], ["x", "y", "wx", "wy", "s"])
    tracemalloc.start()
    got = [x for part in overlap._align(overlap.SHARE)(iter([batch])) for x in part.column(2).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [150] * n and peak < 30e6
    assert [part.num_rows for part in overlap._slices(batch, batch.column(0).to_numpy() * 0 + 150, 1_000)][:2] == [6, 7] and not list(overlap._slices(batch.slice(0, 0), batch.column(0).to_numpy()[:0]))


def test_overlap_of_empty_table(spark):
    df = spark.createDataFrame([], "benchmark_id string, abstract_clean string, split string")
    assert overlap.overlapping_pairs(df, "benchmark_id", "abstract_clean", "split").count() == 0


# 5 names


def people(spark, rows):
    df = spark.createDataFrame([(*x, "clash") for x in rows], "person_id string, pi_name string, pi_email string, entity string")
    found = {}
    for r in entities.resolve(entities.person_spellings(df)).collect():
        found.setdefault(r["entity"], set()).add(r["id"])
    return sorted(sorted(x) for x in found.values())


def test_spellings_of_people(spark):
    rows = [
        ("1", "Elizabeth K. Hodgkinson", "ehodgkinson@a.example"), ("2", "Liz Hodgkinson", None), ("3", "Hodgkinson, E. K.", ""), ("4", "HODGKINSON EK", " "), ("5", "Dr Elizabeth Hodgkinson", None), ("6", "Elizabeth Hodgkisnon", None),
        ("7", "Elizabeth Hodgkinson, Ph.D.", "elizabeth.hodgkinson@a.example"), ("8", "Elizabeth Hodgkinson-Marlow", None), ("9", "Henry Hodgkinson", None), ("10", "James Rutherford", "jrutherford@a.example"), ("11", "James Rutherford", "jrutherford@b.example"),
        ("12", "J. Rutherford", None), ("13", None, None), ("14", "", ""), ("15", "X", None), ("18", "Kimberly Oldfield", None), ("18", "KIMBERLY OLDFIELD", ""), ("19", "Kimberlly Oldfield", None), ("20", "K. Oldfield", None), ("16", "Élise Muñoz", None), ("17", "ELISE MUNOZ ", None), ("1", "Elizabeth K. Hodgkinson", "ehodgkinson@a.example"),
    ]
    got = people(spark, rows)
    assert ["1", "2", "3", "4", "5", "6", "7", "8"] in got and ["16", "17"] in got
    assert ["18", "19", "20"] in got  # the error joins the right spelling first, then the initial is decided
    assert ["10"] in got and ["11"] in got and ["12"] in got and ["9"] in got  # namesakes with different hosts stay apart; J. could be either


def test_initials_of_merged_profiles_are_united(spark):
    rows = [("1", "John A. Smithson", None), ("2", "John B. Smithson", None), ("3", "John Smithson", None), ("4", "JOHN SMITHSON", " "), ("8", "Dr John Smithson", None), ("5", "Mary C. Oldfield", None), ("6", "Mary Oldfield", None), ("7", "Mary Oldfeild", None)]
    got = people(spark, rows)
    assert not any({"1", "2"} <= set(x) for x in got) and ["5", "6", "7"] in got


def test_merged_profiles_meet_others_by_the_spellings_they_make_together(spark):
    rows = [
        ("1", "Gwendolyn Ashworthy", None), ("2", "GWENDOLYN ASHWORTHY", ""), ("3", "Gwendolyn Ashwurthy", None), ("4", "Gwendolyns Ashworthy", None), ("5", "Gwendolyns Ashwurthyy", None),  # 5 is two errors away from each, one from what 1, 3 and 4 make together
        ("6", "Bertholda K. Quimbleton", None), ("7", "Bertholda Quimbleton", None), ("8", "BERTHOLDA QUIMBLETON", " "), ("9", "Bertholda J. Quimbletn", None),  # K. learnt by the merge forbids J.
    ]
    got = people(spark, rows)
    assert ["1", "2", "3", "4", "5"] in got and ["6", "7", "8"] in got and ["9"] in got


def test_short_forms_are_a_parameter(spark):
    rows = [("1", "Wilhelmina Trotwood", "wtrotwood@a.example", "x"), ("2", "Mina Trotwood", None, "x")]
    df = spark.createDataFrame(rows, "person_id string, pi_name string, pi_email string, entity string")
    joined = lambda **more: entities.resolve(entities.person_spellings(df, **more)).select("entity").distinct().count()
    assert joined() == 2 and joined(short_forms=entities.SHORT_FORMS | {"wilhelmina": "mina minnie"}) == 1


def test_spellings_of_organisations(spark):
    rows = [("a", "University of Oakford", "Oakford"), ("b", "Oakford, Univ. of", "Oakford"), ("c", "UNIVERSTY OF OAKFORD", None), ("d", "Oakford State University", "Oakford"), ("e", "St. U., Oakford", None), ("f", "Oakfrod Community College Inc", "Oakford"), ("g", "Oakford CC", "Oakford"), ("h", None, "Oakford"), ("i", " ", None), ("j", "University of Elmbury", "Elmbury")]
    df = spark.createDataFrame(rows, "institution_id string, organization_clean string, organizationcity string")
    found = {}
    for r in entities.resolve(entities.organisation_spellings(df)).collect():
        found.setdefault(r["entity"], set()).add(r["id"])
    assert sorted(sorted(x) for x in found.values()) == [["a", "b", "c"], ["d", "e"], ["f", "g"], ["j"]]


def test_organisations_are_matched_by_name_and_city_is_evidence(spark):
    rows = [
        ("a", "University of Chicago", "Chicago"), ("b", "Loyola University Chicago", "Chicago"), ("c", "Univ. of Chicgo", "Chicago"), ("d", "Elmbury College", "Elmbury"), ("e", "ELMBURY COLL", "Oakford"), ("f", "Tarnwick Kombinat", "Tarnwick"), ("g", "Tarnwick, Kombinat", "Elmbury"),
        ("h", "Hanbridge College", "Hanbridge"), ("i", "Handbridge College", "Handbridge"), ("j", "Community College", "Oakford"), ("k", "Oakford Community College", None), ("l", "Tarnwick Kombinaat", "Tarnwick"),
    ]
    df = spark.createDataFrame(rows, "institution_id string, organization_clean string, organizationcity string")
    found = {}
    for r in entities.resolve(entities.organisation_spellings(df)).collect():
        found.setdefault(r["entity"], set()).add(r["id"])
    assert sorted(sorted(x) for x in found.values()) == [["a", "c"], ["b"], ["d", "e"], ["f", "g", "l"], ["h"], ["i"], ["j", "k"]]


def test_rounds_of_merging_give_up_their_files(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(entities, "release", lambda spark, real=entities.release: calls.append(1) or real(spark))
    df = spark.createDataFrame([("1", "John Smith", "john.smith@a.org"), ("2", "J. Smith", None), ("3", "Jon Smith", None)], "person_id string, pi_name string, pi_email string")
    got = {r["id"]: r["entity"] for r in entities.resolve(entities.person_spellings(df)).collect()}
    assert got["2"] == got["1"] == "1" and len(calls) >= 4  # before the rounds, and in each that merges


def test_blocks_are_moved_to_their_keys_once(spark, monkeypatch):
    rows = [("1", "Gwendolyn Ashworthy"), ("2", "GWENDOLYN ASHWORTHY"), ("3", "Gwendolyn Ashwurthy"), ("4", "Gwendolyns Ashworthy"), ("5", "Gwendolyns Ashwurthyy")]  # the last is met by spellings that others make together
    df = spark.createDataFrame([(*x, None) for x in rows], "person_id string, pi_name string, pi_email string")
    meets = []
    monkeypatch.setattr(entities, "_meet", lambda looks, found, real=entities._meet: meets.append((looks, found)) or real(looks, found))
    monkeypatch.setattr(entities, "SPELLINGS_A_PART", 1, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r["entity"] for r in entities.resolve(entities.person_spellings(df)).collect()} == {"1"}
        (looks, found), *later = meets
        moved = lambda a, b: a.withColumnRenamed("no", "p").join(b, "key")._jdf.queryExecution().executedPlan().toString().count("Exchange")
        assert moved(looks, found) == 0
        assert later and all(any(x is looks or x is found for x in sides) for sides in later[:2]) and [moved(*sides) for sides in later[:2]] == [1, 1]  # the new spellings only
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_names_of_empty_tables(spark):
    assert entities.resolve(entities.person_spellings(spark.createDataFrame([], "person_id string, pi_name string, pi_email string"))).count() == 0


# 6 tokens


def test_ids_equal_the_tokenizer_and_round_trip(spark):
    from tokenizers import Tokenizer

    odd = [None, "", " ", "\t\n  x", "<|endoftext|>", "a" * 3000, "é" * 700, "x́y \U0001f469‍\U0001f52c", "123456 7890's don't", "-" * 999, "中文 text", text(20000, 1), text(50, 2), text(50, 2)]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(odd)], "doc_id bigint, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_texts(df).collect()}
    reference = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    assert got == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(odd)}
    assert all(tokens.decode_ids(got[i]) == (t or "") for i, t in enumerate(odd))
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}


def test_ids_of_very_long_words():
    import time

    from tokenizers import Tokenizer

    r = random.Random(11)
    reference = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    own = tokens.BpeEncoder("byte_bpe_50k", tokens.TOKENIZERS)
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(200_000))
    began = time.time()
    assert own.encode([long])[0] == reference.encode(long, add_special_tokens=False).ids
    assert time.time() - began < 10
    for n in range(60):
        part = "".join(r.choice("abcdefghijklmnopqrstuvwxyz"[: r.choice([1, 2, 3, 5, 12, 26])]) for _ in range(r.randrange(201, 900)))
        assert own.encode([part])[0] == reference.encode(part, add_special_tokens=False).ids
    assert own.decode([own.encode([long])[0], None, []]) == [long, "", ""]


def test_ids_of_empty_table(spark):
    assert tokens.encode_texts(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# 7 mix


def test_mix_reaches_shares(spark):
    rows = [(i, text(30, i), ["big", "mid", "tiny", None, "unlisted"][0 if i < 600 else 1 if i < 900 else 2 if i < 915 else 3 if i < 920 else 4], 9) for i in range(930)] + [(5000, None, "big", 9), (5001, "", "mid", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens int")
    weights = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 2), ("tiny", 0.1, 3), ("absent", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(docs, weights)
    mix = mix.cache()
    assert mix.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert mix.where("source is null or source = 'unlisted' or doc_id >= 5000").count() == 0
    got = {r["source"]: r for r in report.collect()}
    assert got["tiny"]["exhausted"] and got["tiny"]["most_repeats"] == 3 and got["big"]["most_repeats"] == 1
    assert abs(got["mid"]["n_tokens"] / got["big"]["n_tokens"] - 0.8) < 0.02
    _, small = mixing.mix_sources(docs, weights, budget=2000)
    for r in small.collect():
        if r["source"] in ("big", "mid", "tiny"):
            assert abs(r["actual_share"] - r["target_share"]) < 0.05


def test_finish_limit_serves_the_budget():
    supply, share = {"a": 100, "b": 1000, "c": 0}, {"a": 0.5, "b": 0.3, "c": 0.2}
    for budget in (10, 150, 900):
        time = mixing.finish_limit(supply, share, budget)
        assert abs(sum(min(supply[s], share[s] * time) for s in share) - budget) < 1e-6
    assert mixing.finish_limit(supply, share, 5000) == float("inf")


def test_mix_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    mix, report = mixing.mix_sources(docs, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))
    assert mix.count() == 0 and report.first()["n_tokens"] == 0


# 8 subjects


def test_subjects_of_held_out_examples(spark):
    """Held-out labelled texts: most get their subject and few get another."""
    examples = spark.read.parquet("/root/testdata/sf0.01/subject_examples.parquet")
    areas = spark.read.parquet("/root/testdata/sf0.01/subject_areas.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = examples.where("example_id % 4 = 0 and lang = 'en'")
    extra = held.select((F.col("example_id") + 10**9).cast("bigint").alias("doc_id"), "text")
    odd = spark.createDataFrame([(2 * 10**9, None), (2 * 10**9 + 1, ""), (2 * 10**9 + 2, " \n "), (2 * 10**9 + 3, "<p></p> 12 %")], "doc_id bigint, text string")
    out = subjects.assign_subjects(docs.unionByName(extra).unionByName(odd), examples.where("not (example_id % 4 = 0 and lang = 'en')"), areas).cache()
    assert out.where(f"doc_id >= {2 * 10**9}").count() == 0
    got = out.where(f"doc_id >= {10**9}").join(held.select((F.col("example_id") + 10**9).cast("bigint").alias("doc_id"), F.col("subject").alias("truth")), "doc_id")
    right, n = got.where("subject = truth").count(), held.count()
    assert right > 0.5 * n and right > 0.85 * got.count()


def test_subjects_do_not_depend_on_partitions(spark):
    tables = {x: spark.read.parquet(f"/root/testdata/sf0.001/{x}.parquet") for x in ("documents", "subject_examples", "subject_areas")}
    got = [subjects.assign_subjects(tables["documents"].repartition(n), tables["subject_examples"].repartition(n), tables["subject_areas"]) for n in (3, 17)]
    rows = [sorted(map(tuple, x.collect())) for x in got]
    assert rows[0] and rows[0] == rows[1]


def test_subjects_with_a_larger_table_of_vectors(spark):
    """Held-out examples, whole: the subject with the most sentences, with two sizes of the table."""
    examples = spark.read.parquet("/root/testdata/sf0.01/subject_examples.parquet")
    areas = spark.read.parquet("/root/testdata/sf0.01/subject_areas.parquet")
    held = examples.where("example_id % 4 = 1 and lang = 'en'")
    docs = held.select(F.col("example_id").cast("bigint").alias("doc_id"), "text")
    for buckets in (subjects.BUCKETS // 4, subjects.BUCKETS):
        out = subjects.assign_subjects(docs, examples.join(held, "example_id", "left_anti"), areas, buckets)
        got = out.join(held.select(F.col("example_id").cast("bigint").alias("doc_id"), F.col("subject").alias("truth")), "doc_id")
        assert got.where("subject = truth").count() > 0.8 * got.count()


def test_all_examples_and_documents_are_learned_from(spark, monkeypatch):
    held = []
    monkeypatch.setattr(subjects, "_synchronised", lambda rows, model, *_: held.append(rows) or model)
    examples = spark.range(21_000).selectExpr("id as example_id", "'law' as subject", "concat('court ', id) as text")
    docs = spark.range(9_000).selectExpr("id as doc_id", "concat('the court met. word', id) as text")
    subjects.train(examples, docs, ["law"])
    counts = {rows.count() for rows in (held[0], held[-1])}
    assert counts == {21_000, 9_000} and max(r["count"] for r in held[0].groupBy("shard").count().collect()) < 1.2 * subjects.SHARD_ROWS


def test_what_sentences_of_documents_teach():
    import numpy as np

    scores = np.zeros((10, 3), "float32")
    scores[[0, 1, 2, 3, 4], 0] = 1  # one document: five sentences of subject 0, two of subject 1, one of none
    scores[[5, 6], 1] = 1
    target, use = subjects.corpus_targets(scores, np.array([0] * 8 + [1] * 2), 2)
    assert target[:8, 0].tolist() == [1] * 5 + [0, 0] + [1] and use.tolist() == [True] * 5 + [False] * 2 + [True] * 3
    scores[6] = 0  # now one sentence of subject 1: a passing mention
    target, use = subjects.corpus_targets(scores, np.array([0] * 8 + [1] * 2), 2)
    assert target[5].tolist() == [0, 0, 0] and use.all()


def test_gradient_steps_equal_sums_over_all_words_and_rows():
    import numpy as np

    rng = np.random.default_rng(5)
    texts = [[f"w{rng.integers(30)}" * int(rng.integers(1, 4)) for _ in range(rng.integers(1, 12))] for _ in range(40)]
    words = subjects.Words(texts, 64)
    of = np.array([3, 17, 5, 30, 31])
    step, table, to_mean = words.pick(of), rng.standard_normal((64, subjects.DIM)), rng.standard_normal((5, subjects.DIM))
    mean, gradient = np.zeros((5, subjects.DIM)), np.zeros((64, subjects.DIM))
    for k, s in enumerate(of):
        for w in texts[s]:
            rows = subjects.word_rows(w, 64)
            mean[k] += table[rows].mean(axis=0) / len(texts[s])
            np.add.at(gradient, rows, to_mean[k] / len(texts[s]) / len(rows))
    assert np.allclose(step.mean(table[step.touched]), mean, atol=1e-5) and np.allclose(step.table_gradient(to_mean), gradient[step.touched], atol=1e-5)
    assert not gradient[np.setdiff1d(np.arange(64), step.touched)].any() and step.share.shape[1] <= len({w for s in of for w in texts[s]})


def test_sentences_of_long_markup_and_marks():
    assert subjects.sentences("<a " + "x" * 5000 + ">One two.</a> Three") == [["one", "two"], ["three"]]
    assert subjects.sentences("< " * 50_000 + "word") == [["word"]]


def test_subjects_without_examples_or_documents(spark):
    areas = spark.createDataFrame([("a",), (None,)], "subject string")
    examples = spark.createDataFrame([], "example_id int, subject string, text string")
    docs = spark.createDataFrame([(1, "some words. more words.")], "doc_id bigint, text string")
    assert subjects.assign_subjects(docs, examples, areas).count() == 0
    assert subjects.assign_subjects(docs.limit(0), examples, areas.limit(0)).count() == 0
