"""Problem 5: variant spellings of names, by merge-and-rematch resolution.

A spelling is parsed into a stable part (last name, town), a part that gets abbreviated (first name, kind of organisation), a middle initial and an anchor:
what ties rows for certain (an e-mail address). The city of an organisation is no anchor but evidence: it speaks for a partner, and against one whose name is not equal. Spellings start as small profiles. In each round every profile without anchor
looks through the blocks of all its spellings for the one profile that fits best and is merged into it. The merged profile has the spellings, initials and
anchor of both, and the spellings that they make together (the last name of one with the first name of another); with these it enters the blocks again, so that it may meet profiles that neither part has met, and
what was undecided before may be decided. The rounds end when nothing merges.
A profile takes at most one partner a round and only a richer one, so two anchors never end in one profile.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.overlap import _ACCENTED
from tesserae.session import cut_by_key, cut_lineage, release

#: Short forms of first names. Fixed values.
SHORT_FORMS = {
    "abigail": "abby gail", "alexander": "alex sandy xander", "andrew": "andy drew", "anthony": "tony", "barbara": "barb", "benjamin": "ben benny", "catherine": "cathy cath", "charles": "charlie chuck chas",
    "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "donald": "don", "dorothy": "dot dottie", "edward": "ed eddie ted ned", "eleanor": "ellie nell nora", "elizabeth": "liz libby beth betty lizzie eliza betsy",
    "frances": "fran frannie", "frederick": "fred freddie", "gabriel": "gabe", "geraldine": "gerry geri", "gregory": "greg", "harold": "hal harry", "henrietta": "hetty etta", "henry": "hank", "ignacio": "iggy nacho", "isabella": "izzy bella",
    "james": "jim jimmy jamie", "jennifer": "jen jenny", "jonathan": "jon jonny", "joseph": "joe joey", "katherine": "kate kathy katie kat", "kenneth": "ken kenny", "kimberly": "kim", "lawrence": "larry", "leonard": "len lenny", "margaret": "peggy maggie meg marge",
    "matthew": "matt", "michael": "mike mick", "nathaniel": "nate", "nicholas": "nick nicky", "oliver": "ollie", "pamela": "pam", "patricia": "pat patty tricia", "peter": "pete", "philip": "phil", "rebecca": "becky", "richard": "rich dick rick ricky",
    "robert": "bob rob bobby robbie", "roderick": "rod roddy", "ronald": "ron", "samuel": "sam sammy", "stephen": "steve", "susanna": "sue susie", "theresa": "terri tess tessa", "thomas": "tom tommy", "timothy": "tim timmy", "victoria": "vicky tori",
    "vincent": "vince vinny", "william": "will bill billy liam", "yevgenia": "yev", "yolanda": "yoli", "zachary": "zach zack", "zenobia": "zen",
}
#: Short forms of more than one name; they fit every name they begin. Fixed values.
OPEN_FORMS = ["nat"]
#: Words of organisation names that say what kind it is, with the ways in which they are shortened. Fixed values.
KIND_WORDS = {
    "university": "univ u uni", "college": "coll col", "institute": "inst", "technology": "tech technol", "state": "st", "community": "comm cmty commun", "museum": "mus", "science": "sci sciences", "school": "sch schl", "medical": "med",
    "research": "res rsch", "foundation": "fdn found foundtn", "polytechnic": "poly polytech", "hospital": "hosp", "laboratory": "lab labs", "center": "centre ctr cntr", "academy": "acad", "association": "assn assoc", "society": "soc", "department": "dept",
}
#: Shortenings that stand for several words. Fixed values.
KIND_ACRONYMS = {"cc": "community college", "it": "institute technology", "su": "state university", "rf": "research foundation"}
#: Words that say nothing about which organisation it is. Fixed values.
EMPTY_WORDS = "the of at and for in inc incorporated llc ltd main campus office grants board regents trustees".split()
#: Of a kind, words that are left out where a more telling one is there. Fixed values.
WEAK_WORDS = "university college institute school science foundation".split()
#: Least length of a word that is compared with one typing error, before or after the error.
TYPO_LENGTH = 5


def _fold(col: Column) -> Column:
    plain = F.translate(F.lower(col), "".join(_ACCENTED).lower(), "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED).lower())
    return F.regexp_replace(plain, r"[\p{M}\p{Cf}]+", "")


def _lookup_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])


def deletions(col: str) -> Column:
    """The word and all words that arise by leaving out one letter: two words with one error between them share one."""
    return F.array_distinct(F.expr(f"transform(sequence(0, length({col})), i -> concat(substring({col}, 1, i - 1), substring({col}, i + 1)))"))


def one_error(a: str, b: str) -> Column:
    """Equal but for one letter more, less or other, or two neighbours swapped; both of some length."""
    swapped = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (F.least(F.length(a), F.length(b)) >= TYPO_LENGTH - 1) & (F.greatest(F.length(a), F.length(b)) >= TYPO_LENGTH) & ((F.levenshtein(a, b) <= 1) | swapped)


def person_spellings(edges: DataFrame, short_forms: dict[str, str] = SHORT_FORMS) -> DataFrame:
    """``(id, last, first, full, mid, anchor)``: distinct parsed spellings of each ``person_id`` of award-person edges.

    Understands titles and degrees, "Last, First M.", "Last FM", "F. M. Last", short forms and double names (known by their first half). The anchor of a row with an e-mail
    address is host, last name and initial. Null or empty names without address are left out. ``short_forms`` gives the short forms of each first name, with blanks between them.
    """
    rows = edges.where("person_id is not null").select(F.col("person_id").alias("id"), F.coalesce("pi_name", F.lit("")).alias("name"), F.lower(F.trim(F.coalesce("pi_email", F.lit("")))).alias("mail")).distinct()
    text = F.regexp_replace(F.regexp_replace(_fold(F.col("name")), r"[.\p{Z}\s_]+", " "), r"[^\p{L}\p{N} ,-]+", "")
    text = F.regexp_replace(text, r"^ *(dr|prof|professor|mr|mrs|ms|miss|sir) ", "")
    text = F.trim(F.regexp_replace(text, r" *, *(md|phd|ph d|jr|sr|ii|iii|iv|esq|dds|edd|ed d) *$", ""))
    rows = rows.withColumn("t", F.trim(F.regexp_replace(text, " +", " "))).withColumn("w", F.split("t", " "))
    comma, tail = F.instr("t", ",") > 0, F.element_at("w", -1)
    initials = (F.size("w") >= 2) & (F.length(tail) <= 2) & (F.length(F.element_at("w", 1)) > 2)
    last = F.when(comma, F.trim(F.substring_index("t", ",", 1))).when(initials, F.array_join(F.expr("slice(w, 1, size(w) - 1)"), " ")).otherwise(tail)
    given = F.when(comma, F.trim(F.expr("substring(t, instr(t, ',') + 1)"))).when(initials, F.array_join(F.split(tail, ""), " ")).otherwise(F.array_join(F.expr("slice(w, 1, size(w) - 1)"), " "))
    rows = rows.withColumn("last", F.regexp_replace(F.substring_index(last, "-", 1), "[^a-z0-9]", "")).withColumn("g", F.filter(F.split(F.trim(given), "[ ,]+"), lambda x: x != ""))
    formal = _lookup_map({short: name for name, shorts in short_forms.items() for short in shorts.split()})
    first = F.coalesce(F.get("g", F.lit(0)), F.lit(""))
    rows = rows.withColumn("first", F.coalesce(F.try_element_at(formal, first), first)).withColumn("mid", F.substring(F.get("g", F.lit(1)), 1, 1))
    local, host = F.substring_index("mail", "@", 1), F.substring_index("mail", "@", -1)
    known = F.col("mail").contains("@")
    bare = F.regexp_replace(local, r"[0-9]+$", "")
    own = F.when(bare.rlike(r"[._]"), F.regexp_extract(bare, r"([^._]+)$", 1)).otherwise(F.substring(bare, 2, 200))
    anchor = F.when(known, F.concat_ws("|", host, own, F.substring(bare, 1, 1)))
    out = rows.select("id", "last", "first", ((F.length("first") > 1) & ~F.col("first").isin(OPEN_FORMS)).alias("full"), "mid", anchor.alias("anchor"))
    return out.where("anchor is not null or (last <> '' and first <> '')").distinct()


def organisation_spellings(awards: DataFrame) -> DataFrame:
    """``(id, last, first, full, mid, anchor, town)``: spellings of each ``institution_id``; last are the name's own words, first the kind, town the city. None has an anchor.

    Null and blank organisations are left out. The city of an id is the one most of its rows have; a name without words of its own is known by it. A name without a known kind has the kind ``-``.
    """
    rows = awards.where("institution_id is not null and trim(organization_clean) <> ''").groupBy(F.col("institution_id").alias("id"), F.col("organization_clean").alias("name"), F.trim(_fold(F.col("organizationcity"))).alias("city")).count()
    words = F.filter(F.split(F.regexp_replace(_fold(F.col("name")), r"[^\p{L}\p{N}]+", " "), " "), lambda w: (w != "") & ~w.isin(EMPTY_WORDS))
    rows = rows.withColumn("w", words)
    spelled = {s: k for k, v in KIND_WORDS.items() for s in [k, *v.split()]} | KIND_ACRONYMS
    near = F.array(*[F.lit(k) for k in KIND_WORDS])
    known = _lookup_map(spelled)
    # a kind word may have one typing error
    meant = F.transform("w", lambda w: F.coalesce(F.try_element_at(known, w), F.when(F.length(w) >= TYPO_LENGTH, F.get(F.filter(near, lambda k: (F.levenshtein(k, w) <= 1) | ((F.levenshtein(k, w) == 2) & (F.length(k) == F.length(w)))), F.lit(0))), F.concat(F.lit("="), w)))
    rows = rows.withColumn("m", F.split(F.array_join(meant, " "), " "))
    kinds = F.array_sort(F.array_distinct(F.filter("m", lambda w: ~w.startswith("="))))
    telling = F.filter(kinds, lambda w: ~w.isin(WEAK_WORDS))
    # a foundation of research and a university without any other word keep their weak word
    rows = rows.withColumn("first", F.array_join(F.when(F.size(telling) > 0, telling).otherwise(kinds), " "))
    rows = rows.withColumn("last", F.array_join(F.transform(F.filter("m", lambda w: w.startswith("=")), lambda w: F.regexp_replace(w, "^=", "")), ""))
    city = F.max_by(F.regexp_replace("city", "[^a-z0-9]", ""), F.struct("count", "city"))
    town = rows.where("city <> ''").groupBy("id").agg(city.alias("town"))
    rows = rows.join(town, "id", "left").withColumn("town", F.when(F.col("town") != "", F.col("town")))
    own = F.when(F.col("last") == "", F.coalesce("town", F.lit(""))).otherwise(F.col("last"))
    kind, none = F.when(F.col("first") == "", "-").otherwise(F.col("first")), F.lit(None).cast("string")
    return rows.select("id", own.alias("last"), kind.alias("first"), F.lit(True).alias("full"), none.alias("mid"), none.alias("anchor"), "town").distinct()


#: Columns that tell the spellings of profiles apart.
NUMBERED = ["ent", "last", "first", "mid", "town"]
#: Spellings whose blocks make one part; a spelling of check_l looks in 18 blocks and is found in 30.
SPELLINGS_A_PART = 10_000


def blocks(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(no, key)`` twice: the blocks in which spellings without anchor look for partners, and those in which all spellings are found.

    Blocks are made so that no pair arises only from a common last name: the whole first part or the initial of a shortened one is always part of the key. Whole first
    parts meet by first part and last part but for an error (1), or the other way round (2); shortened ones meet all by initial (3), and whole ones meet shortened ones (4).
    """
    def key(kind: int, errors: Column, rest: str) -> Column:
        return F.transform(errors, lambda d: F.xxhash64(F.lit(kind), d, F.col(rest)))

    rows = names.select("no", "anchored", "full", "last", "first", F.substring("first", 1, 1).alias("initial"), _errors("last").alias("l"), _errors("first").alias("f"))
    whole, initial = F.concat(key(1, F.col("l"), "first"), key(2, F.col("f"), "last")), lambda kind: key(kind, F.col("l"), "initial")
    looks = rows.where("not anchored").select("no", F.explode(F.when(F.col("full"), F.concat(whole, initial(4))).otherwise(initial(3))).alias("key"))
    found = rows.select("no", F.explode(F.when(F.col("full"), F.concat(whole, initial(3))).otherwise(F.concat(initial(3), initial(4)))).alias("key"))
    return looks, found


def _fits(pairs: DataFrame) -> DataFrame:
    """Pairs of spellings p and a that may mean the same, with their cost: an error weighs 2, a shortened first part 1; the same town is in their favour, and in different towns only equal names fit."""
    err_last, err_first = one_error("last_p", "last_a"), one_error("first_p", "first_a")
    last = F.when(F.col("last_p") == F.col("last_a"), 0).when(err_last, 2)
    short = ~(F.col("full_p") & F.col("full_a")) & (F.col("first_a").startswith(F.col("first_p")) | F.col("first_p").startswith(F.col("first_a")))
    first = F.when(F.col("first_p") == F.col("first_a"), F.when(F.col("full_p"), 0).otherwise(1)).when(short, 1).when(F.col("full_p") & F.col("full_a") & err_first, 2)
    mids = F.coalesce(F.col("mid_p") != F.col("mid_a"), F.lit(False))
    pairs = pairs.withColumn("last_cost", last).withColumn("first_cost", first).where("last_cost is not null and first_cost is not null and last_cost + first_cost < 4").where(~mids)
    both = F.coalesce(F.col("mid_p") == F.col("mid_a"), F.lit(False)).cast("int")
    cost = F.col("last_cost") + F.col("first_cost")
    pairs = pairs.withColumn("near", F.coalesce((F.col("town_p") == F.col("town_a")).cast("int"), F.lit(0))).where((cost == 0) | F.coalesce(F.col("town_p") == F.col("town_a"), F.lit(True)))
    return pairs.select("ent_p", "ent_a", (2 * cost - both - F.col("near")).alias("cost"), "near")


def candidates(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(p, a, cost, near)`` of profiles of which spellings meet in ``pairs (p, a)`` and fit; p has no anchor."""
    cols = ["ent", "last", "first", "full", "mid", "town"]
    pairs = pairs.where("p <> a").distinct().join(names.select(F.col("no").alias("p"), *[F.col(c).alias(f"{c}_p") for c in cols]), "p")
    pairs = pairs.join(names.select(F.col("no").alias("a"), *[F.col(c).alias(f"{c}_a") for c in cols]), "a")
    return _fits(pairs.where("ent_p <> ent_a")).groupBy(F.col("ent_p").alias("p"), F.col("ent_a").alias("a")).agg(F.min("cost").alias("cost"), F.max("near").alias("near"))


def _meet(looks: DataFrame, found: DataFrame) -> DataFrame:
    return looks.withColumnRenamed("no", "p").join(found.withColumnRenamed("no", "a"), "key").select("p", "a")


def _made_together(names: DataFrame, label: DataFrame, prof: DataFrame, moves: DataFrame) -> DataFrame:
    """Spellings that profiles merged by ``moves`` have only together: every last part with every first part, with the initial if they have but one."""
    grown = prof.join(moves.select(F.col("a").alias("now")).distinct(), "now", "left_semi").select("now", F.col("anchored").alias("sure"))
    own = names.join(label.join(grown, "now"), "ent")
    whole = own.groupBy("now").agg(F.collect_set("last").alias("lasts"), F.collect_set(F.struct("first", "full")).alias("firsts"), F.collect_set("mid").alias("mids"), F.min("town").alias("town"), F.max("sure").alias("anchored"), F.collect_set(F.struct("last", "first")).alias("old"))
    mid = F.when(F.size("mids") == 1, F.get("mids", F.lit(0)))
    every = F.flatten(F.transform("lasts", lambda x: F.transform("firsts", lambda y: F.struct(x.alias("last"), y["first"].alias("first"), y["full"].alias("full")))))
    new = F.filter(every, lambda z: ~F.exists("old", lambda o: (o["last"] == z["last"]) & (o["first"] == z["first"])))
    rows = whole.where("size(lasts) > 1 and size(firsts) > 1").select(F.col("now").alias("ent"), F.explode(new).alias("z"), mid.alias("mid"), "town", "anchored")
    return rows.select("ent", "z.last", "z.first", "z.full", "mid", "town", "anchored").withColumn("no", F.xxhash64(*NUMBERED)).select(*names.columns)


def _errors(col: str) -> Column:
    return F.when(F.length(col) >= TYPO_LENGTH - 1, deletions(col)).otherwise(F.array(F.col(col)))


def resolve(spellings: DataFrame) -> DataFrame:
    """``(id, entity)`` for every id of ``spellings``; ``entity`` is the smallest id of the entity.

    A profile with several equally good partners is left alone in that round: it may be decided when they have merged. Organisations in its own town that fit equally well by name are spellings of one: it takes the richest.
    Profiles whose middle initials differ never merge; two that would meet in a third one without initials both stay. Every round merges at least two profiles, so the rounds end. Ids without anything to go by are left out.
    """
    if "town" not in spellings.columns:
        spellings = spellings.withColumn("town", F.lit(None).cast("string"))
    spellings = cut_lineage(spellings)
    free = spellings.where("anchor is null").groupBy("last", "first").agg(F.count_distinct("mid").alias("n_mid"))
    marked = spellings.join(free, ["last", "first"], "left")
    name = F.concat_ws("|", F.lit("name"), "last", "first", F.when(F.col("n_mid") > 1, F.coalesce("mid", F.lit("?"))))
    marked = cut_lineage(marked.withColumn("key", F.coalesce(F.concat(F.lit("@|"), "anchor"), name)).withColumn("anchored", F.col("anchor").isNotNull()))
    # profiles are numbered once; the numbers are read from the checkpoint from then on. Richer: with anchor, then with a whole first part, then more spellings
    heads = marked.groupBy("key").agg(F.max(F.struct("anchored", "full")).alias("best"), F.count("*").alias("n"), F.collect_set("mid").alias("mids"))
    heads = cut_lineage(heads.withColumn("ent", F.monotonically_increasing_id()))
    marked = cut_lineage(marked.join(heads.select("key", "ent"), "key").withColumn("h", F.xxhash64("key")).drop("key", "anchor", "n_mid"))
    names = marked.where("last <> '' and first <> ''").select("ent", "last", "first", "full", "mid", "town", "anchored").distinct()
    names = cut_lineage(names.withColumn("no", F.xxhash64(*NUMBERED)))
    spark = names.sparkSession
    del spellings, free
    release(spark)
    # the blocks are moved to their keys once, one table after the other; in later rounds only the new spellings are moved to them
    parts = 1 + names.count() // SPELLINGS_A_PART
    looks, found = blocks(names)
    looks = cut_by_key(looks, parts, "key")
    release(spark)
    found = cut_by_key(found, parts, "key")
    release(spark)
    late_looks, late_found = looks.limit(0), found.limit(0)  # the blocks of spellings that rounds have made
    links = cut_lineage(candidates(names, _meet(looks, found)))
    release(spark)
    prof = heads.select(F.col("ent").alias("now"), F.col("best.anchored"), F.struct(F.col("best.anchored"), F.col("best.full"), "n", F.xxhash64("key").alias("h"), "ent").alias("rank"), "mids")
    label = heads.select("ent", F.col("ent").alias("now"))
    while True:
        left = prof.where("not anchored").select(F.col("now").alias("p"), F.col("rank").alias("rank_p"), F.col("mids").alias("mids_p"))
        right = prof.select(F.col("now").alias("a"), F.col("anchored").alias("sure"), F.col("rank").alias("rank_a"), F.col("mids").alias("mids_a"))
        # only richer profiles: the poorer ones may come to this one
        open_ = links.join(left, "p").join(right, "a").where("rank_a > rank_p and (size(mids_p) = 0 or size(mids_a) = 0 or arrays_overlap(mids_p, mids_a))")
        # of the fitting profiles the cheapest, those with an anchor first; undecided if there are several, unless all are of one kind in one town
        open_ = open_.withColumn("order", F.struct("cost", (~F.col("sure")).alias("unsure")))
        best = open_.groupBy("p", "order").agg(F.count("*").alias("k"), F.min("near").alias("near"), F.max_by(F.struct("a", "mids_a"), "rank_a").alias("to"), F.first("mids_p").alias("mids_p"))
        best = best.groupBy("p").agg(F.min_by(F.struct("k", "near", "to", "mids_p"), "order").alias("b"))
        moves = cut_lineage(best.where("b.k = 1 or b.near = 1").select("p", "b.to.*", "b.mids_p"))
        # of partners that would bring different initials to one without any, none moves
        split = moves.where("size(mids_a) = 0").select("a", F.explode("mids_p").alias("mid")).groupBy("a").agg(F.count_distinct("mid").alias("n_mid")).where("n_mid > 1").select("a")
        moves = moves.where("size(mids_p) = 0").unionByName(moves.where("size(mids_p) > 0").join(split, "a", "left_anti"))
        # one with initials waits for a partner that moves on itself
        gone = moves.select(F.col("p").alias("a"))
        moves = cut_lineage(moves.where("size(mids_p) = 0").unionByName(moves.where("size(mids_p) > 0").join(gone, "a", "left_anti")).select("p", "a"))
        if moves.isEmpty():
            break
        on = moves.select(F.col("p").alias("a"), F.col("a").alias("b"))
        moves = moves.join(on, "a", "left").select("p", F.coalesce("b", "a").alias("a"))  # a partner may have moved on itself
        moves = cut_lineage(moves.join(on.select("a"), "a", "left_anti"))  # if that one has too, it waits for the next round
        step = lambda rows, col: rows.join(moves.select(F.col("p").alias(col), F.col("a").alias("_to")), col, "left").withColumn(col, F.coalesce("_to", col)).drop("_to")
        label = cut_lineage(step(label, "now"))
        prof = cut_lineage(step(prof, "now").groupBy("now").agg(F.max("anchored").alias("anchored"), F.max("rank").alias("rank"), F.array_distinct(F.flatten(F.collect_set("mids"))).alias("mids")))
        links = step(step(links, "p"), "a")
        # merged profiles enter the blocks again, with the spellings that they have only now
        fresh = cut_lineage(_made_together(names, label, prof, moves))
        if not fresh.isEmpty():
            names = names.unionByName(fresh)
            new_looks, new_found = blocks(fresh)
            late_found = late_found.unionByName(new_found)
            met = [_meet(new_looks, found), _meet(looks, new_found), _meet(new_looks, late_found), _meet(late_looks, new_found)]
            more = candidates(names, reduce(DataFrame.unionByName, met))
            late_looks = late_looks.unionByName(new_looks)
            at = lambda col: label.select(F.col("ent").alias(col), F.col("now").alias(f"{col}_now"))
            links = links.unionByName(more.join(at("p"), "p").join(at("a"), "a").select(F.col("p_now").alias("p"), F.col("a_now").alias("a"), "cost", "near"))
        links = cut_lineage(links.where("p <> a").groupBy("p", "a").agg(F.min("cost").alias("cost"), F.max("near").alias("near")))
        release(spark)  # the files of the round
    of_id = marked.select("id", "ent", "h").join(label, "ent").groupBy("id").agg(F.min_by("now", F.struct("h", "ent")).alias("now"))
    first = of_id.groupBy("now").agg(F.min("id").alias("entity"))
    return of_id.join(first, "now").select("id", "entity")


def entity_pairs(resolved: DataFrame) -> DataFrame:
    """``(id_1, id_2)``, id_1 < id_2: all pairs of ids of one entity."""
    other = resolved.select("entity", F.col("id").alias("id_2"))
    return resolved.select("entity", F.col("id").alias("id_1")).join(other, "entity").where("id_1 < id_2").select("id_1", "id_2")
