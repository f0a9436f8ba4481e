"""Problem 2: records that differ only in formatting or field order, by dictionary encoding.

Every distinct field value is canonicalised once and canonical values get dense integer ids. A record then is the sorted tuple
of its field-value ids, and equal tuples are copies. Only digests of texts and integers are grouped and joined. Tuples that are the same sequence cut into the fields at
another place are found by an additive mark of the values: only records with equal marks are put together and compared.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tesserae.operators.components import connected_components
from tesserae.operators.skew import bucketed_running, lookup
from tesserae.session import cut_lineage


@F.pandas_udf(StringType())
def _canonical_unicode(texts: pd.Series) -> pd.Series:
    """Letters, digits and their marks, composed and case-folded; null where null."""
    import unicodedata

    import regex

    drop = regex.compile(r"[^\p{L}\p{N}\p{M}]+|\p{DI}+").sub

    def one(t):
        return None if t is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", drop("", t)).casefold())

    return texts.map(one)


def canonical(col):
    """The letters and digits of a text in order, without case. ASCII stays in the JVM; only other text goes to Python."""
    ascii_only = ~col.rlike(r"[^\x00-\x7F]")
    return F.when(ascii_only, F.lower(F.regexp_replace(col, "[^A-Za-z0-9]+", ""))).otherwise(_canonical_unicode(F.when(~ascii_only, col)))


#: Characters counted for the additive mark of a value, by frequency in English. Fixed value.
MARKED = "etaoinsr1"


def mark(canon: Column) -> Column:
    """A number that is the same for all ways to cut a text into parts, summed over the parts: weighted counts of characters."""
    total = F.length(canon).cast("bigint")
    for k, c in enumerate(MARKED):
        total = total + (F.length(canon) - F.length(F.replace(canon, F.lit(c), F.lit("")))).cast("bigint") * (1_000_003 * (k + 1) + 7919 * (k + 2) ** 3)
    return total


def value_dictionary(df: DataFrame, fields: list[str]) -> DataFrame:
    """``(raw, value_id, mark)``: the MD5 of every distinct value of ``fields``, the integer of its canonical form, from 1, and its mark.

    Values without a letter or digit are left out (they mean nothing, as null does). A collision of two MD5s among 10**10 values has a
    probability below 10**-18.
    """
    raw = reduce(DataFrame.unionAll, [df.select(F.col(f).alias("text")) for f in fields]).where("text is not null")
    distinct = raw.groupBy(F.md5("text").alias("raw")).agg(F.first("text").alias("text"))
    # inside a lambda the canonical form is made once, however often it is read
    read = F.transform(F.array(canonical(F.col("text"))), lambda c: F.when(c != "", F.struct(F.md5(c).alias("canon"), mark(c).alias("mark"))))
    digests = cut_lineage(distinct.select("raw", F.explode(F.array_compact(read)).alias("v")).select("raw", "v.canon", "v.mark"))
    ids = digests.select("canon").distinct().select("canon", F.lit(0).alias("g"), F.xxhash64("canon").alias("h"))
    ids = bucketed_running(ids, "g", "h", "canon", name="value_id").select("canon", "value_id")
    return cut_lineage(lookup(digests, ids, "canon").select("raw", "value_id", "mark"))


def format_copies(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """``(id_col, first_id, n_copies)``: one row per row of ``df`` with the smallest id of its copies and their number.

    Copies hold the same letters and digits in the same sequence when their fields are put together in some order, whatever the case, white space,
    punctuation, invisible characters and the field that holds them. Null and blank are the same. Rows without any letter or digit have no copy but themselves.
    Rows with a null id are left out; a repeated id is one row. An empty table gives an empty result.
    """
    rows = cut_lineage(df.select(id_col, *[F.md5(f).alias(f"_{k}") for k, f in enumerate(fields)]).where(F.col(id_col).isNotNull()))
    known = value_dictionary(df, fields)
    for k in range(len(fields)):
        rows = lookup(rows, known.select(F.col("raw").alias(f"_{k}"), F.col("value_id").alias(f"_id{k}"), F.col("mark").alias(f"_m{k}")), f"_{k}", "left").drop(f"_{k}")
    tuple_ = F.array_sort(F.filter(F.array(*[F.col(f"_id{k}") for k in range(len(fields))]), lambda x: x.isNotNull()))
    marks = reduce(lambda x, y: x + y, [F.coalesce(f"_m{k}", F.lit(0)) for k in range(len(fields))])
    encoded = cut_lineage(rows.select(id_col, F.array_join(tuple_.cast("array<string>"), ",").alias("key"), marks.alias("mark")))
    groups = encoded.where("key <> ''").groupBy("key").agg(F.min(id_col).alias("first_id"), F.count_distinct(id_col).alias("n_copies"), F.first("mark").alias("mark"))
    groups = _recut(df, id_col, fields, cut_lineage(groups)).where("n_copies > 1")
    out = lookup(encoded.select(id_col, "key"), groups, "key", "left")
    return out.select(id_col, F.coalesce("first_id", id_col).alias("first_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")).distinct()


def _recut(df: DataFrame, id_col: str, fields: list[str], groups: DataFrame) -> DataFrame:
    """``groups (key, first_id, n_copies)`` with those merged whose fields, put together in some order, are the same sequence."""
    shared = groups.groupBy("mark").agg(F.count("*").alias("_n")).where("_n > 1").select("mark")
    open_ = cut_lineage(groups.join(shared, "mark", "left_semi").select("first_id"))
    if open_.isEmpty():
        return groups.select("key", "first_id", "n_copies")
    rows = df.join(open_, F.col(id_col) == F.col("first_id"), "left_semi").select(F.col(id_col).alias("first_id"), *[canonical(F.coalesce(f, F.lit(""))).alias(f"_c{k}") for k, f in enumerate(fields)])
    orders = F.array(*[F.md5(F.concat(*[F.col(f"_c{k}") for k in p])) for p in permutations(range(len(fields)))])
    links = rows.select(F.concat(F.lit("row "), F.col("first_id").cast("string")).alias("src"), "first_id", F.explode(orders).alias("dst")).distinct()
    found = connected_components(links).withColumnRenamed("node", "src")
    roots = links.select("src", "first_id").distinct().join(found, "src")
    least = roots.groupBy("component").agg(F.min("first_id").alias("root"))
    root = cut_lineage(roots.join(least, "component").select("first_id", "root"))
    merged = groups.join(root, "first_id", "left").withColumn("root", F.coalesce("root", "first_id"))
    sums = merged.groupBy("root").agg(F.sum("n_copies").alias("n"))
    return merged.join(sums, "root").select("key", F.col("root").alias("first_id"), F.col("n").alias("n_copies"))


def collapse_copies(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """The rows of ``df`` with the smallest id of each group of copies, with the column ``n_copies``."""
    firsts = format_copies(df, id_col, fields).where(F.col(id_col) == F.col("first_id")).select(F.col(id_col).alias("_first"), "n_copies")
    return df.drop("n_copies").join(firsts, F.col(id_col) == F.col("_first")).drop("_first")
