"""Problem 1: train, validation and test splits that keep related records together, by largest differencing.

Records tied by an id form components. The sizes of the components are balanced into many equal bins by largest differencing, and whole
bins are dealt to the splits by their target shares.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.components import connected_components
from tesserae.operators.skew import bucketed_running, lookup, permuted
from tesserae.session import cut_lineage

#: Words for "not known", compared without case, signs and spaces; a value without any letter or digit is none either. Fixed values.
NOT_KNOWN = ["unknown", "notknown", "none", "na", "nan", "null", "nil", "missing", "tbd", "tba", "notavailable", "notapplicable", "unspecified", "notspecified", "unassigned", "undefined", "anonymous", "blank", "empty", "noid", "nodata", "no", "nat", "unk", "x", "xx", "xxx"]
#: Equal bins into which the components are balanced; most splits.
BINS, MAX_SPLITS = 200, 1000


def tie_key(col: Column | str) -> Column:
    """An id without case and surrounding white space; null if it says nothing."""
    col = F.col(col) if isinstance(col, str) else col
    trimmed = F.lower(F.regexp_replace(col, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", ""))
    bare = F.regexp_replace(trimmed, r"(?U)[^\p{L}\p{N}]+", "")
    return F.when((bare != "") & ~bare.isin(NOT_KNOWN), trimmed)


def tied_groups(df: DataFrame, id_col: str, ties: list[str]) -> DataFrame:
    """``(id_col, first_id, n_rows)``: for each row the smallest id of its group and the number of rows in it.

    Rows belong together if they share a value of a column of ``ties``, and so does all that is reached through further rows.
    Values that are null, blank or say "not known" tie nothing. The graph has values as nodes and one edge per distinct combination of values,
    so a value that ties a third of all rows is one node. Rows with null id are left out; an empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("id"), *[F.concat(F.lit(f"{k}:"), tie_key(c)).alias(f"k{k}") for k, c in enumerate(ties)])
    keys = [f"k{k}" for k in range(len(ties))]
    rows = rows.where("id is not null").withColumn("node", F.coalesce(*keys))
    rows = cut_lineage(rows)
    edges = reduce(DataFrame.unionAll, [rows.where(f"{a} is not null and {b} is not null").select(F.col(a).alias("src"), F.col(b).alias("dst")) for k, a in enumerate(keys) for b in keys[k + 1 :]]).distinct()
    nodes = reduce(DataFrame.unionAll, [rows.where(f"{k} is not null").select(F.col(k).alias("node"), "id", (F.col(k) == F.col("node")).alias("own")) for k in keys])
    nodes = nodes.groupBy("node").agg(F.min("id").alias("id"), F.sum(F.col("own").cast("bigint")).alias("n"))
    labelled = nodes.join(connected_components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = cut_lineage(labelled)
    whole = labelled.groupBy("component").agg(F.min("id").alias("first_id"), F.sum("n").alias("n_rows"))
    of_node = lookup(labelled.select("node", "component"), whole, "component").select("node", "first_id", "n_rows")
    out = lookup(rows.select("id", "node"), of_node, "node", "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("first_id", "id").alias("first_id"), F.coalesce("n_rows", F.lit(1)).alias("n_rows"))


def difference_bins(sizes: list[tuple[int, int]], bins: int = BINS) -> list[dict[int, int]]:
    """``bins`` bins of near-equal weight; each maps a size to its number of components. ``sizes``: (size, how many).

    Largest differencing: a partial solution is a row of bin weights; the two solutions with the widest spread are merged, heaviest bin
    upon lightest, until one is left. Of equal sizes every full round of ``bins`` is level and is set aside at once, so that at most
    ``bins - 1`` of each distinct size are merged, and ``n`` rows have at most ``sqrt(2 n)`` distinct sizes. This runs on the driver, in about 20 us a merge.
    """
    out: list[dict[int, int]] = [{} for _ in range(bins)]
    heap, made = [], []
    for size, count in sorted(sizes, reverse=True):
        if count >= bins:
            for b in out:
                b[size] = count // bins
        for _ in range(count % bins):
            weights = np.zeros(bins, dtype="int64")
            weights[0] = size
            made.append((weights, size, None))
            heap.append((-size, len(made) - 1))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        weights = made[i][0] + made[j][0][::-1]
        order = np.argsort(-weights, kind="stable").astype("int32")
        weights = weights[order]
        made.append((weights, None, (i, j, order)))
        made[i], made[j] = (None, *made[i][1:]), (None, *made[j][1:])
        heapq.heappush(heap, (-int(weights[0] - weights[-1]), len(made) - 1))
    if heap:
        todo = [(heap[0][1], np.arange(bins, dtype="int32"))]  # place[k]: the bin that holds weight k of the solution
        while todo:
            n, place = todo.pop()
            _, size, parts = made[n]
            if parts is None:
                b = out[place[0]]
                b[size] = b.get(size, 0) + 1
            else:
                i, j, order = parts
                at = np.empty(bins, dtype="int32")
                at[order] = place
                todo += [(i, at), (j, at[::-1])]
    return out


def deal_bins(bins: list[dict[int, int]], shares: dict[str, float]) -> list[str]:
    """A split for each bin: heaviest first, to the split that is furthest below its target; ties by name."""
    weights = [sum(size * n for size, n in b.items()) for b in bins]
    total, names = sum(weights), sorted(shares)
    held, out = dict.fromkeys(names, 0), [""] * len(bins)
    for k in sorted(range(len(bins)), key=lambda k: (-weights[k], k)):
        out[k] = max(names, key=lambda s: (shares[s] * total - held[s], shares[s]))
        held[out[k]] += weights[k]
    return out


def grouped_split(df: DataFrame, id_col: str, ties: list[str], targets: DataFrame, bins: int = BINS, seed: int = 42) -> DataFrame:
    """``(id_col, first_id, n_rows, bin, split)``: rows that are tied (see ``tied_groups``) get the same split, near the target shares.

    The driver sees only how many components there are of each size: ``n`` rows have at most ``sqrt(2 n)`` distinct sizes. Components of a size
    are dealt to bins by their permuted rank. ``targets``: ``split_name, target_share``; shares are scaled to add up to 1.
    """
    listed = targets.select("split_name", "target_share").limit(MAX_SPLITS + 1).collect()
    if len(listed) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    shares = {r["split_name"]: float(r["target_share"] or 0) for r in listed}
    scale = sum(shares.values()) or 1.0
    shares = {k: v / scale for k, v in shares.items()}
    groups = cut_lineage(tied_groups(df, id_col, ties))
    heads = groups.select("first_id", "n_rows").distinct()
    sizes = [(r["n_rows"], r["count"]) for r in heads.groupBy("n_rows").count().collect()]
    solved = difference_bins(sizes, bins)
    names = deal_bins(solved, shares) if shares else [None] * bins
    ranges, start = {}, {}
    for k, b in enumerate(solved):
        for size, n in sorted(b.items()):
            first = start.get(size, 1)
            ranges.setdefault(size, []).append((first, k, names[k]))
            start[size] = first + n
    # one row per size: where its ranges begin, of which there are as many as bins at most
    ranges = df.sparkSession.createDataFrame(list(ranges.items()), "n_rows bigint, ranges array<struct<low: bigint, bin: int, split: string>>")
    ranked = bucketed_running(heads.withColumn("_h", permuted("first_id", seed=seed)), "n_rows", "_h", "first_id", name="_rank")
    own = F.element_at(F.filter("ranges", lambda r: r["low"] <= F.col("_rank")), -1)
    dealt = lookup(ranked, ranges, "n_rows").select("first_id", own.alias("own")).select("first_id", "own.bin", "own.split")
    return lookup(groups, dealt, "first_id").select(id_col, "first_id", "n_rows", "bin", "split")


def split_report(split: DataFrame, targets: DataFrame) -> DataFrame:
    """``(split_name, target_share, n_rows, actual_share, n_groups)`` per split of ``grouped_split``."""
    held = split.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("first_id").alias("n_groups"))
    total = held.agg(F.sum("n_rows")).first()[0] or 0
    joined = targets.select("split_name", "target_share").join(held, F.col("split_name") == F.col("split"), "left")
    return joined.select("split_name", "target_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (F.coalesce("n_rows", F.lit(0)) / F.lit(max(total, 1))).alias("actual_share"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"))
