"""Problem 3: a sample with target category proportions, by top-down allocation over the category tree.

The tree is stratum > unit > year band; its leaves are the target cells. The size of the sample is dealt from the root down: to the strata, inside each to its units, inside these to their
cells, by weight and with the minima of all cells below respected at every level. Quota that a cell can't fill goes first to its siblings
(other bands of the same unit), then to its cousins (other units of the same stratum), then to the other strata. The rows of a cell are
drawn by their rank in a permuted order, so that the same seed gives the same sample on any cluster.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tesserae.operators.skew import attach, bucketed_running, permuted

#: Most cells of a target table that the driver plans for.
MAX_CELLS = 100_000


def label_key(col: Column | str) -> Column:
    """A category label without case, padding and separators: ``Random-Background`` and ``random_background`` are one."""
    return F.btrim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "_"), F.lit("_"))


def latest_rows(df: DataFrame, key: str, order: str, id_col: str) -> DataFrame:
    """Of each ``key`` the row with the greatest ``order`` (null is least; of ties, the smallest ``id_col``, a number or a text).

    Combined before the shuffle, so a hot key is no problem. Rows without key are left out.
    """
    rest = [c for c in df.columns if c != key]
    rows = df.where(F.col(key).isNotNull())
    if isinstance(df.schema[id_col].dataType, NumericType):
        best = F.max_by(F.struct(*rest), F.struct(F.col(order), -F.col(id_col)))
        return rows.groupBy(key).agg(best.alias("_row")).select(key, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
    top = rows.groupBy(key).agg(F.max(order).alias("_top"))
    best = F.min_by(F.struct(*rest), F.struct((~F.col(order).eqNullSafe(F.col("_top"))).alias("older"), id_col))
    return attach(rows, top, [key]).groupBy(key).agg(best.alias("_row")).select(key, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def eligible(awards: DataFrame, targets: DataFrame) -> DataFrame:
    """``(record_id, award_id, cell_id)``: latest rows with abstract that lie in a cell, each in its smallest cell."""
    cols = ["record_id", "award_id", "last_amendment_date", "start_year", "has_abstract", "candidate_stratum", "nsforganization"]
    rows = latest_rows(awards.select(*cols), "award_id", "last_amendment_date", "record_id").where("has_abstract = 1 and start_year is not null")
    rows = rows.select("record_id", "award_id", "start_year", label_key("candidate_stratum").alias("_s"), label_key("nsforganization").alias("_u"))
    cells = targets.select("cell_id", "year_from", "year_to", label_key("candidate_stratum").alias("_s"), label_key("nsforganization").alias("_u"))
    met = rows.join(cells, ["_s", "_u"]).where("start_year between year_from and year_to")
    return met.groupBy("record_id", "award_id").agg(F.min("cell_id").alias("cell_id"))


def _shares(total: int, weights: dict, room: dict) -> dict:
    """``total`` dealt by ``weights`` in whole numbers, no more than ``room`` each; largest remainders, ties by key."""
    out = dict.fromkeys(room, 0)
    left = total
    while left > 0:
        open_ = [c for c in room if room[c] > out[c]]
        if not open_:
            break
        sum_ = sum(weights[c] for c in open_)
        exact = {c: left * weights[c] / sum_ if sum_ else left / len(open_) for c in open_}
        give = {c: min(int(exact[c]), room[c] - out[c]) for c in open_}
        if not any(give.values()):
            for c in sorted(open_, key=lambda c: (-(exact[c] % 1), c))[:left]:
                give[c] = 1
        for c, n in give.items():
            out[c] += n
            left -= n
    return out


def deal_level(total: int, weights: dict, minima: dict) -> dict:
    """``total`` dealt to the children of a node by ``weights`` in whole numbers, none below its minimum; largest remainders, ties by key.

    Children whose share is below their minimum get the minimum; the others share what is left. Minima that add up to more than ``total`` are all given.
    """
    fixed: dict = {}
    while True:
        open_ = [c for c in weights if c not in fixed]
        left = max(0, total - sum(fixed.values()))
        sum_ = sum(weights[c] for c in open_)
        exact = {c: left * weights[c] / sum_ if sum_ else left / len(open_) for c in open_}
        low = {c: minima[c] for c in open_ if exact[c] < minima[c]}
        if not low:
            break
        fixed |= low
    out = fixed | {c: int(x) for c, x in exact.items()}
    spare = max(0, total - sum(out.values()))
    for c in sorted(open_, key=lambda c: (-(exact[c] % 1), str(c)))[:spare]:
        out[c] += 1
    return out


def deal_down(cells: list[dict], total: int) -> dict[int, int]:
    """The quota of every cell: the root deals to strata, each of these to its units, each of these to its cells."""
    levels = (lambda c: c["stratum"], lambda c: c["unit"], lambda c: c["id"])

    def down(part: list[dict], amount: int, depth: int) -> dict[int, int]:
        if depth == len(levels):
            return {part[0]["id"]: amount}
        groups: dict = {}
        for c in part:
            groups.setdefault(levels[depth](c), []).append(c)
        given = deal_level(amount, {g: sum(c["bp"] for c in p) for g, p in groups.items()}, {g: sum(c["least"] for c in p) for g, p in groups.items()})
        return {i: n for g, p in groups.items() for i, n in down(p, given[g], depth + 1).items()}

    return down(cells, total, 0)


def allocate(cells: list[dict], available: dict[int, int]) -> dict[int, dict]:
    """Rows to draw from each cell. ``cells``: id, stratum, unit, bp, least, size. Whole numbers throughout.

    ``wanted`` is the quota that comes down the tree (``deal_down``). Gives per cell ``wanted``, ``own`` (drawn for itself), ``taken`` (for others) and ``unmet``.
    """
    if not cells:
        return {}
    size, weight = cells[0]["size"], {c["id"]: c["bp"] for c in cells}
    wanted = deal_down([c | {"least": min(c["least"], size)} for c in cells], size)
    drawn = {i: min(wanted[i], available.get(i, 0)) for i in weight}
    plan = {i: {"wanted": wanted[i], "own": drawn[i], "taken": 0, "unmet": wanted[i] - drawn[i]} for i in weight}
    near = [defaultdict(list) for _ in range(3)]
    for c in cells:
        for level, name in zip(near, ((c["stratum"], c["unit"]), c["stratum"], "")):
            level[name].append(c["id"])
    open_ = {i: p["unmet"] for i, p in plan.items()}
    for level in near:
        for _, ids in sorted(level.items(), key=lambda x: str(x[0])):
            missing = sum(open_[i] for i in ids)
            room = {i: available.get(i, 0) - plan[i]["own"] - plan[i]["taken"] for i in ids}
            got = _shares(min(missing, sum(room.values())), weight, room)
            for i, n in got.items():
                plan[i]["taken"] += n
            passed = sum(got.values())
            for i in ids:
                x = min(open_[i], passed)
                open_[i] -= x
                passed -= x
    return plan


def plan_sample(awards: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The eligible rows and the report: one row per cell with its target, what there is, what is drawn and what is missing.

    ``required`` is the greater of ``min_rows`` and the share of the sample rounded up; ``status`` is ``short`` if fewer
    rows are eligible. Null shares and minima count as 0. An empty target table gives an empty report and no sample.
    """
    spark = awards.sparkSession
    cells = targets.select("cell_id", label_key("candidate_stratum").alias("s"), label_key("nsforganization").alias("u"), F.coalesce("target_bp", F.lit(0)).alias("bp"), F.coalesce("min_rows", F.lit(0)).alias("least"), "sample_size")
    rows = cells.limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} target cells")
    if len({r["sample_size"] for r in rows}) > 1:
        raise ValueError("the cells name different sample sizes")
    fit = eligible(awards, targets)
    counts = {r["cell_id"]: r["count"] for r in fit.groupBy("cell_id").count().collect()}  # as many rows as cells
    plan = allocate([{"id": r["cell_id"], "stratum": r["s"], "unit": r["u"], "bp": r["bp"], "least": r["least"], "size": r["sample_size"] or 0} for r in rows], counts)
    table = [(i, p["wanted"], counts.get(i, 0), p["own"], p["taken"], p["own"] + p["taken"], p["unmet"]) for i, p in plan.items()]
    planned = spark.createDataFrame(table, "cell_id int, wanted bigint, available bigint, own bigint, taken_for_others bigint, drawn bigint, unmet bigint")
    required = F.greatest(F.coalesce("min_rows", F.lit(0)).cast("bigint"), F.expr("(coalesce(target_bp, 0) * coalesce(sample_size, 0) + 9999) div 10000"))
    report = targets.join(planned, "cell_id").withColumn("required", required)
    return fit, report.withColumn("status", F.when(F.col("available") < F.col("required"), "short").otherwise("met"))


def draw_sample(awards: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """``(cell_id, award_id, record_id, draw_rank)`` of the drawn rows: the first of each cell in a permuted order."""
    fit, report = plan_sample(awards, targets)
    ranked = bucketed_running(fit.withColumn("_h", permuted("award_id", seed=seed)), "cell_id", "_h", "award_id", name="draw_rank")
    return ranked.join(report.select("cell_id", "drawn"), "cell_id").where("draw_rank <= drawn").select("cell_id", "award_id", "record_id", "draw_rank")
