"""Text signals: lexicon flags, the proximity rule, the stratum ladder and the rule classifier."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import lexicons as lex
from tesserae.functions.text import ColumnLike, as_col, has_phrase, lexicon_pattern

#: The nine flags read from the text, as (phrases, word beginnings).
FLAGS = {
    "explicit_mmr_candidate": (lex.EXPLICIT, []),
    "qual_signal_candidate": (lex.QUAL, lex.QUAL_STARTS),
    "quant_signal_candidate": (lex.QUANT, lex.QUANT_STARTS),
    "implicit_mmr_phrase_candidate": (lex.IMPLICIT, []),
    "design_label_candidate": (lex.DESIGN, []),
    "integration_term_candidate": (lex.INTEGRATION, lex.INTEGRATION_STARTS),
    "integration_direct_strong_candidate": (lex.DIRECT_STRONG, []),
    "method_heavy_candidate": (lex.METHOD_HEAVY, lex.METHOD_HEAVY_STARTS),
}


def _any_start(words: Column, starts: list[str]) -> Column:
    return F.exists(words, lambda w: w.rlike("^(" + "|".join(map(re.escape, starts)) + ")"))


def _any_word(words: Column, of: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in of]))


def near_integration(norm: ColumnLike, window: int = lex.WINDOW) -> Column:
    """Whether an integration verb stands within ``window`` words of evidence of both kinds of methods, or a direct phrase occurs.

    Around a verb count: a qualitative and a quantitative word with a context word; for strong verbs also a local mixed-methods phrase with
    a context word, or both kinds of words without a generic teaching word. The words around are cut out only where a verb stands.
    """
    norm = as_col(norm)
    words = F.split(norm, " ")
    verb = "^(" + "|".join(lex.STRONG_VERBS + lex.WEAK_VERBS) + ")"
    spots = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda s: s["w"].rlike(verb))

    def holds(spot: Column) -> Column:
        begin = F.greatest(spot["i"] - window, F.lit(0))
        around = F.slice(words, begin + 1, spot["i"] + window + 1 - begin)
        strong = spot["w"].rlike("^(" + "|".join(lex.STRONG_VERBS) + ")")
        both = _any_start(around, lex.NEAR_QUAL) & _any_start(around, lex.NEAR_QUANT)
        context = _any_word(around, lex.NEAR_CONTEXT)
        local = has_phrase(F.array_join(around, " "), lex.NEAR_MMR)
        return (both & context) | (strong & local & context) | (strong & both & ~_any_word(around, lex.NEAR_GENERIC))

    return F.coalesce(has_phrase(norm, lex.DIRECT_STRONG) | F.exists(spots, holds), F.lit(False))


def add_signals(df: DataFrame, norm: str) -> DataFrame:
    """``df`` with the 0/1 flags of the search text ``norm``, the flags derived from them and ``candidate_stratum``. Null text has no signal."""
    text = F.coalesce(F.col(norm), F.lit(""))
    df = df.withColumns({name: text.rlike(lexicon_pattern(*lists)).cast("int") for name, lists in FLAGS.items()} | {"integration_strict_local_candidate": near_integration(text).cast("int")})
    on = lambda name: F.col(name) == 1
    steps: list[tuple[str, Column]] = [
        ("implicit_mmr_candidate", (on("qual_signal_candidate") & on("quant_signal_candidate")) | on("implicit_mmr_phrase_candidate")),
        ("integration_candidate", on("integration_strict_local_candidate") & (on("explicit_mmr_candidate") | on("implicit_mmr_candidate") | on("integration_direct_strong_candidate"))),
        ("design_integration_candidate", on("design_label_candidate") | on("integration_candidate")),
        ("any_mmr_like_candidate", on("explicit_mmr_candidate") | on("implicit_mmr_candidate") | on("design_integration_candidate")),
        ("qual_only_hard_negative_candidate", on("qual_signal_candidate") & ~on("quant_signal_candidate") & ~on("any_mmr_like_candidate")),
        ("quant_only_hard_negative_candidate", on("quant_signal_candidate") & ~on("qual_signal_candidate") & ~on("any_mmr_like_candidate")),
        ("method_heavy_background_candidate", on("method_heavy_candidate") & ~on("any_mmr_like_candidate") & ~on("qual_only_hard_negative_candidate") & ~on("quant_only_hard_negative_candidate")),
        ("hard_negative_candidate", on("qual_only_hard_negative_candidate") | on("quant_only_hard_negative_candidate") | on("method_heavy_background_candidate")),
        ("random_background_candidate", ~on("any_mmr_like_candidate") & ~on("hard_negative_candidate")),
    ]
    for name, rule in steps:
        df = df.withColumn(name, rule.cast("int"))
    return df.withColumn("candidate_stratum", ladder([(on("design_integration_candidate"), "design_integration_enriched"), (on("explicit_mmr_candidate"), "explicit_mmr"), (on("implicit_mmr_candidate"), "implicit_mmr"), (on("qual_only_hard_negative_candidate"), "qual_only_hard_negative"), (on("quant_only_hard_negative_candidate"), "quant_only_hard_negative"), (on("method_heavy_background_candidate"), "method_heavy_background"), (on("random_background_candidate"), "random_background")], "other_background"))


def ladder(rules: list[tuple[Column, str]], default: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(default)
    for rule, name in reversed(rules):
        out = F.when(rule, name).otherwise(out)
    return out


def _rule(text: Column, name: str, unicode: bool) -> Column:
    return text.rlike(("(?iU)" if unicode else "(?i)") + lex.RULES[name])


def rule_class(text: ColumnLike, known: list[str] | None = None, unicode: bool = True) -> Column:
    """The class of a raw text by six patterns, first match wins; a class outside of ``known`` becomes the first of ``known``."""
    t = F.coalesce(as_col(text), F.lit(""))
    hit = lambda name: _rule(t, name, unicode)
    out = ladder([(hit("explicit"), "explicit_mmr"), (hit("qual") & hit("quant"), "implicit_mmr"), (hit("qual"), "qual_only"), (hit("quant"), "quant_only"), (hit("method"), "multi_method_not_mmr")], "no_method_signal")
    return F.when(out.isin(known), out).otherwise(known[0]) if known else out


def rule_binary(text: ColumnLike, target: str, unicode: bool = True) -> Column:
    """0/1 by the patterns that the name of ``target`` asks for."""
    t = F.coalesce(as_col(text), F.lit(""))
    hit = lambda name: _rule(t, name, unicode)
    both = hit("qual") & hit("quant")
    by_name = {"integration": hit("integration"), "design": hit("design"), "qual": hit("qual"), "quant": hit("quant"), "explicit": hit("explicit"), "implicit": both & ~hit("explicit"), "method_signal": hit("method") | hit("qual") | hit("quant") | hit("explicit")}
    return next((rule for word, rule in by_name.items() if word in target), hit("explicit") | both).cast("int")


def label_targets(df: DataFrame) -> DataFrame:
    """Numeric targets of the label columns: yes/no/unclear as 1/0/null, set membership, ordinal completeness and a combined stratum key."""
    yes_no = lambda c: F.when(F.col(c) == "yes", 1).when(F.col(c) == "no", 0)
    order = F.create_map(*[F.lit(x) for kv in lex.REPORTING_ORDER.items() for x in kv])
    cls = F.col("label_mmr_class")
    out = df.withColumns({
        "target_mmr": F.when(cls != "unclear", cls.isin(lex.MMR_POSITIVE).cast("int")), "target_method_signal": F.when(cls != "unclear", cls.isin(lex.METHOD_SIGNAL).cast("int")),
        "target_qual": yes_no("label_qual_signal"), "target_quant": yes_no("label_quant_signal"), "target_design": yes_no("label_design_present"), "target_integration": yes_no("label_integration_present"),
        "target_reporting": F.try_element_at(order, F.col("label_reporting_completeness")),
    })
    part = lambda name: F.coalesce(F.col(name), F.lit(-1)).cast("string")
    return out.withColumn("stratify_key", F.concat(F.coalesce(cls, F.lit("unknown")), F.lit("|design="), part("target_design"), F.lit("|integration="), part("target_integration")))
