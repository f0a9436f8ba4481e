"""Column functions on strings: cleaning, ids, codes, labels. Every cleaner maps null to the empty string unless it says otherwise."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: An e-mail address as the cleaners recognise it. Fixed value.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

ColumnLike = Column | str


def as_col(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unwrap(x: ColumnLike) -> Column:
    """A spreadsheet value without its wrapper: ``="0555934"`` and ``='0555934'`` become ``0555934``."""
    # each argument stands once in these expressions, or nested cleaners would grow without bound
    return F.trim(F.regexp_replace(F.trim(F.coalesce(as_col(x).cast("string"), F.lit(""))), r"""(?s)^=(["'])(.*)\1$""", "$2"))


def squeeze(x: ColumnLike) -> Column:
    """Unwrapped, with every run of (Unicode) white space as one blank and none at the ends."""
    return F.trim(F.regexp_replace(unwrap(x), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def _nfkd_ascii(values: pd.Series) -> pd.Series:
    import unicodedata

    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())


def ascii_fold(x: ColumnLike) -> Column:
    """Compatibility-decomposed text without what is not ASCII. Pure ASCII never leaves the JVM."""
    s = F.coalesce(as_col(x).cast("string"), F.lit(""))
    other = s.rlike(r"[^\x00-\x7F]")
    return F.when(other, _nfkd_ascii(F.when(other, s))).otherwise(s)


def id_text(x: ColumnLike) -> Column:
    """The words of a value for use in an id: folded, lower case, single blanks between letters and digits."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(unwrap(x))), "[^a-z0-9]+", " "))


def stable_id(prefix: str, x: ColumnLike, digits: int = 12) -> Column:
    """``<prefix>_`` and the first hex digits of the SHA-1 of ``id_text``; blank values share the id of ``unknown``."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.regexp_replace(id_text(x), "^$", "unknown")), 1, digits))


def hash_bucket(key: ColumnLike, buckets: int = 100) -> Column:
    """The SHA-1 of ``key``, as one 160-bit number, modulo ``buckets``."""
    digest = F.sha1(F.coalesce(as_col(key).cast("string"), F.lit("")))
    digit = lambda i: F.conv(F.substring(digest, i, F.lit(1)), 16, 10).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.lit(0), lambda acc, i: (acc * 16 + digit(i)) % buckets)


def emails(x: ColumnLike) -> Column:
    """All addresses in a value, lower case, in order, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(unwrap(x), F.lit(f"({EMAIL})"), 1), lambda e: F.lower(e)))


def first_email(*values: ColumnLike) -> Column:
    """The first address of the first value that has one; empty if none has."""
    return F.coalesce(*[F.get(emails(v), F.lit(0)) for v in values], F.lit(""))


def strip_emails(x: ColumnLike) -> Column:
    return F.regexp_replace(unwrap(x), EMAIL, " ")


def clean_name(x: ColumnLike) -> Column:
    """A personal name without addresses, leading title, contact words and punctuation at its ends."""
    s = F.regexp_replace(squeeze(strip_emails(x)), r"(?i)^(dr|prof|professor)\.\s+", "")
    s = F.regexp_replace(s, r"(?i)\b(email|e-mail|mail|phone|tel)\b\s*[:=]?", " ")
    return F.btrim(F.regexp_replace(s, r"(?U)\s+", " "), F.lit(" ,;:()[]<>"))


def person_id(name: ColumnLike, email: ColumnLike) -> Column:
    """Id from the address if there is one, else from the cleaned name."""
    mail = F.get(emails(email), F.lit(0))
    return stable_id("person", F.coalesce(F.concat(F.lit("email:"), mail), F.concat(F.lit("name:"), clean_name(name))))


def name_tokens(x: ColumnLike) -> Column:
    """Number of runs of plain letters in a cleaned name."""
    return F.regexp_count(clean_name(x), F.lit("[A-Za-z]+"))


def codes(x: ColumnLike) -> Column:
    """Codes of a cell, split at commas, semicolons, bars, slashes and blanks: upper case, letters and digits, each once in order."""
    parts = F.transform(F.split(unwrap(x), r"[,;|/\s]+"), lambda p: F.upper(F.regexp_replace(p, "[^A-Za-z0-9]", "")))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def names_once(x: ColumnLike) -> Column:
    """Names split at semicolons and bars; of names that differ only in case, signs or spaces the first stays."""
    parts = F.filter(F.transform(F.split(squeeze(x), r"[;|]"), lambda p: F.trim(p)), lambda p: p != "")
    key = lambda p: F.trim(F.regexp_replace(F.lower(p), "[^a-z0-9]+", " "))
    pairs = F.transform(parts, lambda p: F.struct(key(p).alias("k"), p.alias("v")))
    kept = F.filter(pairs, lambda p, i: (p["k"] != "") & ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["k"] == p["k"]))
    return F.transform(kept, lambda p: p["v"])


def primary_program(code_cell: ColumnLike, name_cell: ColumnLike) -> tuple[Column, Column]:
    """The main program of a record and where it comes from: ``element:<first code>``, else ``name:<label of the name cell>``, else ``missing_program``."""
    first, name = F.get(codes(code_cell), F.lit(0)), F.nullif(label(name_cell), F.lit(""))
    key = F.coalesce(F.concat(F.lit("element:"), first), F.concat(F.lit("name:"), name), F.lit("missing_program"))
    source = F.when(first.isNotNull(), "ProgramElementCode").when(name.isNotNull(), "ProgramNameFallback").otherwise("MissingProgram")
    return key, source


def history_program(code_cell: ColumnLike, name_cell: ColumnLike) -> Column:
    """The main program as history features know it: ``element_<first code>``, else ``name_`` and the first 80 characters of the name's ``id_text``, else ``unknown_program``."""
    first, name = F.get(codes(code_cell), F.lit(0)), F.nullif(id_text(name_cell), F.lit(""))
    return F.coalesce(F.concat(F.lit("element_"), first), F.concat(F.lit("name_"), F.substring(name, 1, 80)), F.lit("unknown_program"))


def label(x: ColumnLike) -> Column:
    """A label in lower snake case: ``Mixed-Methods `` becomes ``mixed_methods``."""
    s = F.regexp_replace(F.lower(F.trim(F.coalesce(as_col(x).cast("string"), F.lit("")))), r"[^a-z0-9]+", "_")
    return F.btrim(s, F.lit("_"))


def search_text(x: ColumnLike) -> Column:
    """Lower case with all but plain letters and digits as single blanks, for phrase search."""
    return F.trim(F.regexp_replace(F.lower(squeeze(x)), "[^a-z0-9]+", " "))


def word_count(x: ColumnLike) -> Column:
    s = squeeze(x)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " ")))


def has_phrase(norm: ColumnLike, phrases: list[str]) -> Column:
    """Whether a search text holds one of ``phrases`` as whole words."""
    return F.concat(F.lit(" "), as_col(norm), F.lit(" ")).rlike(" (" + "|".join(map(re.escape, phrases)) + ") ")


def has_prefix(norm: ColumnLike, prefixes: list[str]) -> Column:
    """Whether a word of a search text begins with one of ``prefixes``."""
    return F.concat(F.lit(" "), as_col(norm)).rlike(" (" + "|".join(map(re.escape, prefixes)) + ")")


def lexicon_pattern(phrases: list[str], prefixes: list[str] = ()) -> str:
    """One pattern for whole phrases and word beginnings, for ``rlike`` on a search text; the same in Java and RE2."""
    parts = [re.escape(p).replace(r"\ ", " ") + r"\b" for p in phrases] + [re.escape(p) + r"[a-z0-9]*\b" for p in prefixes]
    return r"\b(" + "|".join(parts) + ")"


def text_cluster_id(title: ColumnLike, body: ColumnLike, fallback: ColumnLike) -> Column:
    """Id of a text by its words; records without any text get an id of their own from ``fallback``."""
    text = F.trim(F.concat_ws(" ", id_text(title), id_text(body)))
    return F.concat(F.lit("projtxt_"), F.substring(F.sha1(F.when(text == "", F.concat(F.lit("missing "), unwrap(fallback))).otherwise(text)), 1, 16))


def award_key(x: ColumnLike, mode: str = "strict") -> Column:
    """Award ids in one form.

    ``digits`` keeps the digits of the value; ``plain`` drops a trailing ``.0``; ``strict`` also reads ``1.9e6``. ``match`` is strict
    without leading zeros, for comparing ids from different files.
    """
    s = unwrap(x)
    if mode == "digits":
        return F.regexp_replace(s, "[^0-9]", "")
    plain = F.regexp_replace(s, r"\.0+$", "")
    if mode == "plain":
        return plain
    science = s.rlike(r"^[0-9]+(\.[0-9]+)?[eE]\+?[0-9]+$")
    strict = F.when(science, F.when(science, s).try_cast("double").cast("bigint").cast("string")).otherwise(F.regexp_replace(plain, "[^0-9A-Za-z]", ""))
    return strict if mode == "strict" else F.regexp_replace(strict, "^0+(?=.)", "")


def joined_text(title: ColumnLike, body: ColumnLike, mode: str = "title_abstract", sep: str = " [SEP] ", skip_blank: bool = False) -> Column:
    """Model input of title and body. ``mode``: title, abstract or title_abstract. Without ``skip_blank`` two blanks give the bare separator."""
    t, b = (F.trim(F.coalesce(as_col(c), F.lit(""))) for c in (title, body))
    if mode != "title_abstract":
        return t if mode == "title" else b
    if skip_blank:
        return F.concat_ws(sep, F.nullif(t, F.lit("")), F.nullif(b, F.lit("")))
    return F.concat(t, F.lit(sep), b)


def prefixed_text(x: ColumnLike, prefix: str = "query: ") -> Column:
    return F.concat(F.lit(prefix), F.coalesce(as_col(x), F.lit("")))


def column_name(name: str, prefix: str = "") -> str:
    """A safe column name: signs become single underscores."""
    return prefix + re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_")


def class_label(x: ColumnLike) -> Column:
    """A class value as text: ``1.0`` is ``1``, boolean words are ``1`` and ``0``, blanks are null."""
    s = F.lower(F.trim(as_col(x).cast("string")))
    number = s.try_cast("double")
    whole = F.when(number == F.floor(number), number.cast("bigint").cast("string"))
    return F.when(s.isin("", "nan", "none", "null"), None).when(s.isin("true", "yes"), "1").when(s.isin("false", "no"), "0").otherwise(F.coalesce(whole, s))


def split_value(x: ColumnLike) -> Column:
    """Split names in one form: ``val``, ``valid``, ``dev`` are validation, blank is unknown."""
    s = F.lower(F.regexp_replace(F.coalesce(as_col(x), F.lit("")), r"(?U)^\s+|\s+$", ""))
    return F.when(s.isin("val", "valid", "dev", "validation"), "validation").when(s == "", "unknown").otherwise(s)
