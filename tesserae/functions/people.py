"""Splitting cells that name several people into records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import EMAIL, ColumnLike, clean_name, first_email, name_tokens, person_id, squeeze, unwrap


def _comma_parts(segment: Column) -> Column:
    """A segment cut at its commas if they seem to stand between people, not inside one name ("Smith, John")."""
    parts = F.filter(F.transform(F.split(segment, ","), lambda p: F.trim(p)), lambda p: p != "")
    later = F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))
    several = F.exists(later, lambda p: name_tokens(p) >= 2)
    long_list = (F.size(parts) >= 3) & (name_tokens(F.get(parts, F.lit(0))) >= 2)
    return F.when(several | long_list, parts).otherwise(F.array(segment))


def _address_parts(segment: Column) -> Column:
    """A segment with several addresses cut after each of them."""
    cut = F.split(F.regexp_replace(segment, f"({EMAIL})", "$1\u0001"), "\u0001")
    clean = F.filter(F.transform(cut, lambda p: F.btrim(p, F.lit(" ,;"))), lambda p: p != "")
    return F.when(F.regexp_count(segment, F.lit(EMAIL)) >= 2, clean).otherwise(F.array(segment))


def literal_people(x: ColumnLike) -> Column:
    """Records ``(person_id, name, email)`` of a cell that holds a list literal: dictionaries with these keys (``[{'person_id': 'p1', 'name': "A. O'Hara"}]``) or plain names.

    Missing keys are empty; a plain name gets an id of its own. Null, blank and malformed cells and other values give no records.
    """
    text = F.regexp_replace(unwrap(x), r"(:\s*)None(\s*[,}])", "$1null$2")
    options = {"allowBackslashEscapingAnyCharacter": "true"}
    items = F.from_json(F.when(text.rlike(r"(?s)^\[.*\]$"), text), "array<string>", options)
    keys = F.transform(items, lambda i: F.when(i.startswith("{"), F.from_json(i, "person_id string, name string, email string", options)))
    own = lambda i: F.concat(F.lit("person_"), F.substring(F.sha1(F.trim(F.regexp_replace(F.lower(i), "[^a-z0-9]+", " "))), 1, 12))
    blank = lambda c: F.coalesce(c, F.lit(""))
    record = lambda i, k: F.struct(F.when(k.isNull(), own(i)).otherwise(blank(k["person_id"])).alias("person_id"), F.when(k.isNull(), i).otherwise(blank(k["name"])).alias("name"), blank(k["email"]).alias("email"))
    known = F.filter(F.zip_with(items, keys, record), lambda r: (r["name"] != "") | (r["email"] != "") | (r["person_id"] != ""))
    return F.coalesce(known, F.array().cast("array<struct<person_id:string,name:string,email:string>>"))


def person_parts(x: ColumnLike, strict_and: bool = True) -> Column:
    """The cell cut at line ends, semicolons, bars, slashes, "and", addresses and commas between people.

    With ``strict_and`` the word "and" only separates between two or more blanks on either side, as in exports of tables.
    A list literal (``['A B', 'C D']``, or of dictionaries, see ``literal_people``) is read as its items.
    """
    s = unwrap(x)
    items = F.array_join(F.transform(literal_people(x), lambda r: F.concat_ws(" ", r["name"], r["email"])), ";")
    s = F.when(s.rlike(r"(?s)^\[.*\]$"), items).otherwise(s)
    s = F.regexp_replace(s, r"\r\n|\r|\n|\s*[|/]\s*", ";")
    s = F.regexp_replace(s, r"(?i)\s{2,}and\s{2,}" if strict_and else r"(?i)\s+and\s+", ";")
    pieces = F.filter(F.transform(F.split(squeeze(s), ";"), lambda p: F.trim(p)), lambda p: p != "")
    pieces = F.flatten(F.transform(pieces, _address_parts))
    return F.flatten(F.transform(pieces, _comma_parts))


def person_records(parts: ColumnLike) -> Column:
    """Records ``(person_id, name, email)`` of cell parts, each id once in order; parts without name and address are left out.

    ``parts`` is a column made by ``person_parts``. The ids need folding in Python, which Spark runs outside of lambdas, so the usual way is to explode the
    parts first (``operators.edges.people``); this one is for parts of plain ASCII.
    """
    records = F.transform(parts, lambda p: F.struct(_ascii_person_id(p).alias("person_id"), clean_name(p).alias("name"), first_email(p).alias("email")))
    records = F.filter(records, lambda r: (r["name"] != "") | (r["email"] != ""))
    return F.filter(records, lambda r, i: ~F.exists(F.slice(records, F.lit(1), i), lambda q: q["person_id"] == r["person_id"]))


def _ascii_person_id(part: Column) -> Column:
    mail, name = first_email(part), clean_name(part)
    text = F.trim(F.regexp_replace(F.lower(F.when(mail != "", F.concat(F.lit("email:"), mail)).otherwise(F.concat(F.lit("name:"), name))), "[^a-z0-9]+", " "))
    return F.concat(F.lit("person_"), F.substring(F.sha1(text), 1, 12))


def person_names(parts: ColumnLike) -> Column:
    """The cleaned names of cell parts."""
    return F.filter(F.transform(parts, clean_name), lambda n: n != "")


__all__ = ["literal_people", "person_id", "person_names", "person_parts", "person_records"]
