"""Pieces of DuckDB SQL that say the same as the column functions."""

from __future__ import annotations

#: What Unicode counts as white space; RE2's ``\s`` is ASCII only. Fixed value.
SPACE = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def unwrap(x: str) -> str:
    s = f"trim(coalesce({x}, ''))"
    return f"""trim(case when length({s}) >= 3 and regexp_matches({s}, '(?s)^=(".*"|''.*'')$') then regexp_replace(regexp_replace({s}, '^=["'']', ''), '["'']$', '') else {s} end)"""


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({unwrap(x)}, '{SPACE}', ' ', 'g'))"


def fold(x: str) -> str:
    """Equal to compatibility decomposition on texts whose only compatibility characters are blanks and the ellipsis."""
    return f"regexp_replace(strip_accents(replace(regexp_replace(coalesce({x}, ''), '{SPACE}', ' ', 'g'), '…', '...')), '[^\\x00-\\x7F]', '', 'g')"


def id_text(x: str) -> str:
    return f"trim(regexp_replace(lower({fold(unwrap(x))}), '[^a-z0-9]+', ' ', 'g'))"


def stable_id(prefix: str, x: str, digits: int = 12) -> str:
    return f"'{prefix}_' || left(sha1(case when {id_text(x)} = '' then 'unknown' else {id_text(x)} end), {digits})"


def clean_name(x: str) -> str:
    s = f"regexp_replace({squeeze(f'regexp_replace({unwrap(x)}, ' + chr(39) + EMAIL + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, '(?i)^(dr|prof|professor)\\.\\s+', '')"
    s = f"regexp_replace({s}, '(?i)\\b(email|e-mail|mail|phone|tel)\\b\\s*[:=]?', ' ', 'g')"
    return f"trim(regexp_replace({s}, '{SPACE}', ' ', 'g'), ' ,;:()[]<>')"


def first_email(x: str) -> str:
    return f"lower(regexp_extract({unwrap(x)}, '{EMAIL}'))"


def person_id(name: str, email: str) -> str:
    key = f"case when {first_email(email)} <> '' then 'email:' || {first_email(email)} else 'name:' || {clean_name(name)} end"
    return stable_id("person", f"({key})")


def search_text(x: str) -> str:
    return f"trim(regexp_replace(lower({squeeze(x)}), '[^a-z0-9]+', ' ', 'g'))"


def label(x: str) -> str:
    return f"trim(regexp_replace(lower(trim(coalesce({x}, ''))), '[^a-z0-9]+', '_', 'g'), '_')"


def codes(x: str) -> str:
    """Codes of a cell in order, each once."""
    parts = f"list_filter(list_transform(regexp_split_to_array({unwrap(x)}, '[,;|/\\s]+'), lambda p: upper(regexp_replace(p, '[^A-Za-z0-9]', '', 'g'))), lambda p: p <> '')"
    return f"list_filter({parts}, lambda p, i: list_position({parts}, p) = i)"


def bucket(x: str, n: int = 100) -> str:
    h = f"sha1(coalesce(cast({x} as varchar), ''))"
    return f"list_reduce(list_transform(range(1, 41), lambda i: (strpos('0123456789abcdef', substr({h}, i, 1)) - 1)::int), lambda a, d: (a * 16 + d) % {n}, 0)"


def split_of(bucket_sql: str) -> str:
    return f"case when {bucket_sql} < 70 then 'train' when {bucket_sql} < 85 then 'validation' else 'test' end"
