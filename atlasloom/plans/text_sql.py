"""Pieces of SQL that the text oracles share."""

from __future__ import annotations

from ..functions import text as t


def q(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


def fold_sql(c: str) -> str:
    return f"translate(lower(coalesce({c}, '')), {q(t.MARKED)}, {q(t.PLAIN)})"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, {q(f'^{t.SPACE}+|{t.SPACE}+$')}, '', 'g')"


def collapse_sql(c: str) -> str:
    return strip_sql(f"regexp_replace({c}, {q(t.SPACE + '+')}, ' ', 'g')")


def all_sql(c: str, pattern: str) -> str:
    return f"coalesce(regexp_extract_all({c}, {q(pattern)}, 0), [])"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def strip_admin_sql(c: str) -> str:
    return f"regexp_replace({collapse_sql(c)}, {q('^(?:' + '|'.join(t.ADMIN_PREFIXES) + ')')}, '')"


def slug_sql(c: str) -> str:
    source, target, several = t._slug_tables()
    out = f"regexp_replace(coalesce({c}, ''), '\\p{{Mn}}', '', 'g')"
    for letter, plain in several:
        out = f"replace({out}, {q(letter)}, {q(plain)})"
    out = f"trim(regexp_replace(lower(translate({out}, {q(source)}, {q(target)})), '[^a-z0-9]+', '_', 'g'), '_')"
    return f"CASE WHEN {out} = '' THEN 'unknown' ELSE {out} END"


def F1_SQL(a: str, b: str) -> str:  # noqa: N802
    shared = f"list_sum(list_transform(list_distinct({a}), lambda k: least(len(list_filter({a}, lambda x: x = k)), len(list_filter({b}, lambda x: x = k)))))"
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN 2.0::DOUBLE * coalesce({shared}, 0) / (len({a}) + len({b})) ELSE 0.0::DOUBLE END"


def upper_sql(c: str) -> str:
    return f"(upper({c}) = {c} AND lower({c}) <> {c})"
