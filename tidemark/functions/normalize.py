"""Canonical forms of instants, handles, paths and keys, as JVM-side column expressions and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by the Unicode property, spelled out so that Java and RE2 agree.
SPACE_JAVA = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE_RE2 = SPACE_JAVA
#: Marks without a glyph: zero width space, word joiner, byte order mark, soft hyphen.
INVISIBLE = r"\x{200b}\x{2060}\x{feff}\x{ad}"
SECONDS_BELOW = 100_000_000_000


def trim_unicode(c: Column) -> Column:
    """``c`` without outer white space of any kind; null stays null."""
    return F.regexp_replace(c, f"^[{SPACE_JAVA}]+|[{SPACE_JAVA}]+$", "")


def instant_ms(c: Column) -> Column:
    """Epoch milliseconds; 0 and null are unknown (null), small values are seconds."""
    return F.when(c.isNull() | (c == 0), None).when(c < SECONDS_BELOW, c * 1000).otherwise(c).cast("long")


def handle_key(c: Column) -> Column:
    """Handle in lower case without outer white space and a leading @; null where nothing is left."""
    key = F.regexp_replace(F.lower(trim_unicode(c)), "^@", "")
    return F.when(key != "", key)


def text_key(c: Column) -> Column:
    """Key text in lower case without outer white space; null where nothing is left."""
    key = F.lower(trim_unicode(c))
    return F.when(key != "", key)


def path_key(c: Column) -> Column:
    """Path with single forward slashes and without a leading ``./``; letter case kept; blank is null."""
    p = F.regexp_replace(F.regexp_replace(trim_unicode(c), r"\\", "/"), "/+", "/")
    p = F.regexp_replace(p, r"^(\./)+", "")
    return F.when(p != "", p)


def id_key(c: Column) -> Column:
    """Numeric key as a long; 0 is no reference."""
    return F.when(c != 0, c.cast("long"))


def visible(c: Column) -> Column:
    """Whether the text has any character besides white space and invisible marks; null is not visible."""
    return F.coalesce(F.regexp_replace(c, f"[{SPACE_JAVA}{INVISIBLE}]+", "") != "", F.lit(False))


def day_number(ms: Column) -> Column:
    """Days since 1970-01-01 UTC of an instant in milliseconds."""
    return F.floor(ms / F.lit(86_400_000)).cast("int")


def month_of(ms: Column) -> Column:
    """``yyyy-MM`` (UTC) of an instant in milliseconds, ``unknown`` for null."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), day_number(ms))
    return F.coalesce(F.date_format(day, "yyyy-MM"), F.lit("unknown"))


def js_round(c: Column) -> Column:
    """Rounding half up towards positive infinity."""
    return F.floor(c + 0.5)


# The same rules as DuckDB text, for oracles.


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{SPACE_RE2}]+|[{SPACE_RE2}]+$', '', 'g')"


def sql_instant(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL OR {c} = 0 THEN NULL WHEN {c} < {SECONDS_BELOW} THEN {c} * 1000 ELSE {c} END)"


def sql_handle(c: str) -> str:
    return f"nullif(regexp_replace(lower({sql_trim(c)}), '^@', ''), '')"


def sql_text_key(c: str) -> str:
    return f"nullif(lower({sql_trim(c)}), '')"


def sql_path(c: str) -> str:
    t = f"regexp_replace(replace({sql_trim(c)}, '\\', '/'), '/+', '/', 'g')"
    return f"nullif(regexp_replace({t}, '^(\\./)+', ''), '')"


def sql_month(c: str) -> str:
    return f"coalesce(strftime(make_timestamp(({c}) * 1000), '%Y-%m'), 'unknown')"
