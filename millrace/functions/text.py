"""Scalar text functions as Column expressions; only the table of character references is Python's."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if t is not None else t)


_ENDED = re.compile(r"&#?\w+;")


@F.pandas_udf(StringType())
def _unescape_ended(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _ENDED.sub(lambda m: html.unescape(m[0]), t) if t is not None else t)


def unescape(c: Column, ended: bool = False) -> Column:
    """All named and numbered character references, by the standard's table; only texts that hold an ampersand leave the JVM.

    With `ended`, only those that end in a semicolon: in a text that was cut off behind "&amp" it stays.
    """
    return F.coalesce((_unescape_ended if ended else _unescape)(F.when(c.contains("&"), c)), c)


#: White space as text splitting knows it, beyond ASCII too.
_BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# Parts of license addresses in the order in which they are tried, and the codes they stand for.
LICENSE_PATTERNS = (
    ("publicdomain/zero", "cc0"),
    ("licenses/by-nc-sa/", "cc-by-nc-sa"),
    ("licenses/by-nc/", "cc-by-nc"),
    ("licenses/by-sa/", "cc-by-sa"),
    ("licenses/by/", "cc-by"),
)
PUBLIC_DOMAIN_MARK = "https://creativecommons.org/publicdomain/mark/1.0/"


def blank_to_empty(c: Column) -> Column:
    """The empty string is the null of all tables that come from CSV."""
    return F.coalesce(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def clean_html(c: Column, ended: bool = False) -> Column:
    """Tags become spaces, character references (with `ended`, those with a semicolon) are decoded, white space collapses; null is empty."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "), ended), _BLANKS, " "))


def normalize_url(c: Column) -> Column:
    """https instead of http, lower-case host, no query; path and fragment stay."""
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    fragment = F.regexp_extract(c, r"(#.*)$", 1)
    whole = F.concat(F.when(scheme == "http", F.lit("https")).otherwise(scheme), F.lit("://"), host, path, fragment)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).when(scheme == "", c).otherwise(whole)


def license_code(c: Column) -> Column:
    """First pattern that the address holds; otherwise empty."""
    low = F.lower(c)
    out = None
    for part, code in LICENSE_PATTERNS:
        out = F.when(low.contains(part), F.lit(code)) if out is None else out.when(low.contains(part), F.lit(code))
    return out.otherwise(F.lit(""))


def canonical_license_url(name: Column, url: Column) -> Column:
    """The given address; for the name "public domain" without one, the public-domain mark's."""
    given = F.coalesce(url, F.lit(""))
    return F.when(given != "", given).when(F.lower(name) == "public domain", F.lit(PUBLIC_DOMAIN_MARK)).otherwise(F.lit(""))


def normalize_name(c: Column, separators: str = "_-") -> Column:
    """Trimmed, lower case, spaces as underscores, without a leading number and one of the separators."""
    return F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_")), rf"^\d+[{separators}]", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def split_pair(c: Column, by: str = "=") -> tuple[Column, Column]:
    """NAME=PATH at the first separator; the second is null without one."""
    parts = F.split(c, by, 2)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))


def trailing_number(c: Column) -> Column:
    """The number after the last underscore of a stem, or null."""
    return F.regexp_extract(c, r"_(\d+)$", 1).try_cast("bigint")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def parent_id(stem: Column) -> Column:
    """What stands before the first double dash."""
    return F.substring_index(stem, "--", 1)


def safe_member_path(c: Column) -> Column:
    """Relative, without parent steps, drive letters or backslashes."""
    return F.coalesce(~c.rlike(r"(^|/)\.\.(/|$)") & ~c.rlike(r"^[/\\]") & ~c.rlike(r"^[A-Za-z]:") & ~c.contains("\\") & (c != ""), F.lit(False))


def join_list(c: Column, by: str = "|") -> Column:
    return F.array_join(c, by)


def split_list(c: Column, by: str = r"\|") -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, by))


def path_of(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def try_positive_int(c: Column) -> Column:
    """The value of a text that is a positive integer, else null."""
    n = F.trim(c).try_cast("bigint")
    return F.when(n > 0, n)


def try_unit_float(c: Column) -> Column:
    """The value of a text that is a finite number in [0, 1], else null."""
    x = F.trim(c).try_cast("double")
    return F.when(~F.isnan(x) & x.between(0.0, 1.0), x)


def iso_of_nanos(ns: Column, zone: str = "UTC") -> Column:
    """ISO seconds with the zone's offset of a nanosecond epoch, whatever the session's zone is; fractions are dropped."""
    seconds = (ns - F.pmod(ns, F.lit(1_000_000_000))) / F.lit(1_000_000_000)  # a whole number, exact as a double
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    minutes = F.timestamp_diff("MINUTE", utc, local)
    offset = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60)
    return F.concat(F.replace(local.cast("string"), F.lit(" "), F.lit("T")), offset)


def json_path(c: Column, path: str, default: str = "") -> Column:
    """Navigation into a JSON text; what is missing or broken gives the default."""
    return F.coalesce(F.get_json_object(c, path), F.lit(default))
