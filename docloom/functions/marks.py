"""Tests and small rewrites of texts that readers and writers share, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import length_mm

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def has_scheme(url: Column) -> Column:
    return url.rlike(SCHEME)


def autolink_class(text: Column, url: Column) -> Column:
    """`uri` for a link whose text is its URL, `email` for one whose text is its mail address, else null."""
    return F.when(url == text, "uri").when(url == F.concat(F.lit("mailto:"), text), "email")


def opens_with_metadata(text: Column) -> Column:
    """Whether a text starts with a line `---` that a line with content follows."""
    return text.rlike(r"^---[ \t]*\r?\n[ \t]*[^\s]")


def task_state(text: Column) -> Column:
    """true for a checked box, false for an open one, null for an item that is no task."""
    first = F.substring(text, 1, 1)
    return F.when(first == "☒", True).when(first == "☐", False)


def percent(part: Column) -> Column:
    """A share as whole or decimal percent, without trailing zeros."""
    shown = F.format_string("%.4f", F.round(part * 100, 4))
    return F.concat(F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", ""), F.lit("%"))


def twips(c: Column) -> Column:
    """Twentieths of a point of a length with a unit."""
    return F.round(length_mm(c) / 25.4 * 1440).cast("long")


def emu(c: Column) -> Column:
    """English metric units, 914,400 an inch, of a length with a unit."""
    return F.round(length_mm(c) / 25.4 * 914400).cast("long")


def media_name(data: Column, extension: Column) -> Column:
    """A name by content: SHA-1 of the bytes and an extension."""
    return F.concat(F.sha1(data), F.lit("."), extension)


def metadata_pair(c: Column) -> Column:
    """(key, value) of `key=value` or `key:value`; a bare key is `true`."""
    key = F.regexp_extract(c, "^([^=:]*)", 1)
    rest = F.substring(c, F.length(key) + 2, F.length(c))
    return F.struct(key.alias("key"), F.when(F.length(c) > F.length(key), rest).otherwise(F.lit("true")).alias("value"))


def tabs_expanded(line: Column, stop: int = 4) -> Column:
    """One line with its tabs filled to the next multiple of stop columns, as a fold over its parts."""
    parts = F.split(line, "\t")
    pad = lambda s: F.repeat(F.lit(" "), stop - F.length(s) % stop)
    joined = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.lit(""), lambda out, p: F.concat(out, p, pad(F.concat(out, p))))
    return F.concat(joined, F.element_at(parts, -1))


def lines_prepared(text: Column, stop: int = 4) -> Column:
    """Text as a line reader takes it: no carriage returns, tabs filled line by line, a line end at the end unless it is empty."""
    lines = F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")
    whole = F.array_join(F.transform(lines, lambda x: tabs_expanded(x, stop)), "\n")
    return F.when((whole == "") | whole.endswith("\n"), whole).otherwise(F.concat(whole, F.lit("\n")))


def leading_newlines_doubled(html: Column) -> Column:
    """HTML whose preformatted elements keep a line end at their start: a reader drops one."""
    return F.regexp_replace(html, r"(?i)(<(?:pre|textarea|listing)(?:\s[^>]*)?>)\n", "$1\n\n")


def resolved_path(base: Column, target: Column) -> Column:
    """The part that a relative target names, seen from the part base: `..` and `.` resolved, percent signs decoded; a
    target from / on counts from the root. `..` beyond the root stays there."""
    folder = F.when(target.startswith("/"), F.lit("")).otherwise(F.regexp_replace(base, "[^/]*$", ""))
    steps = F.split(F.concat(folder, F.replace(F.url_decode(F.replace(target, F.lit("+"), F.lit("%2B"))), F.lit("\\"), F.lit("/"))), "/")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda out, x: F.when((x == "") | (x == "."), out).when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))))
    return F.array_join(kept, "/")


def multiset_intersection(a: Column, b: Column) -> Column:
    """Elements of a, in order, each as often at most as b holds it. Quadratic in the arrays: for the few modifiers of a run."""
    return F.filter(a, lambda x, i: _seen(a, x, i) <= F.size(F.filter(b, lambda y: y == x)))


def multiset_difference(a: Column, b: Column) -> Column:
    """Elements of a, in order, beyond those that b holds."""
    return F.filter(a, lambda x, i: _seen(a, x, i) > F.size(F.filter(b, lambda y: y == x)))


def _seen(a: Column, x: Column, i: Column) -> Column:
    return F.size(F.filter(F.slice(a, F.lit(1), i + 1), lambda y: y == x))
