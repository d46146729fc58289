"""Scalar column expressions.

All of them are built-in Catalyst expressions, so they stay inside
whole-stage codegen; none needs a Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.formats import (  # noqa: F401  (re-exported)
    DATE_FMT, ELLIPSIS, FENCE_CLOSE, FENCE_OPEN, LONG_DATE_FMT, MESSAGE_CAP, MESSAGE_CAP_MARKER, MIDDLE_MARKER, REASONING, SNIPPET_WIDTH, STAR,
    TRIM_CHARS, WIDE_CHARACTERS)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def php_trim(c) -> Column:
    """Trim the full whitespace set (Spark's trim only strips spaces)."""
    return F.btrim(col_(c), F.lit(TRIM_CHARS))


def fmt_time(epoch_seconds, pattern: str = DATE_FMT) -> Column:
    """Format float epoch seconds, truncated to whole seconds, in session TZ."""
    return F.date_format(F.timestamp_seconds(col_(epoch_seconds).cast("bigint")), pattern)


def num_text(c) -> Column:
    """Render a double the way the reference prints floats (1.0 -> "1")."""
    return F.regexp_replace(col_(c).cast("string"), r"\.0$", "")


def snippet(c, width: int = SNIPPET_WIDTH) -> Column:
    """cut to ``width`` display columns, ellipsis included; East Asian
    wide characters take two columns."""
    c = col_(c)
    # A character takes a column at least, so the first width + 1 decide whether the text is cut.
    seen = F.substring(c, 1, width + 1)
    columns = F.length(seen) + F.regexp_count(seen, F.lit(WIDE_CHARACTERS))
    # The longest prefix within width - 1 columns: it has at most as many characters.
    fold = F.aggregate(
        F.split(F.substring(c, 1, width - 1), ""), F.struct(F.lit(0).alias("used"), F.lit("").alias("kept")),
        lambda s, x: F.when(s["used"] + 1 + F.rlike(x, F.lit(WIDE_CHARACTERS)).cast("int") <= width - 1,
                            F.struct((s["used"] + 1 + F.rlike(x, F.lit(WIDE_CHARACTERS)).cast("int")).alias("used"), F.concat(s["kept"], x).alias("kept")))
        .otherwise(F.struct(F.lit(width).alias("used"), s["kept"].alias("kept"))),
        lambda s: s["kept"])
    narrow = F.length(seen) == columns
    cut = F.when(narrow, F.substring(c, 1, width - 1)).otherwise(fold)
    return F.when(columns > width, F.concat(cut, F.lit(ELLIPSIS))).otherwise(c)


def safe_name(title, fallback) -> Column:
    """File-name-safe title: keep word chars, whitespace and '-', then
    whitespace runs become '_', cut to 80 characters; empty -> fallback."""
    kept = F.regexp_replace(col_(title), r"(?U)[^\w\s\-]", "")
    collapsed = F.regexp_replace(php_trim(kept), r"\s+", "_")
    cut = F.substring(collapsed, 1, 80)
    return F.coalesce(F.nullif(cut, F.lit("")), col_(fallback).cast("string"))


def stars(score) -> Column:
    """round(5 * score) stars."""
    return F.repeat(F.lit(STAR), F.round(col_(score) * 5).cast("int"))


def clamp01(c, default: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col_(c).cast("double"), F.lit(default))))


def round_half_up(c, dp: int = 0) -> Column:
    """Spark's round() on doubles is HALF_UP on the decimal text, as PHP's."""
    return F.round(col_(c), dp)


def comma_list(arr) -> Column:
    return F.array_join(col_(arr), ", ")


def range_bounds(key) -> tuple[Column, Column]:
    """Split a range key "s-e" into integer bounds."""
    parts = F.split(col_(key), "-", 2)
    return parts.getItem(0).cast("int"), parts.getItem(1).cast("int")


def range_label(key) -> Column:
    """ "s-e" (0-based) -> "s+1–e+1" for display."""
    s, e = range_bounds(key)
    return F.concat((s + 1).cast("string"), F.lit("–"), (e + 1).cast("string"))


def strip_boilerplate(c) -> Column:
    """Remove code fences and reasoning blocks, then trim."""
    r = F.regexp_replace(col_(c), FENCE_OPEN, "")
    r = F.regexp_replace(r, FENCE_CLOSE, "")
    r = F.regexp_replace(r, REASONING, "")
    return php_trim(r)


def cap_text(c, n: int = MESSAGE_CAP, marker: str = MESSAGE_CAP_MARKER) -> Column:
    c = col_(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(marker))).otherwise(c)
