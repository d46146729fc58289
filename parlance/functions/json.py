"""Model-response parsing (F13, F14, F18) as JVM-side expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.formats import FENCE_BLOCK
from parlance.functions.text import col_, php_trim


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def extract_json(c) -> Column:
    """First balanced JSON object in the text, string- and escape-aware.

    A fold over the characters from the first '{' tracks depth, whether we
    are inside a string, and a pending escape. Returns NULL when there is no
    '{' or the object never closes (the reference raises in both cases;
    callers turn NULL into an error row).
    """
    cleaned = F.regexp_replace(col_(c), FENCE_BLOCK, "$1")
    start = F.instr(cleaned, "{")
    rest = F.when(start > 0, cleaned.substr(start, F.length(cleaned) - start + 1))
    # Re-join the same pieces, so code points and token lengths never matter.
    return let(tokens(rest), lambda pieces: let(_object_end(pieces), lambda end: F.when(end > 0, F.array_join(F.slice(pieces, 1, end), ""))))


def _state(d, q, e, n, end) -> Column:
    return F.struct(d.alias("d"), q.alias("q"), e.alias("e"), n.alias("n"), end.alias("end"))


def _step(a: Column, ch: Column) -> Column:
    n1 = a["n"] + 1
    zero = F.lit(0)
    f, t = F.lit(False), F.lit(True)
    return (
        F.when(a["end"] > 0, a)
        .when(a["e"], _state(a["d"], a["q"], f, n1, zero))
        .when(a["q"] & (ch == "\\"), _state(a["d"], t, t, n1, zero))
        .when(ch == '"', _state(a["d"], ~a["q"], f, n1, zero))
        .when(a["q"], _state(a["d"], t, f, n1, zero))
        .when(ch == "{", _state(a["d"] + 1, f, f, n1, zero))
        .when(ch == "}", _state(a["d"] - 1, f, f, n1, F.when(a["d"] - 1 == 0, n1).otherwise(zero)))
        .otherwise(_state(a["d"], a["q"], f, n1, zero))
    )


def parse_object(c) -> Column:
    """Variant of the extracted object, NULL when it is not valid JSON."""
    return F.try_parse_json(col_(c))


def vget(v, path: str, type_: str) -> Column:
    return F.try_variant_get(col_(v), path, type_)


def is_int(v, path: str) -> Column:
    """True when the JSON value at ``path`` is an integer (not "2", not 2.0)."""
    return F.coalesce(F.schema_of_variant(F.variant_get(col_(v), path, "variant")).isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit(False))


# Structural characters are single tokens; everything between them is one
# run token. A run never changes the scanner state (an escape only needs to
# be cleared, whatever the escaped character is), so folding over tokens is
# the character scan with about ten times fewer steps.
TOKEN = r'[{}"\\]|[^{}"\\]+'


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), 0)


def _object_end(chars: Column) -> Column:
    """Length (in split units) of the balanced object starting at chars[0]; 0 if it never closes."""
    folded = F.aggregate(
        chars,
        F.struct(F.lit(0).alias("d"), F.lit(False).alias("q"), F.lit(False).alias("e"),
                 F.lit(0).alias("n"), F.lit(0).alias("end")),
        _step,
    )
    return folded["end"]


def response_text(raw) -> Column:
    """Normalise a raw service body.

    A body that is one JSON object or array must carry ``response``;
    otherwise every non-blank line is decoded and the ``response`` fields
    are concatenated. Result is trimmed; NULL marks a body that cannot be
    used (the caller records it as an error row).

    Spark's JSON parser accepts trailing content after the first value, so
    "the whole body is one object" is checked by a balanced scan ending at
    the last character."""
    raw = col_(raw)

    def is_whole(body):
        return body.startswith("{") & let(tokens(body), lambda t: _object_end(t) == F.size(t))

    def whole(body, parsed):
        is_object = is_whole(body) & parsed.isNotNull()
        is_array = body.startswith("[") & body.endswith("]") & parsed.isNotNull()
        return F.struct(is_object.alias("obj"), is_array.alias("arr"),
                        F.try_variant_get(parsed, "$.response", "string").alias("text"))

    # bind the trimmed body and its parse once (lambda), used by every check
    w = let(php_trim(raw), lambda b: let(F.try_parse_json(b), lambda parsed: whole(b, parsed)))
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda ln: php_trim(ln)), lambda ln: ln != "")
    parts = F.transform(lines, lambda ln: F.when(is_whole(ln), F.try_variant_get(F.try_parse_json(ln), "$.response", "string")))
    combined = F.nullif(F.array_join(parts, ""), F.lit(""))
    return php_trim(let(w, lambda x: F.when(x["obj"], x["text"]).when(x["arr"], F.lit(None).cast("string")).otherwise(combined)))
