"""Label, score and JSON clean-up as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Canonical labels per field and the words for "not applicable".
LABELS = {
    "depth": ("Aggressive (A)", "Base (B)", "Conservative (C)", "Defensive (D)"),
    "quality": ("Excellent", "Good", "Average", "Poor"),
    "rebound": (
        "Killed (Elite)", "Steered to Low-Danger Zone", "Uncontrolled into High-Danger Zone", "Goal Allowed", "Not Applicable",
    ),
}
NOT_APPLICABLE = ("n/a", "na", "not applicable", "none", "no shot")

# Phrases that give away a made-up goal description.
GENERIC_PHRASES = (
    "a goal is counted",
    "to maintain the identity",
    "to satisfy the rubric",
    "the truth table",
    "appears to be a goal",
    "likely a goal",
    "i believe",
)


def aliases(kind: str) -> dict[str, str]:
    """Accepted spelling (lower case) to canonical label.

    A label is accepted in full, without its parenthesised code, and as the
    code alone.
    """
    out: dict[str, str] = {}
    for label in LABELS[kind]:
        name, _, code = label.partition(" (")
        out.update({label.lower(): label, name.lower(): label})
        if code:
            out[code.rstrip(")").lower()] = label
    if kind == "rebound":
        out.update(dict.fromkeys(NOT_APPLICABLE, "Not Applicable"))
    return out


def normalize_enum(c: Column, kind: str) -> Column:
    """Canonical label for an accepted spelling, else null."""
    pairs = [F.lit(x) for kv in aliases(kind).items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(c)))


def rescue_enum(c: Column, kind: str) -> Column:
    """Label of the earliest accepted spelling inside prose, else null.

    Whole words only, single letters ignored.  One pattern lists the longest
    spellings first, so the leftmost match is also the longest starting there.
    """
    known = aliases(kind)
    words = sorted((a for a in known if len(a) >= 2), key=len, reverse=True)
    pattern = r"(?U)\b(" + "|".join(re.escape(a) for a in words) + r")\b"
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    hit = F.regexp_extract(F.lower(c), pattern, 1)
    return F.when(F.length(c) >= 3, F.try_element_at(F.create_map(*pairs), hit))


def clean_enum(c: Column, kind: str) -> Column:
    return F.coalesce(normalize_enum(c, kind), rescue_enum(c, kind))


def normalize_conf(raw: Column) -> Column:
    """Confidence text to 1-5 from a 1-5, 1-10 or percentage scale.

    Booleans, text and values outside 1-100 give null; decimals are cut.
    """
    num = F.when(raw.rlike(r"^\s*-?\d+(\.\d+)?\s*$"), F.trim(raw).try_cast("double")).try_cast("int")
    return (
        F.when((num >= 1) & (num <= 5), num)
        .when((num >= 6) & (num <= 10), F.floor((num + 1) / 2).cast("int"))
        .when((num >= 11) & (num <= 100), F.least(F.greatest(F.floor((num + 10) / 20).cast("int"), F.lit(1)), F.lit(5)))
    )


def is_generic(c: Column) -> Column:
    """Stock phrase or fewer than five words."""
    low = F.lower(c)
    words = F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    return low.rlike("|".join(GENERIC_PHRASES)) | (words < 5)


# -- JSON text ---------------------------------------------------------------


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _balanced_end(text: Column) -> Column:
    """Length up to the first ``}`` that closes every open brace, else null.

    Walks the pieces between closing braces, not single characters.
    """
    opens = lambda p: F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit("")))
    steps = lambda pieces: F.transform(
        F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct((opens(p) - 1).alias("up"), (F.length(p) + 1).alias("n")),
    )
    state = F.aggregate(
        _let(F.split(text, r"\}", -1), steps),
        F.expr("named_struct('depth', 0, 'at', 0, 'end', cast(null as int))"),
        lambda a, p: F.struct(
            (a["depth"] + p["up"]).cast("int").alias("depth"),
            (a["at"] + p["n"]).cast("int").alias("at"),
            F.coalesce(a["end"], F.when(a["depth"] + p["up"] == 0, a["at"] + p["n"])).cast("int").alias("end"),
        ),
    )
    return state["end"]


def _is_object(text: Column) -> Column:
    """Strictly one JSON object and nothing after it."""
    bare = F.regexp_replace(F.trim(text), r'"(?:[^"\\]|\\.)*+"', '""')
    closed = _let(bare, lambda b: F.startswith(b, F.lit("{")) & (_balanced_end(b) == F.length(b)))
    return F.coalesce(closed & F.try_parse_json(text).isNotNull(), F.lit(False))


def recover_json(raw: Column) -> Column:
    """The text itself when it is a JSON object, else its first balanced part.

    Braces inside strings count, so some truncated texts stay lost (null).
    """
    cut = F.substring(raw, F.lit(1), _balanced_end(raw))
    return F.when(_is_object(raw), raw).otherwise(_let(cut, lambda c: F.when(_is_object(c), c)))


# Texts reported when a summary cannot be read.
SUMMARY_FAILED = "Summary generation failed: response could not be parsed."
RATING_MISSING = "N/A"


# The two fields of a summary reply.
SUMMARY_FIELD, RATING_FIELD = "coaches_summary", "coaches_overall_rating"


def parse_summary(raw: Column) -> tuple[Column, Column]:
    """Summary text and rating from a clean, wrapped, truncated or broken reply.

    Between the outermost braces stands an object, or the text is repaired: an object
    of its text fields alone is put together, the summary closed where the reply ends
    inside it (any other field cut off there is left out).  Either is read in one step;
    where an escape is cut in two, the texts are taken as they stand.
    """
    t = F.coalesce(raw, F.lit(""))
    inner = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    whole = _is_object(inner)
    is_field = lambda x, name: F.startswith(x, F.lit(f'"{name}"'))
    # a text field without its closing quote
    fields = F.regexp_extract_all(t, F.lit(r'"\w+"\s*:\s*"(?:[^"\\]|\\.)*+'), F.lit(0))
    fields = F.filter(fields, lambda x: is_field(x, SUMMARY_FIELD) | (is_field(x, RATING_FIELD) & ~F.endswith(t, x)))
    repaired = F.concat(F.lit("{"), F.array_join(F.transform(fields, lambda x: F.concat(x, F.lit('"'))), ","), F.lit("}"))
    doc = F.from_json(F.when(whole, inner).otherwise(repaired), f"{SUMMARY_FIELD} string, {RATING_FIELD} string")
    as_is = lambda name: F.regexp_replace(F.get(F.filter(fields, lambda x: is_field(x, name)), F.lit(0)), r'^"\w+"\s*:\s*"', "")
    summary = F.coalesce(doc[SUMMARY_FIELD], F.when(whole, F.lit("")), as_is(SUMMARY_FIELD), F.lit(SUMMARY_FAILED))
    found = whole | F.exists(fields, lambda x: is_field(x, SUMMARY_FIELD))
    rate = F.when(found, F.coalesce(doc[RATING_FIELD], F.when(~whole, as_is(RATING_FIELD))))
    return summary, F.coalesce(F.when(whole, rate).otherwise(F.nullif(rate, F.lit(""))), F.lit(RATING_MISSING))
