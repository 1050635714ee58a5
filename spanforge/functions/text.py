"""Team, colour and label text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Colour words recognised inside a colour description.
PRIMARY_COLORS = (
    "white", "black", "red", "blue", "green", "yellow",
    "orange", "purple", "pink", "gold", "silver", "grey", "gray",
    "navy", "maroon", "teal", "tan",
)

# Words that make a jersey read as light or dark.
LIGHT_WORDS = ("white", "light", "yellow", "gold", "silver", "cream")
DARK_WORDS = ("black", "dark", "navy", "red", "green", "blue", "maroon", "purple", "brown", "grey", "gray")


def _lits(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def color_tokens(c: Column) -> Column:
    """Primary colours contained in the text, as substrings."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.filter(_lits(PRIMARY_COLORS), lambda w: F.contains(low, w))


def colors_match(a: Column, b: Column) -> Column:
    """Shared colour word; failing any words, equal text ignoring case."""
    ta, tb = color_tokens(a), color_tokens(b)
    both = (F.size(ta) > 0) & (F.size(tb) > 0)
    same = F.lower(F.trim(a)) == F.lower(F.trim(b))
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), F.lit(False)).when(both, F.arrays_overlap(ta, tb)).otherwise(same)


def team_tokens(c: Column) -> Column:
    """Lower-case words without trailing punctuation, distinct."""
    words = F.split(F.trim(F.lower(c)), r"\s+")
    clean = F.transform(words, lambda w: F.regexp_replace(w, r"[.,;:!?]+$", ""))
    return F.array_distinct(F.filter(clean, lambda w: w != ""))


def teams_match(a: Column, b: Column) -> Column:
    """Equal, equal ignoring case, or one word set inside the other (2+ words)."""
    ca, cb = F.trim(a), F.trim(b)
    ta, tb = team_tokens(ca), team_tokens(cb)
    subset = (F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0)
    return (
        F.when(a.isNull() | b.isNull() | (ca == "") | (cb == ""), F.lit(False))
        .when(F.lower(ca) == F.lower(cb), F.lit(True))
        .when((F.size(ta) < 2) | (F.size(tb) < 2), F.lit(False))
        .otherwise(subset)
    )


def is_light(c: Column) -> Column:
    """At least as many light as dark words."""
    low = F.lower(c)
    count = lambda words: F.size(F.filter(_lits(words), lambda w: F.contains(low, w)))
    return count(LIGHT_WORDS) >= count(DARK_WORDS)


def order_colors(a: Column, b: Column) -> tuple[Column, Column]:
    """Lighter colour first, otherwise alphabetical."""
    la, lb = is_light(a), is_light(b)
    first = F.when(la & ~lb, a).when(lb & ~la, b).otherwise(F.least(a, b))
    second = F.when(la & ~lb, b).when(lb & ~la, a).otherwise(F.greatest(a, b))
    return first, second


def clip_id(vid: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("_", vid.cast("string"), start.cast("int").cast("string"), end.cast("int").cast("string"))


def clip_parts(c: Column) -> tuple[Column, Column, Column]:
    """Recording, start and end of a clip id; the recording may hold ``_``."""
    pat = r"^(.*)_(\d+)_(\d+)$"
    return (
        F.nullif(F.regexp_extract(c, pat, 1), F.lit("")),
        F.regexp_extract(c, pat, 2).try_cast("int"),
        F.regexp_extract(c, pat, 3).try_cast("int"),
    )


def belongs_to(clip: Column, vid: Column) -> Column:
    """Clip id equals the recording or starts with ``vid_``."""
    return (clip == vid) | F.startswith(clip, F.concat(vid, F.lit("_")))


def bare_id(c: Column, prefix: str = "") -> Column:
    """Strip a prefix and a ``.json`` suffix."""
    c = F.regexp_replace(F.trim(c), r"\.json$", "")
    return F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c) if prefix else c


def is_safe_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_.\-]+$"), F.lit(False))


def split_uri(c: Column) -> tuple[Column, Column]:
    """Bucket and key of an object URI; null when it is none."""
    pat = r"^gs://([^/]+)/(.+)$"
    return F.nullif(F.regexp_extract(c, pat, 1), F.lit("")), F.nullif(F.regexp_extract(c, pat, 2), F.lit(""))
