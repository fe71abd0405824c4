"""Text expressions with the reference rules for white space, slugs and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def key(c: Column) -> Column:
    """Lower case without surrounding white space: how names are compared."""
    return F.lower(strip(c))


def slug(c: Column) -> Column:
    """Lower case, every other sign run as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def safe_name(c: Column, most: int = 50) -> Column:
    """A key or file name: letters, digits and underscores only."""
    return F.substring(F.regexp_replace(c, r"[^a-zA-Z0-9_]", "_"), 1, most)


def sanitize(c: Column, most: int) -> Column:
    """White space runs as one space, without <>"', cut to ``most`` signs."""
    text = F.translate(strip(F.regexp_replace(c, r"\s+", " ")), "<>\"'", "")
    return F.coalesce(F.when(F.length(text) > most, strip(F.substring(text, 1, most))).otherwise(text), F.lit(""))


def features_of(c: Column) -> Column:
    """Names in a text that commas, semicolons or line ends set apart."""
    return F.filter(F.transform(F.split(c, r"[,;\n]"), strip), lambda x: x != "")


def title_case(c: Column) -> Column:
    """Capital first letter of every run of letters."""
    words = F.split(F.regexp_replace(F.lower(c), r"([a-z]+)", "\u0001$1"), "\u0001")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000000))), "")


def any_of(c: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words occurs."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def percent(c: Column, digits: int) -> Column:
    """Rounded half up on the value as it is: floor(x * 10^digits + 0.5) / 10^digits."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale
