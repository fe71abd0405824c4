"""Prices, currencies, tenancy lengths and configuration names in one form. Column expressions, and steps over frames where one would repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import any_of, blank_to_null, strip

# Symbols with their currency codes, and weeks in a month by the two rules in use.
CURRENCIES = {"£": "GBP", "$": "USD", "€": "EUR"}
WEEKS_PER_MONTH_OF_DURATION = 4.345
WEEKS_PER_MONTH = 4.33
WEEKS_PER_TERM, WEEKS_PER_YEAR = 20, 52


def number(c: Column) -> Column:
    """The text as a finite number, or null."""
    d = F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
    return F.when(~F.isnan(d), d)


def currency_amount(amount: Column, unit: Column) -> Column:
    """Struct (value, currency, period) of a price with a leading symbol and a unit such as "per week".

    An amount that is no number keeps its currency only."""
    t = strip(amount)
    code, bare = F.lit(None).cast("string"), t
    for symbol, iso in CURRENCIES.items():
        code = F.when(t.startswith(symbol), F.lit(iso)).otherwise(code)
        bare = F.when(t.startswith(symbol), F.translate(t, symbol, "")).otherwise(bare)
    value = number(F.translate(bare, ",", ""))
    u = F.lower(strip(unit))
    period = F.when(any_of(u, ("week", "pw")), "PW").when(any_of(u, ("month", "pm")), "PM")
    return F.struct(value.alias("value"), code.alias("currency"), F.when(value.isNotNull(), period).alias("period"))


def _number_before(c: Column, words: str, pattern: str = r"([0-9]+)") -> Column:
    return F.nullif(F.regexp_extract(F.lower(c), pattern + r"\s*(" + words + ")", 1), F.lit(""))


def duration_months(c: Column) -> Column:
    """Months of "44 weeks" or "12 months"."""
    weeks = _number_before(c, "week|wks|wk", "([0-9]{1,3})").cast("int")
    months = _number_before(c, "month|mo", "([0-9]{1,3})").cast("int")
    return F.when(weeks.isNotNull(), F.bround(weeks / F.lit(WEEKS_PER_MONTH_OF_DURATION)).cast("int")).otherwise(months)


_REAL = r"([0-9]+(?:\.[0-9]+)?)"
WEEKS_TEXT, MONTHS_TEXT = _REAL + r"\s*(?:w|week|weeks)\b", _REAL + r"\s*(?:m|mo|month|months)\b"


def _weeks(s: Column, weeks: Column, months: Column) -> Column:
    """Weeks from a text in small letters and the numbers (as texts, empty where none) before its weeks and months."""
    n = F.coalesce(F.nullif(F.regexp_extract(s, "([0-9]+)", 1), F.lit("")).cast("int"), F.lit(1))
    return (
        F.when(weeks != "", F.bround(weeks.cast("double")).cast("int"))
        .when(months != "", F.bround(months.cast("double") * F.lit(WEEKS_PER_MONTH)).cast("int"))
        .when(any_of(s, ("semester", "term")), n * WEEKS_PER_TERM)
        .when(any_of(s, ("year", "yr")), n * WEEKS_PER_YEAR)
    )


def length_weeks(c: Column) -> Column:
    """Weeks of a tenancy length in weeks, months, semesters, terms or years."""
    s = F.lower(strip(c))
    return _weeks(s, F.regexp_extract(s, WEEKS_TEXT, 1), F.regexp_extract(s, MONTHS_TEXT, 1))


def with_length_weeks(df: DataFrame, text: str, name: str) -> DataFrame:
    """The same as a column, each of its patterns worked out once a row."""
    d = df.withColumn("__s", F.lower(strip(F.col(text)))).withColumn("__w", F.regexp_extract("__s", WEEKS_TEXT, 1))
    d = d.withColumn("__m", F.when(F.col("__w") == "", F.regexp_extract("__s", MONTHS_TEXT, 1)))
    return d.withColumn(name, _weeks(F.col("__s"), F.col("__w"), F.col("__m"))).drop("__s", "__w", "__m")


def parsed_price(c: Column) -> Column:
    """Struct (currency, amount): the first currency sign or code, as a code, and the first number."""
    s = strip(c)
    sign = F.upper(F.regexp_extract(F.upper(s), "([£$€]|AUD|NZD|USD|GBP|EUR)", 1))
    code = F.when(sign == "£", "GBP").when(sign == "$", "USD").when(sign == "€", "EUR").otherwise(sign)
    amount = F.regexp_extract(s, r"([0-9]{1,3}(?:[,\s][0-9]{3})+(?:\.[0-9]+)?|[0-9]+\.[0-9]+|[0-9]+)", 1)
    return F.struct(F.coalesce(code, F.lit("")).alias("currency"), number(F.regexp_replace(amount, r"[,\s]", "")).alias("amount"))


def price_type(given: Column, text: Column) -> Column:
    """per_week, per_month, total or empty: as given, else from the words of the price."""
    s = F.lower(F.coalesce(text, F.lit("")))
    told = F.when(any_of(s, ("per week", "/week", "pw", "weekly")), "per_week").when(any_of(s, ("per month", "/month", "pm", "monthly")), "per_month").when(any_of(s, ("total", "for")), "total").otherwise("")
    return F.coalesce(F.regexp_replace(F.lower(strip(blank_to_null(given))), r"\s+", "_"), told)


def weekly_and_total(amount: Column, kind: Column, weeks: Column) -> tuple[Column, Column]:
    """Price per week and for the whole tenancy, unrounded, where they can be told."""
    some = F.when(weeks > 0, weeks)
    weekly = F.when(kind == "per_month", amount / F.lit(WEEKS_PER_MONTH)).when(kind == "total", amount / some).otherwise(amount)
    total = F.when(kind == "per_week", amount * some).when(kind == "per_month", amount / F.lit(WEEKS_PER_MONTH) * some).when(kind == "total", amount)
    return weekly, total


def _part(c: Column) -> Column:
    s = F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), r"[^a-z0-9\s_/-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"/|\s+", "-"), "-+", "-"), "^-+|-+$", "")


def configuration_id(name: Column, unit: Column, low: Column, high: Column, dual: Column) -> Column:
    """A stable slug of name, unit type, area range and double occupancy."""
    figure = lambda c: F.nullif(F.regexp_extract(c.cast("string"), r"([0-9]+\.?[0-9]*)", 1), F.lit(""))
    a, z = figure(low), figure(high)
    area = F.when(a.isNotNull() & z.isNotNull() & (a != z), F.concat(a, F.lit("-"), z, F.lit("sqm"))).when(a.isNotNull(), F.concat(a, F.lit("sqm")))
    both = F.when(F.lower(dual.cast("string")).isin("yes", "true"), "dual")
    return F.substring(F.concat_ws("-", F.nullif(_part(F.coalesce(name, F.lit("config"))), F.lit("")), F.nullif(_part(unit), F.lit("")), area, both), 1, 120)


def duration_key(c: Column) -> Column:
    """"12m" for a text in months, else the text itself."""
    months = F.regexp_extract(F.lower(c), r"([0-9]+)\s*m", 1)
    return F.when(months != "", F.concat(months, F.lit("m"))).otherwise(F.lower(strip(c)))


def first_price(*fields: Column) -> Column:
    """The first filled price as a number, without currency signs."""
    return number(F.translate(F.coalesce(*(blank_to_null(f.cast("string")) for f in fields)), "£$€, ", ""))
