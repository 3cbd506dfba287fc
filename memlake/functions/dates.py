"""Date rules: extraction from text, reference times, ages."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from memlake.functions import rules
from memlake.functions.text import ascii_bounds, matches

_ISO_PARTS = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T\s](\d{1,2}):(\d{2}):(\d{2}))?$"


MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}


def month_number(text: Column) -> Column:
    """1..12 from the first letters of the month name a date text holds."""
    name = F.lower(F.regexp_extract(text, rf"(?i)({rules.MONTH_NAMES})", 1))
    numbers = F.create_map(*[F.lit(x) for m, n in MONTHS.items() for x in (m, n)])
    return F.try_element_at(numbers, F.left(name, F.lit(3)))


def _int(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")), F.lit("0")).cast("int")


def _midnight(y: Column, m: Column, d: Column) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(y, m, d, zero, zero, zero.cast("decimal(16,6)"))


def _iso(m: Column) -> Column:
    return F.try_make_timestamp_ntz(
        *[_int(m, _ISO_PARTS, g) for g in range(1, 6)], _int(m, _ISO_PARTS, 6).cast("decimal(16,6)")
    )


def _month_day_year(m: Column) -> Column:
    return _midnight(_int(m, r"(\d{4})$"), month_number(m), _int(m, r"(\d{1,2})(?:st|nd|rd|th)?[,\s]+\d{4}$"))


def _day_month_year(m: Column) -> Column:
    return _midnight(_int(m, r"(\d{4})$"), month_number(m), _int(m, r"^(\d{1,2})"))


def _month_year(m: Column) -> Column:
    return _midnight(_int(m, r"(\d{4})$"), month_number(m), F.lit(1))


def _marked_year(m: Column) -> Column:
    y = _int(m, r"(\d{4})")
    return F.when(y.between(1970, 2100), _midnight(y, F.lit(1), F.lit(1)))


def _bounded(shape: str) -> str:
    return "(?i)" * shape.startswith("(?i)") + rf"\b(?:{shape.removeprefix('(?i)')})\b"


SHAPES = [
    (_bounded(rules.ISO_DATE), _iso, "exact"),
    (_bounded(rules.MONTH_DAY_YEAR), _month_day_year, "exact"),
    (_bounded(rules.DAY_MONTH_YEAR), _day_month_year, "exact"),
    (_bounded(rules.MONTH_YEAR), _month_year, "month"),
    (rules.MARKED_YEAR, _marked_year, "year"),
]


def _first_of_shape(text: Column, pattern: str, build, precision: str) -> Column:
    """First match that is a calendar date and no validity boundary, as (at, precision)."""
    start = F.struct(F.lit(1).alias("pos"), F.lit(None).cast("timestamp_ntz").alias("hit"))

    def step(acc: Column, m: Column) -> Column:
        at = F.position(m, text, acc["pos"])
        look = rules.VALIDITY_LOOKBACK
        before = F.substring(text, F.greatest(at - look, F.lit(1)), F.least(at - 1, F.lit(look)))
        made = F.when(~matches(before, rules.VALIDITY_BOUNDARY), build(m))
        return F.struct((at + F.length(m)).alias("pos"), F.coalesce(acc["hit"], made).alias("hit"))

    def finish(acc: Column) -> Column:
        return F.when(acc["hit"].isNotNull(), F.struct(acc["hit"].alias("at"), F.lit(precision).alias("precision")))

    return F.aggregate(F.regexp_extract_all(text, F.lit(ascii_bounds(pattern)), F.lit(0)), start, step, finish)


def extract_date(text: Column) -> Column:
    """Struct (at, precision) of the first reliable date, shapes tried in order; null if none."""
    return F.coalesce(*[_first_of_shape(text, *shape) for shape in SHAPES])


def parse_partial(text: Column) -> Column:
    """Timestamp of ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` text, null when impossible."""
    parts = r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$"
    y, m, d = (F.regexp_extract(text, parts, g) for g in (1, 2, 3))
    made = _midnight(
        y.try_cast("int"), F.coalesce(m.try_cast("int"), F.lit(1)), F.coalesce(d.try_cast("int"), F.lit(1))
    )
    return F.when(text.rlike(parts), made)


def partial_precision(text: Column) -> Column:
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day")
        .when(text.rlike(r"^\d{4}-\d{2}$"), "month")
        .when(text.rlike(r"^\d{4}$"), "year")
        .otherwise("none")
    )


def reference_time(observed: Column, event_date: Column, precision: Column, basis: Column, as_of: Column) -> Column:
    """Struct (at, rule): stated dates are normalised, everything else keeps its message time."""
    text, kind, prec = F.trim(event_date), F.lower(F.coalesce(basis, F.lit(""))), F.lower(F.coalesce(precision, F.lit("")))
    range_start = F.nullif(
        F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})\s*(?:to|–|-)\s*\d{4}-\d{2}-\d{2}$", 1), F.lit("")
    )
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    month = F.when(text.rlike(r"^\d{4}-\d{2}$") | ((prec == "month") & text.rlike(r"^\d{4}-\d{2}")), F.left(text, F.lit(7)))
    year = F.when(text.rlike(r"^\d{4}$") | ((prec == "year") & text.rlike(r"^\d{4}")), F.left(text, F.lit(4)))

    def pair(at: Column, rule: str) -> Column:
        return F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(rule).alias("rule")))

    stated = F.coalesce(
        pair(parse_partial(range_start), "normalized_range_start_date_utc"),
        pair(parse_partial(day), "normalized_day_midnight_utc"),
        pair(parse_partial(month), "normalized_month_first_day_utc"),
        pair(parse_partial(year), "normalized_year_first_day_utc"),
    )
    by_message = F.coalesce(pair(observed, "exact_observed_at"), pair(as_of, "fallback_now"))
    fallback = F.struct(F.coalesce(observed, as_of).alias("at"), F.lit("fallback_observed_at").alias("rule"))
    return F.when(kind == "message_time", by_message).otherwise(
        F.coalesce(F.when(kind.isin("explicit", "calibrated"), stated), fallback)
    )


def describe_age(created: Column, updated: Column, as_of: Column, upper_bound: Column | None = None) -> Column:
    """``created D | updated D (n days ago)``; null when neither date is known."""
    bound = F.when(upper_bound, " (on or before)").otherwise("") if upper_bound is not None else F.lit("")
    days = F.greatest(F.floor(F.timestamp_diff("SECOND", updated, as_of) / 86400), F.lit(0)).cast("int")
    ago = F.when(days == 0, "today").when(days == 1, "1 day ago").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    line = F.concat_ws(
        " | ",
        F.when(created.isNotNull(), F.concat(F.lit("created "), F.to_date(created).cast("string"), bound)),
        F.when(updated.isNotNull(), F.concat(F.lit("updated "), F.to_date(updated).cast("string"), F.lit(" ("), ago, F.lit(")"))),
    )
    return F.nullif(line, F.lit(""))
