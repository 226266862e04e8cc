"""Column expressions shared by the operators (all built-in, JVM-side)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import CURRENCY_SYMBOL


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c) -> Column:
    return col(c).cast("double")


def pct_of(num, den, digits: int = 2) -> Column:
    """``num / den * 100`` rounded; 0 when the denominator is not positive."""
    n, d = as_double(num), as_double(den)
    return F.when(d > 0, F.round(n / d * 100.0, digits)).otherwise(F.lit(0.0))


def currency(c) -> Column:
    """``₹1,234.50`` style text (two decimals, thousands separators)."""
    return F.concat(F.lit(CURRENCY_SYMBOL), F.format_number(as_double(c), 2))


def thousands(c) -> Column:
    return F.format_number(col(c).cast("bigint"), 0)


def strip_ws(c) -> Column:
    """Strip leading and trailing whitespace of any kind (not only spaces)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


# A plain number: digits with an optional sign, fraction and exponent, or an infinity. The
# engine's own cast also takes suffixes of numeric literals (``1d``, ``2F``), which in a
# table are codes.
NUMBER_SHAPE = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def number_or_nan(c) -> Column:
    """Number from text of a number's shape; NaN stays, other text gives null."""
    text = col(c).cast("string")
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))


def parse_number(c) -> Column:
    """Number from text; unparseable text and NaN give null (never an error)."""
    x = number_or_nan(c)
    return F.when(~F.isnan(x), x)


def whole_number(c) -> Column:
    """Number truncated to int; null where it does not fit."""
    return col(c).try_cast("int")


# (shape, format): a text is only handed to the format whose shape it has,
# so rows do not pay for failed parse attempts. The shapes are those of the
# date part, with hyphens between words read as blanks; a time of day may follow
# it (see ``parse_timestamp``).
DATE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{4}-\d{1,2}$", "yyyy-M"),
    (r"^[A-Za-z]{3} \d{1,2},? \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2},? \d{4}$", "MMMM d yyyy"),
    (r"^\d{1,2}[ -][A-Za-z]{3}[ -]\d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}[ -][A-Za-z]{4,}[ -]\d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2}[ -][A-Za-z]{3}[ -]\d{2}$", "d MMM yy"),
    (r"^[A-Za-z]{3}[ -]\d{4}$", "MMM yyyy"),
    (r"^[A-Za-z]{4,}[ -]\d{4}$", "MMMM yyyy"),
]
# Dates of three numbers, by separator: whether the day comes first unless the column
# shows otherwise.
NUMERIC_DATES = {"slash": ("/", False), "dash": ("-", True), "dot": (".", True)}
LAST_OF_CENTURY = 68   # two-digit years up to this one are 20xx, later ones 19xx
TIME_OF_DAY = r"[ T](\d{1,2}):(\d{2})(?::(\d{2})(\.\d+)?)?\s*([AaPp]\.?[Mm]\.?)?(Z|[+-]\d{2}:?\d{2})?$"


NUMERIC_SHAPE = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})"


def date_orders(c) -> Column:
    """Aggregate: for each separator, whether a column's ``a/b/year`` dates are day/month.
    They are if some first number exceeds 12 and no second one does, they are not in the
    opposite case, and the separator's custom holds where neither shows."""
    text = F.trim(col(c).cast("string"))
    part = lambda i: F.regexp_extract(text, NUMERIC_SHAPE + r"(?:[ T].*)?$", i)
    out = []
    for name, (separator, custom) in NUMERIC_DATES.items():
        most = lambda i: F.coalesce(F.max(F.when(part(2) == separator, part(i).cast("int"))), F.lit(0))  # noqa: E731,B023
        first, second = most(1), most(3)
        out.append(F.when((first > 12) & (second <= 12), True).when((first <= 12) & (second > 12), False)
                   .otherwise(custom).alias(name))
    return F.struct(*out)


def _recent(d: Column) -> Column:
    """A date parsed from a two-digit year (read as 20xx) in its century."""
    return F.when(F.year(d) > 2000 + LAST_OF_CENTURY, F.add_months(d, -1200).cast("timestamp")).otherwise(d)


def _numeric_date(day: Column, day_first: Column | None) -> Column:
    part = lambda i: F.regexp_extract(day, NUMERIC_SHAPE + "$", i)
    first = F.lit(False)
    for name, (separator, custom) in NUMERIC_DATES.items():
        own = F.lit(custom) if day_first is None else F.coalesce(day_first[name], F.lit(custom))
        first = F.when(part(2) == separator, own).otherwise(first)
    one, two, year = (part(i).cast("int") for i in (1, 3, 4))
    year = F.when(F.length(part(4)) == 4, year).when(year <= LAST_OF_CENTURY, year + 2000).otherwise(year + 1900)
    return F.try_make_timestamp(year, F.when(first, two).otherwise(one), F.when(first, one).otherwise(two),
                                F.lit(0), F.lit(0), F.lit(0))


def parse_timestamp(c, formats=DATE_FORMATS, day_first: Column | None = None) -> Column:
    """Text -> timestamp: the date part by the format its shape selects, plus
    a time of day (12 or 24 hours, minutes, seconds, fraction, and an offset that is
    taken off) if one follows. ``day_first`` is what :func:`date_orders` found for the
    column; without it, every separator has its custom. A month without a day is its
    first day. Text of no known shape, or an impossible date, gives null."""
    text = F.trim(col(c).cast("string"))
    day = F.regexp_replace(text, TIME_OF_DAY, "")
    plain = F.regexp_replace(F.regexp_replace(day, ",", ""), r"(?<=[A-Za-z])-|-(?=[A-Za-z])", " ")
    out = F.when(day.rlike(NUMERIC_SHAPE + "$"), _numeric_date(day, day_first))
    for shape, fmt in formats:
        value = F.try_to_timestamp(plain, F.lit(fmt))
        out = out.when(day.rlike(shape), _recent(value) if fmt.endswith(" yy") else value)
    part = lambda i: F.coalesce(F.regexp_extract(text, TIME_OF_DAY, i).try_cast("double"), F.lit(0.0))
    half = F.lower(F.substring(F.regexp_extract(text, TIME_OF_DAY, 5), 1, 1))
    hour = F.when(half == "", part(1)).otherwise(part(1) % 12 + F.when(half == "p", 12).otherwise(0))
    zone = F.regexp_replace(F.regexp_extract(text, TIME_OF_DAY, 6), ":", "")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = F.when(F.length(zone) == 5, sign * (F.substring(zone, 2, 2).cast("int") * 60
                                                 + F.substring(zone, 4, 2).cast("int"))).otherwise(0)
    valid = ((part(1) < 24) & (part(2) < 60) & (part(3) < 60)
             & ((half == "") | ((part(1) >= 1) & (part(1) <= 12))))
    seconds = (hour * 60 + part(2) - offset) * 60 + part(3) + part(4)
    timed = F.timestamp_micros(F.unix_micros(out) + (seconds * 1e6).cast("bigint"))
    return F.when(~text.rlike(TIME_OF_DAY), out).when(valid, timed)


def ci_equals(c, value: str, null_as: str = "") -> Column:
    """Case-insensitive equality with a default for nulls."""
    return F.lower(F.coalesce(col(c).cast("string"), F.lit(null_as))) == F.lit(value.lower())


def all_of(conds) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def output_frame(df: DataFrame) -> DataFrame:
    """Result shape for comparison and export: decimals become doubles,
    dates ``yyyy-MM-dd`` text, timestamps ``yyyy-MM-dd HH:mm:ss`` text and
    small integers bigint."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt = f.dataType
        if isinstance(dt, T.DecimalType):
            c = c.cast("double")
        elif isinstance(dt, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(dt, T.FloatType):
            c = c.cast("double")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def exact_mean(total, n, digits: int) -> Column:
    """``total / n`` rounded half-up to ``digits`` decimals, computed in
    integers: ``total`` (an exact decimal sum) is scaled to whole units,
    then divided with integer division. Gives the same double in every
    engine, unlike rounding a binary average."""
    units = (col(total) * F.lit(10 ** digits)).cast("decimal(38,0)").cast("bigint")
    two_n = col(n).cast("bigint") * 2
    return _idiv(units * 2 + col(n).cast("bigint"), two_n).cast("double") / float(10 ** digits)


def _idiv(a: Column, b: Column) -> Column:
    """Integer division of two bigint Columns (floor for non-negative values)."""
    return F.when(b != 0, (a - F.pmod(a, b)) / b).cast("bigint")
