"""Which date formats a text may be written in, in a form that aggregates can intersect.

A text such as ``04/05/2023`` may put the month or the day first, ``31/05/2023``
only the day. Every value has a shape (which separators, digits and names stand
where) and the set of orders its numbers allow, as bits. A column is written in
one format if all values have one shape, and the bitwise AND of their sets,
taken in the same scan as everything else, is not empty. Month-first wins if no
value decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTH_FIRST, DAY_FIRST = 1, 2
ISO = "ISO"

# Names of months, days of months, and the parts of the recognised formats.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAME = ("(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|"
              "oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)")
DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
SEPARATORS = ["/", "-", ".", " "]
NAMED_DATES = {"0 b Y": "d MMM yyyy", "0-b-Y": "d-MMM-yyyy", "b 0, Y": "MMM d, yyyy", "b 0 Y": "MMM d yyyy"}
TIMES = {"": "", " 0:0": " H:mm", " 0:0:0": " H:mm:ss", " 0:0:0.f": " H:mm:ss.S", " 0:0 p": " h:mm a",
         " 0:0:0 p": " h:mm:ss a"}
# No date text is shorter or longer.
CHARACTERS = (6, 40)


def _formats() -> dict[str, dict[int, str]]:
    """Shape of a whole text to its formats, by the bit that allows each."""
    dates = {shape: {MONTH_FIRST: name} for shape, name in NAMED_DATES.items()}
    for s in SEPARATORS:
        dates[f"Y{s}0{s}0"] = {MONTH_FIRST: f"yyyy{s}M{s}d"}
        for year, digits in (("Y", "yyyy"), ("0", "yy")):
            dates[f"0{s}0{s}{year}"] = {MONTH_FIRST: f"M{s}d{s}{digits}", DAY_FIRST: f"d{s}M{s}{digits}"}
    return {shape + clock: {bit: name + pattern for bit, name in names.items()}
            for shape, names in dates.items() for clock, pattern in TIMES.items()}


FORMATS = _formats()


def with_date_parts(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Add for each text column a shape and a set of orders, with the given prefixes.

    ``texts`` maps a column to the prefix of its new columns ``*_shape`` (digits of a
    year as Y, other numbers as 0, a month's name as b; NULL for what does not look
    like a date) and ``*_orders`` (the bits of the orders its numbers allow: 0 for
    what is no date, NULL for NULL). The parts are projected one after the other, so
    that each is computed once, and numbers are cut only out of texts of a known shape.
    """
    kept = list(df.columns)
    df = df.withColumns({f"{p}_date": F.when(F.length(c).between(*CHARACTERS), F.lower(F.trim(F.col(c))))
                         for c, p in texts.items()})
    df = df.withColumns({f"{p}_shape": _shape(F.col(f"{p}_date")) for p in texts.values()})
    df = df.withColumns({name: part for p in texts.values() for name, part in _parts(p).items()})
    df = df.withColumns({name: part for p in texts.values() for name, part in _fields(p).items()})
    return df.select(
        *kept, *[F.when(F.col(f"{p}_like"), F.col(f"{p}_shape")).alias(f"{p}_shape") for p in texts.values()],
        *[F.when(F.col(c).isNotNull(), _orders(p)).alias(f"{p}_orders") for c, p in texts.items()])


def _shape(date: Column) -> Column:
    """Plain replacements, as most texts are no dates; only those with letters are searched for a month."""
    named = F.when(date.rlike("[a-z]{3}"), F.regexp_replace(date, MONTH_NAME, "b")).otherwise(date)
    shape = F.translate(named, "0123456789", "0000000000")
    shape = F.replace(F.replace(shape, F.lit("0000"), F.lit("Y")), F.lit("00"), F.lit("0"))
    shape = F.regexp_replace(F.when(shape.contains(":"), F.replace(F.replace(
        shape, F.lit("am"), F.lit(" p")), F.lit("pm"), F.lit(" p"))).otherwise(shape), " +p$", " p")
    return F.when(shape.contains("."), F.regexp_replace(shape, r":0\.[0Y]+$", ":0.f")).otherwise(shape)


def _parts(p: str) -> dict[str, Column]:
    date = F.col(f"{p}_date")
    like = F.coalesce(F.col(f"{p}_shape").isin(list(FORMATS)), F.lit(False))
    name = F.when(F.col(f"{p}_shape").contains("b"), F.substring(F.regexp_extract(date, "[a-z]+", 0), 1, 3))
    return {f"{p}_like": like,
            f"{p}_numbers": F.when(like, F.array_remove(F.split(F.translate(
                date, "/-.,:abcdefghijklmnopqrstuvwxyz", " " * 31), " "), "")),
            f"{p}_month": F.coalesce(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name).cast("int"), F.lit(0))}


def _fields(p: str) -> dict[str, Column]:
    """Year, the two numbers that may be month and day in the order month-first takes them, and whether the time is one."""
    a, b, c, d, e, f = (F.get(F.col(f"{p}_numbers"), F.lit(i)).try_cast("int") for i in range(6))
    named, year_first = F.col(f"{p}_month") > 0, F.col(f"{p}_shape").startswith("Y")
    hour, minute, seconds = (F.coalesce(F.when(named, x).otherwise(y), F.lit(0)) for x, y in ((c, d), (d, e), (e, f)))
    in_day = F.when(F.col(f"{p}_shape").endswith("p"), hour.between(1, 12)).otherwise(hour < 24)
    return {f"{p}_year": F.when(named, b).when(year_first, a).otherwise(c),
            f"{p}_first": F.when(named, F.col(f"{p}_month")).when(year_first, b).otherwise(a),
            f"{p}_second": F.when(named, a).when(year_first, c).otherwise(b),
            f"{p}_swaps": ~named & ~year_first, f"{p}_clock": in_day & (minute < 60) & (seconds < 60)}


def _orders(p: str) -> Column:
    year, one, two = (F.col(f"{p}_{x}") for x in ("year", "first", "second"))
    month_first = F.when(F.col(f"{p}_clock") & _is_day(year, one, two), MONTH_FIRST).otherwise(0)
    day_first = F.when(F.col(f"{p}_clock") & F.col(f"{p}_swaps") & _is_day(year, two, one), DAY_FIRST).otherwise(0)
    return F.when(F.col(f"{p}_like"), month_first.bitwiseOR(day_first)).otherwise(0)


def _is_day(year: Column, month: Column, day: Column) -> Column:
    most = F.get(F.array(*[F.lit(d) for d in DAYS]), month - 1)
    leap = (month == 2) & (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0) | (year < 100))
    return month.between(1, 12) & day.between(1, most + F.when(leap, 1).otherwise(0))


def common_format(low: Column, high: Column, orders: Column) -> Column:
    """The format of a column from the extremes of its shapes and the AND of its orders, or NULL."""
    allowed = F.when(orders.bitwiseAND(F.lit(MONTH_FIRST)) != 0, MONTH_FIRST).when(
        orders.bitwiseAND(F.lit(DAY_FIRST)) != 0, DAY_FIRST)
    named = ", ".join(f"'{bit}{shape}', '{name}'" for shape, by_bit in FORMATS.items() for bit, name in by_bit.items())
    return F.when(low == high, F.try_element_at(F.expr(f"map({named})"), F.concat(allowed.cast("string"), low)))
