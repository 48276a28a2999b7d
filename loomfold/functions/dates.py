"""Reading dates: one value may be unreadable alone, a column rarely is.

``with_readings`` adds everything one text says about itself; the decision which
of two readings holds is taken per column (``operators.dates``) and applied with
``apply_convention``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from loomfold.functions.text import strip, text_of

DMY, MDY, ISO = "DMY", "MDY", "ISO"

# The accepted shapes.  Month names count by their first three letters.
_MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]{0,6}"
_TEXT_DMY = rf"(?i)^([0-9]{{1,2}})[\s-]+({_MONTH})[\s-]+([0-9]{{2,4}})$"
_TEXT_MDY = rf"(?i)^({_MONTH})[\s-]+([0-9]{{1,2}}),?[\s-]+([0-9]{{2,4}})$"
_NUMERIC = r"^([0-9]{1,4})([-/.])([0-9]{1,2})\2([0-9]{1,4})$"

# Why a text is not a date.
EMPTY, UNRECOGNISED = "empty", "unrecognised format"
NEITHER = "neither component can be a month"
NO_CONVENTION = "ambiguous and no convention established for the column"
UNREADABLE, NOT_A_DAY = "unreadable", "not a real calendar date"
_DESCRIPTION = {DMY: "day/month/year", MDY: "month/day/year", ISO: "year-month-day"}


def describe(convention: str | None) -> str:
    return _DESCRIPTION.get(convention or "", "unknown")


def full_year(y: Column) -> Column:
    """Two-digit years: up to 30 is this century, above it the last one."""
    return F.when(y >= 100, y).when(y <= 30, y + 2000).otherwise(y + 1900)


def calendar_date(y: Column, m: Column, d: Column) -> Column:
    """A date, or null where the calendar has no such day (never an error)."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return F.when(y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= length), F.make_date(y, m, d))


def date_parts(c: Column) -> Column:
    """struct(shape, pieces): one text taken apart.

    ``worded``: day, month, year.  ``numeric``: the three numbers as written.
    ``empty`` and ``other`` have no pieces.
    """
    text = strip(text_of(c))
    is_dmy, is_mdy, is_num = text.rlike(_TEXT_DMY), text.rlike(_TEXT_MDY), text.rlike(_NUMERIC)
    bar = "\u0001"
    pieces = F.split(F.when(is_dmy, F.regexp_replace(text, _TEXT_DMY, f"$1{bar}$2{bar}$3"))
                     .when(is_mdy, F.regexp_replace(text, _TEXT_MDY, f"$2{bar}$1{bar}$3"))
                     .when(is_num, F.regexp_replace(text, _NUMERIC, f"$1{bar}$3{bar}$4")), bar)
    shape = F.when(text == "", "empty").when(is_dmy | is_mdy, "worded").when(is_num, "numeric").otherwise("other")
    return F.struct(shape.alias("shape"), pieces.alias("pieces"))


def _numbers(parts: Column) -> Column:
    """struct(shape, a, b, last, lead): the pieces as numbers, month names resolved."""
    shape, piece = parts["shape"], lambda i: F.get(parts["pieces"], F.lit(i))
    a, last = piece(0).try_cast("int"), piece(2).try_cast("int")
    names = F.create_map(*[F.lit(x) for pair in _MONTHS.items() for x in pair])
    month = F.try_element_at(names, F.lower(F.substring(piece(1), 1, 3)))
    b = F.when(shape == "worded", month).otherwise(piece(1).try_cast("int"))
    return F.struct(shape.alias("shape"), a.alias("a"), b.alias("b"), last.alias("last"), F.length(piece(0)).alias("lead"))


def _kind(n: Column) -> Column:
    a, b = n["a"], n["b"]
    return (F.when(n["shape"] != "numeric", n["shape"]).when(n["lead"] == 4, ISO).when((a > 12) & (b <= 12), DMY)
            .when((b > 12) & (a <= 12), MDY).when((a > 12) & (b > 12), "neither").otherwise("either"))


def with_readings(df: DataFrame, texts: Mapping[str, Column]) -> DataFrame:
    """Add one struct(parsed, ambiguous, implies, error, dmy, mdy) per text.

    A short chain of projections: each pattern is matched once per value and every
    later step works on small columns, which keeps the generated code small.
    """
    if not texts:
        return df
    keep, outs = df.columns, list(texts)
    df = df.withColumns({f"_p_{o}": date_parts(c) for o, c in texts.items()})
    df = df.withColumns({f"_n_{o}": _numbers(F.col(f"_p_{o}")) for o in outs})
    df = df.withColumns({f"_k_{o}": _kind(F.col(f"_n_{o}")) for o in outs} | {f"_y_{o}": full_year(F.col(f"_n_{o}.last")) for o in outs})
    dates = {}
    for o in outs:
        k, n, y = F.col(f"_k_{o}"), F.col(f"_n_{o}"), F.col(f"_y_{o}")
        dates[f"_1_{o}"] = F.when(k == ISO, calendar_date(n["a"], n["b"], n["last"])).when(k == MDY, calendar_date(y, n["a"], n["b"])).when(
            k.isin("worded", DMY, "either"), calendar_date(y, n["b"], n["a"]))
        dates[f"_2_{o}"] = F.when(k == "either", calendar_date(y, n["a"], n["b"]))
    df = df.withColumns(dates)
    return df.select(*keep, *[_reading(F.col(f"_k_{o}"), F.col(f"_1_{o}"), F.col(f"_2_{o}")).alias(o) for o in outs])


def _reading(kind: Column, first: Column, second: Column) -> Column:
    two = kind == "either"
    return F.struct(
        F.when(~two, first).alias("parsed"), two.alias("ambiguous"), F.when(kind.isin(DMY, MDY, ISO), kind).alias("implies"),
        F.when(kind == "empty", EMPTY).when(kind == "other", UNRECOGNISED).when(kind == "neither", NEITHER).alias("error"),
        F.when(two, first).alias("dmy"), second.alias("mdy"))


def apply_convention(reading: Column, convention: Column | str | None) -> Column:
    """struct(date, error): the reading settled under a column's convention."""
    conv = convention if isinstance(convention, Column) else F.lit(convention).cast("string")
    chosen = F.when(conv == DMY, reading["dmy"]).when(conv == MDY, reading["mdy"])
    known = F.coalesce(conv.isin(DMY, MDY), F.lit(False))
    value = F.coalesce(reading["parsed"], F.when(reading["ambiguous"], chosen))
    error = (F.when(value.isNotNull(), F.lit(None).cast("string"))
             .when(reading["error"].isNotNull(), reading["error"])
             .when(~reading["ambiguous"], F.lit(UNREADABLE))
             .when(~known, F.lit(NO_CONVENTION))
             .otherwise(F.lit(NOT_A_DAY)))
    return F.struct(value.alias("date"), error.alias("error"))


def iso_prefix(c: Column) -> Column:
    """The date in the first ten characters, or null."""
    head = F.substring(text_of(c), 1, 10)
    return F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & ~head.startswith("0000"),
                  head.try_cast("date"))


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(365.25)
