"""Shape predicates: field formats, personal-identifier kinds, inferred types."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomfold.functions.text import few_words, strip, text_of

# Value shapes.  (?U) gives \d and \s their Unicode meaning.
FORMATS = {
    "email": r"(?U)^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",
    "phone": r"(?U)^\+?\d[\d\s\-()]{7,17}\d$",
    "pan": r"^[A-Z]{5}[0-9]{4}[A-Z]$",
    "uan": r"(?U)^\d{12}$",
    "ifsc": r"^[A-Z]{4}0[A-Z0-9]{6}$",
    "bank_account": r"(?U)^\d{9,18}$",
}
FORMAT_HELP = {
    "email": "an e-mail address",
    "phone": "a phone number of 9 to 19 characters",
    "pan": "five letters, four digits, one letter",
    "uan": "twelve digits",
    "ifsc": "four letters, a zero, six letters or digits",
    "bank_account": "9 to 18 digits",
}
PII_PATTERNS = {
    "pan": r"^[A-Z]{5}[0-9]{4}[A-Z]$",
    "aadhaar": r"(?U)^\d{4}\s?\d{4}\s?\d{4}$",
    "uan": r"(?U)^\d{12}$",
    "bank_account": r"(?U)^\d{9,18}$",
}
PII_NAME_HINTS = {
    "pan": ("pan", "permanent account"),
    "aadhaar": ("aadhaar", "aadhar", "uid"),
    "uan": ("uan", "provident", "pf number", "pf no"),
    "bank_account": ("bank", "account no", "account number", "salary account", "ac no"),
}
TYPE_PATTERNS = {
    "email": r"(?U)^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$",
    "date": r"(?U)^(\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}|\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4})$",
    "phone": r"(?U)^\+?[\d\s\-()]{9,20}$",
    "id": r"(?iU)^[A-Z]{1,4}[-_]?\d{2,}$",
    "number": r"(?U)^-?\d+(\.\d+)?$",
}
# Inference order and the share of values each type needs.
TYPE_SHARES = (("email", 0.7), ("date", 0.7), ("phone", 0.7), ("id", 0.7), ("number", 0.9))
PII_SHARE = 0.8


# What a text needs for a shape, cheap to see: least and most characters, and a character it holds.
# Upper case may add characters (a ligature becomes three), and ``$`` lets a line break of two follow.
_NEEDS = {
    PII_PATTERNS["pan"]: (7, 12, ""), FORMATS["ifsc"]: (5, 13, ""), PII_PATTERNS["uan"]: (12, 14, ""), PII_PATTERNS["aadhaar"]: (12, 16, ""),
    PII_PATTERNS["bank_account"]: (9, 20, ""), FORMATS["phone"]: (9, 22, ""), TYPE_PATTERNS["phone"]: (9, 23, ""), FORMATS["email"]: (0, 0, "@"),
}
#: Shapes that start with a letter, so never with a decimal digit.
_LETTER_FIRST = (PII_PATTERNS["pan"], FORMATS["ifsc"], TYPE_PATTERNS["id"])


def has_shape(value: Column, pattern: str, upper: bool = False) -> Column:
    """Whether a text (in upper case if ``upper``) has a shape: most texts are told by length or first character."""
    out = (F.upper(value) if upper else value).rlike(pattern)
    least, most, held = _NEEDS.get(pattern, (0, 0, ""))
    if held:
        out = F.contains(value, F.lit(held)) & out
    if pattern in _LETTER_FIRST:
        out = ~((value >= "0") & (value < ":")) & out
    return F.length(value).between(least, most) & out if most else out


def type_shapes(value: Column) -> dict[str, Column]:
    """Whether a text has the shape of each inferred type.  A number is no date, so only other texts are read as one."""
    out = {name: has_shape(value, p) for name, p in TYPE_PATTERNS.items()}
    return out | {"date": (F.length(value) >= 5) & ~out["number"] & out["date"]}


def many_digits(value: Column, least: int = 10) -> Column:
    """Whether a text holds ``least`` digits; reads no further than it must."""
    return (F.length(value) >= least) & value.rlike(rf"(?U)(?:\d\D*+){{{least}}}")


def check_format(fmt: str | None, c: Column) -> Column:
    """True where the value fits the format; an unknown format fits everything."""
    if fmt not in FORMATS:
        return F.lit(True)
    return strip(text_of(c)).rlike(FORMATS[fmt])


def pii_by_name(column: Column) -> Column:
    """Kind suggested by the header, first declared kind wins; null if none."""
    name = F.regexp_replace(F.lower(column), "_", " ")
    out = F.lit(None).cast("string")
    for kind, hints in reversed(list(PII_NAME_HINTS.items())):
        hit = F.lit(False)
        for hint in hints:
            hit = hit | F.contains(name, F.lit(hint))
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


#: What a column's values are held against, as named shares of its filled rows.
SHAPES = {**{f"pii:{k}": p for k, p in PII_PATTERNS.items()}, **{f"format:{k}": p for k, p in FORMATS.items()}}


def shape_shares(value: Column, weight: Column, total: Column) -> Column:
    """Aggregate: for each shape the share of ``total`` rows whose (trimmed, filled) value has it, as a map.

    ``weight`` is the number of rows of a distinct value, 0 where it is blank: the whole column
    decides, however many placeholders come first.
    """
    shares = []
    for name, pattern in SHAPES.items():
        shares += [F.lit(name), F.try_divide(F.sum(F.when(has_shape(value, pattern, upper=True), weight).otherwise(0)), total)]
    two_to_four = few_words(value, 2, 4)
    return F.create_map(*shares, F.lit("full_name"), F.try_divide(F.sum(F.when(two_to_four, weight).otherwise(0)), total))


def pii_by_shape(shares: Column) -> Column:
    """First kind that nearly all of a column's rows are shaped like; null if none."""
    out = F.lit(None).cast("string")
    for kind in reversed(PII_PATTERNS):
        out = F.when(F.coalesce(shares[f"pii:{kind}"], F.lit(0.0)) >= PII_SHARE, F.lit(kind)).otherwise(out)
    return out


def pii_kind(column: Column, shares: Column) -> Column:
    return F.coalesce(pii_by_name(column), pii_by_shape(shares))


def is_retryable(status: Column, policy) -> Column:
    return status.isin(*policy.retryable_status)
