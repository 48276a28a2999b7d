"""Text expressions (Column -> Column).  No Python runs per row here."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Whitespace as text tools outside the JVM define it: Unicode White_Space plus
# the four ASCII separators that java.util.regex leaves out.
_WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WS_RUN = r"[\p{IsWhite_Space}\x1c-\x1f]+"

# Name suffixes and surname particles.
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "phd", "md")
SURNAME_PARTICLES = ("van", "von", "de", "del", "della", "der", "den", "di", "da", "dos", "du",
                     "la", "le", "bin", "binte", "ibn", "al")
# Words that mean "no value" in an export.
NULL_WORDS = ("nan", "none", "null")


def col(name: str) -> Column:
    """A column by its literal name, whatever characters the header holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(c: Column) -> Column:
    """Any column as text; missing becomes the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WS_CHARS))


def strip_stored(c: Column) -> Column:
    """``strip`` of a stored column: most values have nothing to strip, so only their ends are looked at."""
    ends = F.contains(F.lit(_WS_CHARS), F.left(c, F.lit(1))) | F.contains(F.lit(_WS_CHARS), F.right(c, F.lit(1)))
    return F.when(ends, strip(c)).otherwise(c)


def collapse(c: Column) -> Column:
    """Runs of whitespace become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, _WS_RUN, " "))


def words(c: Column) -> Column:
    """Tokens of a text; an empty text has none."""
    t = collapse(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def few_words(c: Column, least: int, most: int) -> Column:
    """Whether ``words`` finds ``least`` to ``most`` tokens; reads no further than it must."""
    gap, token = _WS_RUN[:-1], r"[^\p{IsWhite_Space}\x1c-\x1f]++"
    return c.rlike(rf"^{gap}*+{token}(?:{gap}++{token}){{{least - 1},{most - 1}}}{gap}*+\z")


def norm_key(c: Column) -> Column:
    """Comparison form of an identifier or name: trimmed and lowered, null as ''."""
    return F.lower(strip(text_of(c)))


def column_key(c: Column) -> Column:
    """Header form shared by exports of the same system."""
    return F.regexp_replace(F.lower(strip(c)), "_", " ")


def alnum_key(c: Column) -> Column:
    """Letters and digits only, lowered: names equal but for cosmetics."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def is_null_word(c: Column) -> Column:
    return (F.length(c) <= max(map(len, NULL_WORDS))) & F.lower(c).isin(*NULL_WORDS)


def smart_title(c: Column) -> Column:
    """Title-case only tokens written all-upper or all-lower ("McDonald" stays)."""
    def fix(t: Column) -> Column:
        flat = (t == F.upper(t)) | (t == F.lower(t))
        return F.when(flat, F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substr(t, F.lit(2))))).otherwise(t)

    return F.array_join(F.transform(words(c), fix), " ")


def normalise(c: Column, field) -> Column:
    """Cosmetic clean-up of one value for one target field."""
    t = collapse(text_of(c))
    if field.format == "email":
        return F.lower(t)
    if field.format == "phone":
        kept = F.regexp_replace(t, r"(?U)[^\d+]", "")
        return F.when(t.startswith("+"), F.concat(F.lit("+"), F.regexp_replace(kept, r"^\++", ""))).otherwise(kept)
    if field.format in ("pan", "ifsc"):
        return F.regexp_replace(F.upper(t), " ", "")
    if field.format in ("uan", "bank_account"):
        return F.regexp_replace(t, " ", "")
    if field.name in ("first_name", "last_name"):
        return smart_title(t)
    return t


def _trailing_run(items: Column, hit) -> Column:
    """How many items at the end of an array satisfy ``hit``."""
    return F.aggregate(items, F.lit(0), lambda n, t: F.when(hit(t), n + 1).otherwise(F.lit(0)))


def split_name(c: Column) -> Column:
    """Full name -> struct(first, last).

    A comma means surname first.  Otherwise the surname is the last word, with
    the particles before it and any suffix after it; one word is a given name.
    """
    text = collapse(text_of(c))
    comma = F.locate(",", text)
    before = F.trim(F.substring_index(text, ",", 1))
    after = F.trim(F.substr(text, comma + 1))

    parts = F.split(text, " ")
    n = F.size(parts)
    is_suffix = lambda t: F.btrim(F.lower(t), F.lit(".")).isin(*NAME_SUFFIXES)      # noqa: E731
    is_particle = lambda t: F.lower(t).isin(*SURNAME_PARTICLES)                     # noqa: E731
    suffixes = F.least(_trailing_run(parts, is_suffix), F.greatest(n - 2, F.lit(0)))
    core = n - suffixes
    run = _trailing_run(F.slice(parts, F.lit(1), F.greatest(core - 1, F.lit(0))), is_particle)
    cut = F.greatest(F.lit(1), core - 1 - run)
    given = F.array_join(F.slice(parts, F.lit(1), cut), " ")
    surname = F.array_join(F.slice(parts, cut + 1, F.greatest(n - cut, F.lit(0))), " ")

    first = (F.when(text == "", F.lit(""))
             .when((comma > 0) & (before != "") & (after != ""), after)
             .when((comma > 0) & (before != ""), F.lit(""))
             .when(comma > 0, after)
             .when(n == 1, text)
             .otherwise(given))
    last = (F.when(text == "", F.lit(""))
            .when(comma > 0, before)
            .when(n == 1, F.lit(""))
            .otherwise(surname))
    return F.struct(first.alias("first"), last.alias("last"))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z]", "")


def abbreviates(a: Column, b: Column) -> Column:
    """One (lowered) name is a shortening, of at most three letters, of the other."""
    x, y = letters_only(a), letters_only(b)
    short = F.when(F.length(x) <= F.length(y), x).otherwise(y)
    long = F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (x != "") & (y != "") & (x != y) & (F.length(short) <= 3) & F.startswith(long, short)


def mask(c: Column) -> Column:
    """Keep the last four characters, hide the rest."""
    t = strip(text_of(c))
    size = F.length(t)
    return F.when(size <= 4, F.repeat(F.lit("*"), size)).otherwise(
        F.concat(F.repeat(F.lit("*"), size - 4), F.right(t, F.lit(4))))


def redact_samples(samples: Column, kind: Column) -> Column:
    return F.when(kind.isNull(), samples).otherwise(F.transform(samples, mask))


def redact_field(name: str, c: Column, pii_fields) -> Column:
    """Mask one field's value if the contract marks the field as personal."""
    return F.when(text_of(c) != "", mask(c)).otherwise(c) if name in set(pii_fields) else c


def redact_named(name: Column, value: Column, pii_fields) -> Column:
    """As ``redact_field`` where the field name is itself data (long tables)."""
    pii = list(pii_fields)
    if not pii:
        return value
    return F.when(name.isin(*pii) & (text_of(value) != ""), mask(value)).otherwise(value)


def generalise(c: Column) -> Column:
    """Replace code-shaped tokens so messages that differ only by code group together."""
    return strip(F.regexp_replace(c, r"(?U)\b[A-Za-z]{0,3}\d{2,}[A-Za-z0-9-]*\b", "<code>"))


def pair_subject(prefix: str, a: Column, b: Column) -> Column:
    """The same subject whichever way round the pair is written."""
    return F.concat(F.lit(prefix + ":"), F.least(a, b), F.lit("|"), F.greatest(a, b))


def idempotency_key(run_id: str, code: Column) -> Column:
    return F.concat(F.lit(run_id + ":"), code)


def subject_parts(subject: Column, n: int):
    """``kind:a:b...`` in at most ``n`` parts (the last keeps its colons): part number
    -> Column, null where there is no such part."""
    split = F.split(subject, ":", n)
    return lambda i: F.get(split, F.lit(i))


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def completeness(names) -> Column:
    """How many of the named fields hold a value."""
    total = F.lit(0)
    for name in names:
        total = total + F.when(filled(col(name)), 1).otherwise(0)
    return total
