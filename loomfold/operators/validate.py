"""Record checks, one repair, and what people answered about records."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomfold.functions.dates import iso_prefix, years_between
from loomfold.functions.formats import FORMATS, FORMAT_HELP, check_format
from loomfold.functions.text import col, filled, norm_key, redact_named, strip, text_of, subject_parts
from loomfold.lineage import broadcast_if_small, evaluated
from loomfold.spec import DEFAULT_POLICY, Policy, SchemaSpec

ISSUE = "struct<field:string,rule:string,message:string>"


@dataclass(frozen=True)
class Roles:
    """Which contract fields play a part in cross-field rules."""

    birth: str = "date_of_birth"
    start: str = "date_of_joining"
    end: str = "date_of_exit"
    status: str = "status"
    active: str = "Active"
    inactive: str = "Inactive"
    upper_codes: tuple[str, ...] = ("pan", "ifsc")
    digit_codes: tuple[str, ...] = ("uan", "bank_account")


ROLES = Roles()


def _issue(cond: Column, field: str, rule: str, message: Column | str) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(rule).alias("rule"), text.alias("message")))


def check(spec: SchemaSpec, suppress: Iterable[str] = (), waiting: Column | None = None, policy: Policy = DEFAULT_POLICY,
          roles: Roles = ROLES, get=col) -> Column:
    """P5: every reason a record cannot be loaded, as an array of structs.

    ``suppress`` are fields held dataset-wide, ``waiting`` an array column of
    fields already under question for the record.  ``get`` maps a field name to
    the column holding it.
    """
    held = set(suppress)
    waits = (lambda name: F.coalesce(F.array_contains(waiting, name), F.lit(False))) if waiting is not None else (lambda name: F.lit(False))
    out: list[Column] = []
    for f in spec.fields:
        value = strip(text_of(get(f.name)))
        if f.required and f.name not in held:
            out.append(_issue((value == "") & ~waits(f.name), f.name, "required", f"a record needs {f.name}, and this one has none"))
        if f.format in FORMATS:
            out.append(_issue((value != "") & ~check_format(f.format, value), f.name, "format", f"the content of {f.name} does not read as {FORMAT_HELP[f.format]}"))
        if f.enum:
            out.append(_issue((value != "") & ~value.isin(*f.enum), f.name, "enum", F.concat(
                F.lit(f"{f.name} allows only " + ", ".join(f.enum) + "; found '"), value, F.lit("'"))))
        if f.max_length:
            out.append(_issue(F.length(value) > f.max_length, f.name, "length", F.concat(
                F.lit(f"{f.name} holds "), F.length(value).cast("string"), F.lit(f" characters where {f.max_length} fit"))))
    names = set(spec.names)
    if {roles.birth, roles.start, roles.end, roles.status} <= names and not held & {roles.status, roles.end}:
        ready = ~waits(roles.status) & ~waits(roles.end)
        born, start, end = (iso_prefix(get(n)) for n in (roles.birth, roles.start, roles.end))
        age = years_between(born, start)
        low, high = policy.min_age_at_joining, policy.max_age_at_joining
        out += [
            _issue(ready & (start <= born), roles.start, "order", f"by these dates {roles.start} does not come after {roles.birth}"),
            _issue(ready & (start > born) & ~age.between(low, high), roles.start, "age", F.concat(
                F.lit("these dates make the person "), F.format_string("%.0f", age), F.lit(f" at the start; {low} to {high} is expected"))),
            _issue(ready & (end < start), roles.end, "order", f"{roles.end} precedes {roles.start}"),
            _issue(ready & (strip(text_of(get(roles.status))) == roles.inactive) & end.isNull(), roles.status, "exit",
                   f"{roles.end} is missing although {roles.status} says {roles.inactive}"),
        ]
    return F.array_compact(F.array(*out))


def issues_of(records: DataFrame, spec: SchemaSpec, **options) -> DataFrame:
    """``records`` with ``issues``, each value and each check evaluated once a row; ``options`` as of ``check``."""
    texts = evaluated(records, {n: col(n) for n in spec.names if n in records.columns})
    return evaluated(texts, {"issues": check(spec, **options)})


def repaired_value(name: str, spec: SchemaSpec, roles: Roles = ROLES) -> tuple[Column, Column]:
    """P12 for one field: (value after one mechanical repair, why -- null if unchanged)."""
    f, before = spec.field(name), text_of(col(name))
    after, why = before, F.lit(None).cast("string")
    if name in roles.upper_codes or name in roles.digit_codes:
        if name in roles.upper_codes:
            fixed, reason = F.regexp_replace(F.upper(before), "[ -]", ""), "codes are upper case without separators"
        else:
            fixed, reason = F.regexp_replace(before, r"(?U)\D", ""), "only the digits count"
        changed = (fixed != before) & (fixed != "")
        after, why = F.when(changed, fixed).otherwise(before), F.when(changed, F.lit(reason))
    if name == roles.status and roles.end in spec.names:
        left = iso_prefix(col(roles.end)).isNotNull() & (before == roles.active)
        after, why = F.when(left, F.lit(roles.inactive)).otherwise(after), F.when(left, F.lit("an exit date is recorded")).otherwise(why)
    if f.default is not None:
        empty = strip(before) == ""
        after, why = F.when(empty, F.lit(f.default)).otherwise(after), F.when(empty, F.lit("contract default")).otherwise(why)
    return after, why


def repairable(spec: SchemaSpec, roles: Roles = ROLES) -> list[str]:
    special = {*roles.upper_codes, *roles.digit_codes, roles.status}
    return [f.name for f in spec.fields if f.name in special or f.default is not None]


def validate_and_repair(records: DataFrame, spec: SchemaSpec, suppress: Iterable[str] = (), waiting: str | None = None,
                        policy: Policy = DEFAULT_POLICY, roles: Roles = ROLES) -> DataFrame:
    """Check; repair failing records once; check again.  Narrow, no shuffle.

    Adds ``issues`` (what remains) and ``changes`` (field, before, after, why).
    Records already skipped are left alone.
    """
    wait = F.col(waiting) if waiting else None
    live = F.col("push_status") != "skipped" if "push_status" in records.columns else F.lit(True)
    none = F.array().cast(f"array<{ISSUE}>")
    # each step is evaluated once a row: what follows would else repeat it in every use, filters before it included
    texts = evaluated(records, {n: col(n) for n in spec.names if n in records.columns})
    first = evaluated(texts, {"_first": F.when(live, check(spec, suppress, wait, policy, roles)).otherwise(none)})
    failing = F.size("_first") > 0
    fixes = {n: repaired_value(n, spec, roles) for n in repairable(spec, roles)}
    changes = F.array_compact(F.array(*[
        F.when(failing & why.isNotNull(), F.struct(F.lit(n).alias("field"), text_of(col(n)).alias("before"), after.alias("after"), why.alias("why")))
        for n, (after, why) in fixes.items()]))
    fixed = evaluated(first, {"changes": changes, **{n: F.when(failing, after).otherwise(col(n)) for n, (after, _) in fixes.items()}})
    again = F.when(F.size("_first") == 0, none).when(F.size("changes") == 0, F.col("_first")).otherwise(check(spec, suppress, wait, policy, roles))
    out = evaluated(fixed, {"issues": again})
    return out.select(*[col(c) for c in records.columns], "changes", "issues")


def repair_audit(validated: DataFrame, spec: SchemaSpec) -> DataFrame:
    return validated.select("key", F.inline("changes")).select(
        "key", "field", redact_named(F.col("field"), F.col("before"), spec.pii).alias("before"),
        redact_named(F.col("field"), F.col("after"), spec.pii).alias("after"), "why")


# -- A9/A10: a required field nothing feeds ----------------------------------

def missing_required(records: DataFrame, spec: SchemaSpec, pending: Iterable[str] = (), policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """(field, missing, total, structural) per required field: one global aggregate."""
    fields = [n for n in spec.required if n not in set(pending)]
    live = records.where("push_status <> 'skipped'") if "push_status" in records.columns else records
    counts = live.agg(F.count(F.lit(1)).alias("total"), *[F.count(F.when(strip(text_of(col(n))) == "", 1)).alias(n) for n in fields])
    long = counts.select("total", F.inline(F.array(*[F.struct(F.lit(n).alias("field"), col(n).alias("missing")) for n in fields])))
    structural = (F.col("total") >= policy.missing_min_records) & (F.col("missing") / F.col("total") >= policy.missing_rate)
    return long.select("field", "missing", "total", F.coalesce(structural, F.lit(False)).alias("structural"))


def apply_field_answers(records: DataFrame, structural: Iterable[str], answers: Mapping[str, str]) -> tuple[DataFrame, set[str], list[str]]:
    """A10: returns records (some skipped), the fields to suppress, and those still asked."""
    suppress, asked = set(), []
    for name in sorted(structural):
        answer = answers.get(f"field:{name}")
        if answer == "skip_records":
            empty = (strip(text_of(col(name))) == "") & (F.col("push_status") != "skipped")
            records = records.withColumn("push_status", F.when(empty, F.lit("skipped")).otherwise(F.col("push_status")))
            continue
        suppress.add(name)
        if answer != "not_required":
            asked.append(name)
    return records, suppress, asked


# -- J11/J12: answers about records ------------------------------------------

def record_edits(records: DataFrame, answers: DataFrame, spec: SchemaSpec, code: str = "employee_code") -> tuple[DataFrame, DataFrame]:
    """Apply "edit" and "skip"; an answer after a push outranks one before it.

    Returns the records and the audit of changed values (personal ones masked).
    """
    parts = subject_parts(F.col("subject"), 2)
    said = (answers.where(parts(0).isin("push", "record")).withColumn("key", parts(1))
            .groupBy("key").agg(F.max_by(F.struct("action", "value", "fields"), parts(0) == "push").alias("_a")))
    joined = records.join(said, "key", "left")
    edit = F.coalesce(F.col("_a.action") == "edit", F.lit(False))
    skip = F.coalesce((F.col("_a.action") == "value") & (F.col("_a.value") == "skip"), F.lit(False))
    new = {n: F.when(edit, F.coalesce(F.try_element_at(F.col("_a.fields"), F.lit(n)), col(n))).otherwise(col(n)) for n in spec.names}
    rekey = strip(text_of(F.try_element_at(F.col("_a.fields"), F.lit(code))))
    key = F.when(edit & (rekey != "") & (rekey != text_of(col(code))), rekey).otherwise(F.col("key"))
    changed = F.array_compact(F.array(*[
        F.when(edit & (new[n] != col(n)), F.struct(F.lit(n).alias("field"), col(n).alias("before"), new[n].alias("after"))) for n in spec.names]))
    status = F.when(skip, "skipped").when(edit, "pending").otherwise(F.col("push_status"))
    out = joined.select("*", changed.alias("_changed"), key.alias("_key"), skip.alias("_skip")).withColumns(new).withColumn("push_status", status)
    audit = out.select(F.col("_key").alias("key"), F.inline("_changed")).select(
        F.lit("correct_value").alias("action"), "key", "field", redact_named(F.col("field"), F.col("before"), spec.pii).alias("before"),
        redact_named(F.col("field"), F.col("after"), spec.pii).alias("after")).unionByName(
        out.where("_skip").select(F.lit("skip_record").alias("action"), F.col("_key").alias("key"), F.lit(None).cast("string").alias("field"),
                                  F.lit(None).cast("string").alias("before"), F.lit("skipped").alias("after")))
    return out.withColumn("key", F.col("_key")).select(*records.columns), audit


def reference_answers(records: DataFrame, answers: DataFrame, pointer: str) -> DataFrame:
    """Clear or reassign a pointer that leads nowhere; cut the answered cycle link."""
    parts = subject_parts(F.col("subject"), 2)
    about = (answers.where(parts(0) == "manager").groupBy(parts(1).alias("_to"))
             .agg(F.max_by(F.struct("action", "value", "fields"), F.struct("action", "value")).alias("_a")).where("_to <> ''"))
    given = F.lower(strip(text_of(F.try_element_at(F.col("_a.fields"), F.lit(pointer)))))
    new = (F.when(F.col("_a.value") == "clear", F.lit(""))
           .when((F.col("_a.action") == "edit") & (given != ""), given)
           .when(F.col("_a.value").startswith("reassign:"), F.substr("_a.value", F.lit(10))).otherwise(col(pointer)))
    # as many answers as people have given; records that name the same missing value may be a third of all
    few = lambda t: broadcast_if_small(t, DEFAULT_POLICY.broadcast_rows)       # noqa: E731
    kept = records.withColumn("_to", norm_key(col(pointer))).join(few(about), "_to", "left").withColumn(pointer, new)
    named = answers.where((parts(0) == "cycle-clear") & F.col("value").isNotNull() & ~F.col("value").isin("", "False", "false")).select(parts(1).alias("key"))
    chosen = answers.where(F.col("value").startswith("cycle-clear:")).select(subject_parts(F.col("value"), 2)(1).alias("key"))
    cuts = named.unionByName(chosen).distinct().withColumn("_cut", F.lit(True))
    return (kept.join(few(cuts), "key", "left").withColumn(pointer, F.when(F.col("_cut"), F.lit("")).otherwise(col(pointer)))
            .select(*records.columns))


def rekey_collisions(records: DataFrame) -> DataFrame:
    """Keys that more than one record carries after corrections."""
    return records.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def faulty_fields(spec: SchemaSpec, held: Iterable[str] = ()) -> Column:
    """The fields a reviewer is offered for a failing record."""
    named = F.array_distinct(F.transform("issues", lambda i: i["field"]))
    fallback = F.array(*[F.lit(n) for n in spec.required if n not in set(held)])
    return F.when(F.size(named) > 0, named).otherwise(fallback)


def masked_record(spec: SchemaSpec) -> Column:
    """The record as JSON for a question, personal values hidden."""
    shown = [F.when(filled(col(f.name)), F.lit("****") if f.pii else col(f.name)).alias(f.name) for f in spec.fields]
    return F.to_json(F.struct(*shown))
