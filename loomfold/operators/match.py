"""Matching source columns to target fields.

Everything here is catalog-sized: one row per (file, column) and, after an
explode of the contract's literal field list, one per (file, column, field).
Names are scored once per distinct header.  The per-file assignment, where
columns compete for fields, runs as one small group per file.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomfold.functions.formats import FORMATS
from loomfold.functions.similarity import token_sort_ratio, wratio
from loomfold.functions.text import alnum_key, is_null_word, strip, strip_stored
from loomfold.functions.vectors import cosine
from loomfold.lineage import cut, evaluated
from loomfold.operators.answers import remembered, rule_answers, share_map_answers
from loomfold.operators.vocabulary import canonicalise
from loomfold.spec import (AUTO, DEFAULT_POLICY, ESCALATED, FLAGGED, IGNORED, IGNORE_ANSWER, FieldSpec, Policy, SchemaSpec)

SPLIT = "split_full_name"
NAME_FIELDS = ("first_name", "last_name")
SHOWN = 4
MAX_LENGTH = (1 << 31) - 1

# Which inferred column types can feed which kind of field.
TYPE_COMPATIBILITY = {
    "date": ("date",),
    "email": ("email", "string"),
    "phone": ("phone", "number"),
    "enum": ("string",),
    "string": ("string", "id", "number", "email", "phone", "date"),
}
_PERSON_HEADER = r"(?iU)\b(name|employee|staff|person)\b"
_PART_HEADER = r"(?iU)\b(first|last|sur|given|middle|father|mother)\b"
_ALSO_CALLED = r"(?i)also called\s*(.+?)(?:\.|$)"


# -- the contract side -------------------------------------------------------

def alias_terms(fields: DataFrame) -> DataFrame:
    """every name a field goes by -- its own and those its description lists."""
    listed = F.flatten(F.transform(F.regexp_extract_all("description", F.lit(_ALSO_CALLED), F.lit(1)),
                                   lambda part: F.split(part, r",| or ")))
    terms = F.concat(F.array(F.regexp_replace("name", "_", " ")),
                     F.filter(F.transform(listed, lambda t: F.btrim(t, F.lit(" ."))), lambda t: t != ""))
    return fields.select("field_pos", F.col("name").alias("field"), F.explode(terms).alias("term"))


def _term_literals(spark, spec: SchemaSpec) -> Column:
    """The contract's names as one literal array (its size is the contract's)."""
    rows = alias_terms(spec.fields_table(spark)).orderBy("field_pos").collect()
    return F.array(*[F.struct(F.lit(r["field"]).alias("field"), F.lit(r["term"].lower()).alias("term")) for r in rows])


def _expected_type(f: FieldSpec) -> str:
    if f.type in ("date", "enum"):
        return f.type
    return f.format if f.format in ("email", "phone") else "string"


# -- scoring -----------------------------------------------------------------

def lexical_scores(profiles: DataFrame, spec: SchemaSpec) -> DataFrame:
    """F6/P9 per distinct header: (column, field, lexical, exact)."""
    terms = _term_literals(profiles.sparkSession, spec)
    header = strip(F.lower(F.regexp_replace("column", "_", " ")))
    pairs = (profiles.select("column").distinct().select("column", header.alias("header"), F.inline(terms)))
    scored = (pairs.select("header", "term").distinct()
              .withColumn("s", (F.lit(0.5) * wratio(F.col("header"), F.col("term"))
                                + F.lit(0.5) * token_sort_ratio(F.col("header"), F.col("term"))) / 100.0))
    same = (alnum_key(F.col("column")) == alnum_key(F.col("term"))) & (F.col("column") != "")
    return (pairs.join(scored, ["header", "term"])
            .groupBy("column", "field").agg(F.max("s").alias("lexical"), F.max(same).alias("exact")))


def _may_reach(a: Column, option: str, score: float) -> Column:
    """Whether the lengths and letters of a text and an option, or one within the other, let their WRatio reach ``score``.

    From 1.5 times the length on, a whole window of the longer text scores 90 and nothing else
    does; beyond 8 times, 60 is the most.  A letter within a page of text is no match.

    A common subsequence takes ``score / (200 - score)`` of the option's letters at least, however the
    words of both are sorted or dropped, unless a whole word of the option is shared.
    """
    text = option.lower()
    words_ = sorted(set(text.split()))
    forms = (text, " ".join(sorted(text.split())), " ".join(words_))
    needed = min(len(f) * score / (200.0 - score) - sum(c.isspace() for c in f) for f in forms)
    b = F.lit(text)
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    within = (F.contains(a, b) | F.contains(b, a)) if score == 90.0 else F.lit(score < 90.0)
    met = F.length(a) - F.length(F.translate(a, "".join(sorted(set("".join(words_)))), ""))
    alike = reduce(or_, [met >= needed - 1e-9, *[F.contains(a, F.lit(w)) for w in words_ if len(words_) > 1]])
    return (longer < 1.5 * shorter) & alike | (longer <= 8 * shorter) & within | F.lit(score <= 60.0)


def recognised_shares(values: DataFrame, profiles: DataFrame, spec: SchemaSpec, policy: Policy) -> DataFrame:
    """(file, column, field, recognised): share of a column's filled rows that already are words of an enum field.

    ``values``: the value frequencies.  Every distinct value counts with its rows.  Number and id
    columns are left out of fields without numbered words, which they cannot feed, before their
    values are looked at; of the rest only values that can reach the threshold are scored.
    """
    enums = [f for f in spec.fields if f.type == "enum" and f.enum]
    if not enums:
        return profiles.select("file", "column", F.lit("").alias("field"), F.lit(0.0).alias("recognised")).limit(0)
    score = policy.enum_auto_min
    longest = {f.name: max([8 * len(o) for o in f.enum] + [len(a) for a, _ in f.aliases]) if score > 60.0 else MAX_LENGTH for f in enums}
    listed = F.array(*[F.struct(F.lit(f.name).alias("field"), F.lit(any(o.strip().isdigit() for o in f.enum)).alias("numbered"), F.lit(longest[f.name]).alias("longest")) for f in enums])
    asked = (profiles.select("file", "column", "inferred_type", "non_null", F.inline(listed))
             .where(F.col("numbered") | ~F.col("inferred_type").isin("number", "id")).drop("inferred_type", "numbered"))
    # lower case has no fewer characters, so a page of text is told by its length before it is lowered
    short = (values.where((F.col("value") != "") & ~is_null_word(F.col("value"))).join(F.broadcast(asked), ["file", "column"])
             .where(F.length(strip_stored(F.col("value"))) <= F.col("longest")))
    cells = evaluated(short, {"value": strip(F.lower("value"))})
    near = reduce(or_, [(F.col("field") == f.name) & reduce(or_, [_may_reach(F.col("value"), o, score) for o in f.enum] + [F.col("value").isin([a for a, _ in f.aliases])]) for f in enums])
    likely = cut(cells.where(near).groupBy("file", "column", "non_null", "field", "value").agg(F.sum("n").alias("n")))    # read three times
    words_ = canonicalise(likely.select("field", "value").distinct(), spec, policy).where("canonical IS NOT NULL").select("field", "value")
    return (likely.join(words_, ["field", "value"]).groupBy("file", "column", "field")
            .agg((F.sum("n") / F.first("non_null")).alias("recognised")))


def _structural(f: FieldSpec, policy: Policy) -> Column:
    """P15 for one field, over profile columns and ``recognised``: shares of all filled rows."""
    filled = F.col("non_null") > 0
    kind = F.col("inferred_type")
    rules: list[tuple[Column, float]] = []
    if f.format in FORMATS:
        rules.append((filled & (F.col("shares")[f"format:{f.format}"] < policy.format_min_share), -policy.content_penalty))
    if f.unique:
        rules.append(((F.col("non_null") > 0) & (F.col("cardinality") / F.col("non_null") < policy.unique_min_distinct_ratio),
                      -policy.content_penalty))
    if f.enum:
        if not any(o.strip().isdigit() for o in f.enum):
            rules.append((filled & kind.isin("number", "id"), -policy.content_penalty))
        rules.append((filled & (F.col("recognised") >= policy.vocabulary_share), policy.type_bonus))
    expected = _expected_type(f)
    rules.append((kind.isin(*TYPE_COMPATIBILITY[expected]), policy.type_bonus if expected != "string" else 0.0))
    out = F.lit(-policy.type_penalty)
    for cond, value in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(value)).otherwise(out)
    return out


def relative_semantic(cosines: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Standardise each column's similarities within its own candidate set."""
    own = Window.partitionBy("file", "column")
    c = F.col("cosine")
    spread, mean, top = F.stddev_pop(c).over(own), F.avg(c).over(own), F.max(c).over(own)
    z = (c - mean) / (policy.semantic_z_full_scale * spread)
    usable = (top > 0) & (spread >= 1e-6)
    return cosines.withColumn("relative", F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), z))).otherwise(F.lit(0.0)))


def column_cosines(column_vectors: DataFrame, field_vectors: DataFrame) -> DataFrame:
    """(file, column, field, cosine).  The field side is the contract's size
    and travels as one array in a broadcast single-row table."""
    packed = field_vectors.groupBy(F.lit(1).alias("_k")).agg(F.collect_list(F.struct("field", "embedding")).alias("fields"))
    return (column_vectors.select("file", "column", F.col("embedding").alias("v"), F.lit(1).alias("_k"))
            .join(F.broadcast(packed), "_k")
            .select("file", "column", "v", F.explode("fields").alias("f"))
            .select("file", "column", F.col("f.field").alias("field"), cosine(F.col("v"), F.col("f.embedding")).alias("cosine")))


def embed_texts(profiles: DataFrame) -> DataFrame:
    """what an embedding service is given for a column (masked samples only)."""
    return profiles.select("file", "column", F.concat(
        F.regexp_replace("column", "_", " "), F.lit(". Example values: "),
        F.array_join(F.slice("samples", 1, 5), ", ")).alias("text"))


def full_name_column() -> Column:
    """Header speaks of a person and nearly all filled rows hold two to four words."""
    header = F.regexp_replace("column", "_", " ")
    return header.rlike(_PERSON_HEADER) & ~header.rlike(_PART_HEADER) & F.coalesce(F.col("shares")["full_name"] >= 0.8, F.lit(False))


def score_candidates(profiles: DataFrame, spec: SchemaSpec, policy: Policy = DEFAULT_POLICY,
                     cosines: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """One row per (file, column, field) with blended score and rank.

    ``values`` (value frequencies) let words speak for enum fields; without them only the
    columns' types do.
    """
    fields = F.array(*[F.struct(F.lit(i).alias("field_pos"), F.lit(f.name).alias("field")) for i, f in enumerate(spec.fields)])
    base = profiles.select("file", "column", "column_pos", "inferred_type", "shares", "non_null", "cardinality", F.inline(fields))
    scored = base.join(lexical_scores(profiles, spec), ["column", "field"], "left")
    if values is None:
        scored = scored.withColumn("recognised", F.lit(0.0))
    else:
        scored = scored.join(recognised_shares(values, profiles, spec, policy), ["file", "column", "field"], "left")
    if cosines is None:
        scored = scored.withColumn("cosine", F.lit(0.0)).withColumn("relative", F.lit(0.0))
    else:
        scored = (scored.join(relative_semantic(cosines, policy), ["file", "column", "field"], "left")
                  .fillna(0.0, ["cosine", "relative"]))
    adjust = F.lit(0.0)
    for f in spec.fields:
        adjust = F.when(F.col("field") == f.name, _structural(f, policy)).otherwise(adjust)
    has_semantic = F.max("cosine").over(Window.partitionBy("file", "column")) > 0
    blend = F.when(has_semantic, policy.embedding_weight * F.col("relative") + policy.fuzzy_weight * F.col("lexical")).otherwise(F.col("lexical"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend + adjust))
    ranked = Window.partitionBy("file", "column").orderBy(F.desc("score"), "field_pos")
    return (scored.withColumn("score", score).withColumn("rank", F.row_number().over(ranked))
            .select("file", "column", "column_pos", "field", "field_pos", "score", F.col("cosine").alias("embedding_score"),
                    F.col("lexical").alias("fuzzy_score"), "exact", "rank"))


def mapping_verdict(top: Column, runner_up: Column, lexical_best: Column, exact: Column,
                    policy: Policy = DEFAULT_POLICY) -> Column:
    """P14 as an expression."""
    clear = (top >= policy.mapping_auto_min) & (top - runner_up >= policy.mapping_margin_min)
    named = exact & F.lit(policy.exact_name_is_conclusive)
    return (F.when((lexical_best < policy.lexical_floor) & (top < policy.lexical_rescue), IGNORED)
            .when(top < policy.mapping_ignore_max, IGNORED).when(named | clear, AUTO).otherwise(ESCALATED))


# -- assignment --------------------------------------------------------------

_CANDIDATE = "array<struct<field:string,score:double,embedding_score:double,fuzzy_score:double>>"
MAPPING_SCHEMA = (f"file string, column string, column_pos int, target_field string, disposition string, confidence double, "
                  f"margin double, reason string, transform string, provenance string, contest string, candidates {_CANDIDATE}")


class _FileMatch:
    """One file's columns competing for fields: a score matrix and what is taken."""

    def __init__(self, pdf: pd.DataFrame, fields: list[str], policy: Policy, contests: dict[str, str]) -> None:
        self.cols = pdf.sort_values("column_pos", kind="stable").reset_index(drop=True)
        self.fields, self.policy, self.contests = fields, policy, contests
        size = (len(self.cols), len(fields))
        self.score, self.lexical, self.semantic = np.zeros(size), np.zeros(size), np.zeros(size)
        self.exact = np.zeros(size, dtype=bool)
        for i, items in enumerate(self.cols["scores"]):
            for item in items:
                j = item["field_pos"]
                self.score[i, j], self.lexical[i, j] = item["score"], item["fuzzy_score"]
                self.semantic[i, j], self.exact[i, j] = item["embedding_score"], bool(item["exact"])
        self.taken = np.zeros(len(fields), dtype=bool)
        self.open = np.ones(len(self.cols), dtype=bool)
        self.rows: list[dict] = []

    def _take(self, i: int, names) -> None:
        self.taken[[self.fields.index(n) for n in names if n in self.fields]] = True
        self.open[i] = False

    def _candidates(self, i: int, allowed: np.ndarray) -> list[dict]:
        order = [j for j in np.argsort(-self.score[i], kind="stable") if allowed[j]][:SHOWN]
        return [dict(field=self.fields[j], score=float(self.score[i, j]), embedding_score=float(self.semantic[i, j]),
                     fuzzy_score=float(self.lexical[i, j])) for j in order]

    def _emit(self, i, target, disposition, confidence, margin, reason, transform=None, provenance="scored",
              contest=None, allowed=None) -> None:
        row = self.cols.iloc[i]
        everything = np.ones(len(self.fields), dtype=bool)
        self.rows.append(dict(
            file=row["file"], column=row["column"], column_pos=int(row["column_pos"]), target_field=target,
            disposition=disposition, confidence=float(confidence), margin=float(margin), reason=reason,
            transform=transform, provenance=provenance, contest=contest,
            candidates=self._candidates(i, everything if allowed is None else allowed)))
        self.open[i] = False

    def _leaders(self, allowed: np.ndarray):
        """Per column: best allowed field, its score, the next best score."""
        masked = np.where(allowed, self.score, -1.0)
        best = masked.argmax(axis=1)
        top = masked[np.arange(len(best)), best]
        rest = masked.copy()
        rest[np.arange(len(best)), best] = -1.0
        return best, top, np.maximum(rest.max(axis=1), 0.0) if rest.shape[1] > 1 else np.zeros(len(best))

    def _verdicts(self, best, top, runner) -> np.ndarray:
        p = self.policy
        exact = self.exact[np.arange(len(best)), best] & p.exact_name_is_conclusive
        dropped = ((self.lexical.max(axis=1) < p.lexical_floor) & (top < p.lexical_rescue)) | (top < p.mapping_ignore_max)
        clear = (top >= p.mapping_auto_min) & (top - runner >= p.mapping_margin_min)
        return np.where(dropped, IGNORED, np.where(exact | clear, AUTO, ESCALATED))

    def answered(self) -> None:
        for i, answer in enumerate(self.cols["answer"]):
            if answer == IGNORE_ANSWER:
                self._emit(i, None, IGNORED, 1, 1, "answered: not for migration", provenance="human")
            elif answer in self.fields:
                self._give(i, answer, AUTO, "human", f"answered: this is {answer}")

    def remembered(self) -> None:
        for i, known in enumerate(self.cols["remembered"]):
            if self.open[i] and known in self.fields and not self.taken[self.fields.index(known)]:
                self._give(i, known, FLAGGED, "memory", f"confirmed as {known} on an earlier run")

    def _give(self, i: int, field: str, disposition: str, provenance: str, reason: str) -> None:
        split = bool(self.cols["full_name"].iat[i])
        self._emit(i, field, disposition, 1, 1, reason, SPLIT if split else None, provenance)
        self._take(i, (field, *NAME_FIELDS) if split else (field,))

    def full_names(self) -> None:
        names = [self.fields.index(n) for n in NAME_FIELDS if n in self.fields]
        if len(names) < 2:
            return
        for i in np.flatnonzero(self.open & self.cols["full_name"].to_numpy(dtype=bool)):
            j = int(self.score[i].argmax())
            if j in names and not self.taken[names].any():
                self._emit(i, NAME_FIELDS[0], FLAGGED, self.score[i, j], self.score[i, j],
                           "samples are full names, so they are split", SPLIT)
                self._take(i, NAME_FIELDS)

    def claims(self) -> None:
        """Strongest claim first; every settled field leaves the others less choice."""
        while self.open.any() and not self.taken.all():
            best, top, runner = self._leaders(~self.taken)
            sure = self.open & (self._verdicts(best, top, runner) == AUTO)
            if not sure.any():
                return
            i = int(np.where(sure, top, -1.0).argmax())
            j = int(best[i])
            close = self.open & (self.score[:, j] >= self.policy.mapping_auto_min) & (top[i] - self.score[:, j] < self.policy.mapping_margin_min)
            close[i] = False
            group = [i, *np.flatnonzero(close)]
            if len(group) == 1:
                self._emit(i, self.fields[j], AUTO, top[i], top[i] - runner[i], "clear of every other candidate")
            else:
                self._contest(group, j)
            self.taken[j] = True

    def _contest(self, group: list[int], j: int) -> None:
        field, names = self.fields[j], [self.cols["column"].iat[k] for k in group]
        chosen = self.contests.get(f"contest:{self.cols['file'].iat[0]}:{field}")
        if chosen in names:
            self._emit(group[names.index(chosen)], field, AUTO, 1, 1, f"answered: {chosen} holds {field}", provenance="human")
            return
        for k in group:
            self._emit(k, None, ESCALATED, self.score[k, j], 0.0, f"competes with other columns for {field}", contest=field)

    def leftovers(self) -> None:
        allowed = ~self.taken if not self.taken.all() else np.ones(len(self.fields), dtype=bool)
        best, top, runner = self._leaders(allowed)
        verdicts = self._verdicts(best, top, runner)
        for i in np.flatnonzero(self.open):
            margin = top[i] - runner[i]
            if verdicts[i] == IGNORED:
                self._emit(i, None, IGNORED, top[i], margin, "nothing in the contract describes it", allowed=allowed)
            else:
                tied = allowed.sum() > 1 and margin < self.policy.mapping_margin_min
                self._emit(i, None, ESCALATED, top[i], margin, "two fields too close to call" if tied else "below the score applied unasked",
                           allowed=allowed)

    def run(self) -> pd.DataFrame:
        for step in (self.answered, self.remembered, self.full_names, self.claims, self.leftovers):
            step()
        return pd.DataFrame(self.rows).sort_values("column_pos")


def _file_groups(profiles: DataFrame, candidates: DataFrame, answers: DataFrame | None, memory: DataFrame | None) -> DataFrame:
    scores = candidates.groupBy("file", "column").agg(
        F.collect_list(F.struct("field_pos", "score", "embedding_score", "fuzzy_score", "exact")).alias("scores"))
    cols = profiles.select("file", "column", "column_pos", full_name_column().alias("full_name")).join(scores, ["file", "column"])
    if answers is not None:
        cols = cols.join(share_map_answers(answers, profiles), ["file", "column"], "left")
    else:
        cols = cols.withColumn("answer", F.lit(None).cast("string"))
    if memory is not None:
        return cols.join(remembered(memory, profiles), ["file", "column"], "left")
    return cols.withColumn("remembered", F.lit(None).cast("string"))


def match_columns(profiles: DataFrame, spec: SchemaSpec, policy: Policy = DEFAULT_POLICY, answers: DataFrame | None = None,
                  memory: DataFrame | None = None, cosines: DataFrame | None = None,
                  candidates: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """The mapping of every column of every file."""
    candidates = score_candidates(profiles, spec, policy, cosines, values) if candidates is None else candidates
    fields, contests = spec.names, rule_answers(answers)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        return _FileMatch(pdf, fields, policy, contests).run()

    return _file_groups(profiles, candidates, answers, memory).groupBy("file").applyInPandas(assign, MAPPING_SCHEMA)


def sweep_thresholds(profiles: DataFrame, candidates: DataFrame, truth: DataFrame, spec: SchemaSpec,
                     auto_min: list[float], margin_min: list[float], policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Right / asked / wrong for every cell of a threshold grid.

    ``truth``: (file, column, expected), with IGNORE for columns without a field.
    Each (cell, file) is one small group, so the grid runs in parallel.
    """
    grid = F.array(*[F.struct(F.lit(a).alias("auto_min"), F.lit(m).alias("margin_min")) for a in auto_min for m in margin_min])
    # a few bytes but many small groups: a fixed number of parts, which are not put together again by size
    groups = _file_groups(profiles, candidates, None, None).select("*", F.inline(grid)).repartition(64, "file", "auto_min", "margin_min")
    fields = spec.names

    def assign(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cell = replace(policy, mapping_auto_min=float(key[1]), mapping_margin_min=float(key[2]))
        out = _FileMatch(pdf, fields, cell, {}).run()[["file", "column", "target_field", "disposition"]]
        return out.assign(auto_min=float(key[1]), margin_min=float(key[2]))

    cells = groups.groupBy("file", "auto_min", "margin_min").applyInPandas(
        assign, "file string, column string, target_field string, disposition string, auto_min double, margin_min double")
    got = F.when(F.col("disposition") == IGNORED, F.lit("IGNORE")).otherwise(F.col("target_field"))
    asked = F.col("disposition") == ESCALATED
    return (cells.join(truth, ["file", "column"]).groupBy("auto_min", "margin_min")
            .agg(F.count(F.when(~asked & (got == F.col("expected")), 1)).alias("right"),
                 F.count(F.when(asked, 1)).alias("asked"),
                 F.count(F.when(~asked & (got != F.col("expected")), 1)).alias("wrong")))


def pending_fields(mappings: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """Fields whose source is still awaiting a decision."""
    shown = F.when(F.col("margin") < policy.mapping_margin_min, 2).otherwise(1)
    return (mappings.where(F.col("disposition") == ESCALATED)
            .select(F.explode(F.slice("candidates", F.lit(1), shown)).alias("c")).select(F.col("c.field").alias("field")).distinct())
