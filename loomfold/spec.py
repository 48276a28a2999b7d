"""Target contract and thresholds: the configuration every operator takes.

Nothing here touches data.  A ``SchemaSpec`` describes the table records are
reconciled into; a ``Policy`` holds every number that separates "apply" from
"ask".  Both are small, immutable and known on the driver, so operators fold
them into generated column expressions instead of joining against them.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields as dc_fields
from typing import Any, Iterable

from pyspark.sql import DataFrame, SparkSession, types as T

AUTO, FLAGGED, ESCALATED, IGNORED = "auto", "flagged", "escalated", "ignored"
IGNORE_ANSWER, BLANK_ANSWER = "__ignore__", "__blank__"


@dataclass(frozen=True)
class FieldSpec:
    name: str
    type: str = "string"                 # string | date | enum
    description: str = ""
    required: bool = False
    unique: bool = False
    identity: str | None = None          # "strong" marks an identifier
    format: str | None = None
    enum: tuple[str, ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()   # lowered source word -> enum value
    default: str | None = None
    max_length: int | None = None
    pii: bool = False
    references: str | None = None

    @property
    def embed_text(self) -> str:
        return f"{self.name.replace('_', ' ')}. {self.description}"


@dataclass(frozen=True)
class SchemaSpec:
    entity: str
    version: int
    fields: tuple[FieldSpec, ...]
    # identifiers that name a *record* and may therefore join rows; a person
    # identifier (one person, two records) is strong but must only raise questions
    record_identifiers: tuple[str, ...] = ()
    person_identifier: str | None = None

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError("field names must be unique")
        for f in self.fields:
            if f.type not in ("string", "date", "enum"):
                raise ValueError(f"{f.name}: unknown type {f.type!r}")
            if f.references and f.references not in names:
                raise ValueError(f"{f.name}: references unknown field {f.references!r}")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def by_name(self) -> dict[str, FieldSpec]:
        return {f.name: f for f in self.fields}

    def field(self, name: str | None) -> FieldSpec | None:
        return self.by_name.get(name or "")

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]

    @property
    def identity(self) -> list[str]:
        return [f.name for f in self.fields if f.identity == "strong"]

    @property
    def pii(self) -> list[str]:
        return [f.name for f in self.fields if f.pii]

    @property
    def reference_fields(self) -> list[tuple[str, str]]:
        return [(f.name, f.references) for f in self.fields if f.references]

    @staticmethod
    def from_dict(raw: dict[str, Any]) -> "SchemaSpec":
        known = {f.name for f in dc_fields(FieldSpec)}
        built = []
        for item in raw["fields"]:
            row = {k: v for k, v in item.items() if k in known and v is not None}
            row["description"] = " ".join(str(row.get("description", "")).split())
            row["enum"] = tuple(str(v) for v in row.get("enum", ()))
            row["aliases"] = tuple(sorted((str(k), str(v)) for k, v in dict(row.get("aliases", {})).items()))
            if row.get("default") is not None:
                row["default"] = str(row["default"])
            built.append(FieldSpec(**row))
        return SchemaSpec(
            entity=raw["entity"], version=int(raw.get("version", 1)), fields=tuple(built),
            record_identifiers=tuple(raw.get("record_identifiers", ())),
            person_identifier=raw.get("person_identifier"),
        )

    @staticmethod
    def load(path: str) -> "SchemaSpec":
        """Read a spec from JSON, or from YAML where a YAML reader is installed."""
        with open(path, encoding="utf-8") as handle:
            text = handle.read()
        if path.endswith(".json"):
            return SchemaSpec.from_dict(json.loads(text))
        try:
            import yaml
        except ImportError as exc:  # pragma: no cover
            raise ValueError("install a YAML reader or supply the spec as JSON") from exc
        return SchemaSpec.from_dict(yaml.safe_load(text))

    def fields_table(self, spark: SparkSession) -> DataFrame:
        """The contract as a table: one row per target field, in schema order."""
        rows = [
            (i, f.name, f.type, f.description, f.required, f.unique, f.identity, f.format,
             list(f.enum), f.default, f.max_length, f.pii, f.references)
            for i, f in enumerate(self.fields)
        ]
        return spark.createDataFrame(rows, _FIELDS_SCHEMA)


_FIELDS_SCHEMA = T.StructType([
    T.StructField("field_pos", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("required", T.BooleanType(), False),
    T.StructField("unique", T.BooleanType(), False),
    T.StructField("identity", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("enum", T.ArrayType(T.StringType()), False),
    T.StructField("default", T.StringType()),
    T.StructField("max_length", T.IntegerType()),
    T.StructField("pii", T.BooleanType(), False),
    T.StructField("references", T.StringType()),
])


@dataclass(frozen=True)
class Policy:
    """The thresholds results depend on."""

    # column matching
    embedding_weight: float = 0.6
    fuzzy_weight: float = 0.4
    semantic_z_full_scale: float = 2.5
    lexical_floor: float = 0.45
    lexical_rescue: float = 0.70
    mapping_auto_min: float = 0.82
    mapping_margin_min: float = 0.12
    mapping_ignore_max: float = 0.50
    exact_name_is_conclusive: bool = True
    content_penalty: float = 0.45
    unique_min_distinct_ratio: float = 0.5
    vocabulary_share: float = 0.5
    format_min_share: float = 0.1
    type_bonus: float = 0.08
    type_penalty: float = 0.18
    # dates
    date_min_anchors: int = 3
    date_anchor_agreement: float = 0.9
    # vocabulary
    enum_auto_min: float = 90.0
    enum_ask_min: float = 70.0
    enum_mismatch_share: float = 0.5
    enum_mismatch_min_values: int = 4
    # identity
    name_similarity: float = 92.0
    identity_flood_min: int = 10
    identity_flood_rate: float = 0.5
    rehire_gap_days: int = 30
    # validation
    repair_attempts: int = 1
    min_age_at_joining: int = 15
    max_age_at_joining: int = 75
    missing_rate: float = 0.9
    missing_min_records: int = 10
    # batch
    breaker_rate: float = 0.25
    breaker_min_records: int = 8
    breaker_absolute: int = 40
    breaker_min_questions: int = 12
    min_mapping_coverage: float = 0.35
    min_required_found: float = 0.5
    # load
    push_attempts: int = 3
    push_backoff: tuple[float, ...] = (0.5, 1.5, 3.0)
    retryable_status: tuple[int, ...] = (408, 429, 500, 502, 503, 504)
    rejection_flood_min: int = 5
    rejection_flood_rate: float = 0.5
    # physical limits (ours): sizes below which a side may be broadcast, and the
    # longest source list printed inline before the long-form table takes over
    broadcast_rows: int = 200_000
    inline_sources: int = 1_000

    def describe(self, spark: SparkSession) -> DataFrame:
        """The thresholds as data, so nothing has to restate them."""
        rows = [(_GROUP_OF[k], k, json.dumps(v)) for k, v in asdict(self).items() if k in _GROUP_OF]
        return spark.createDataFrame(rows, "group string, name string, value string")


def _group_index(groups: Iterable[tuple[str, str, str]]) -> dict[str, str]:
    order = [f.name for f in dc_fields(Policy)]
    out: dict[str, str] = {}
    for group, first, last in groups:
        for name in order[order.index(first): order.index(last) + 1]:
            out[name] = group
    return out


_GROUP_OF = _group_index([
    ("mapping", "embedding_weight", "type_penalty"),
    ("dates", "date_min_anchors", "date_anchor_agreement"),
    ("values", "enum_auto_min", "enum_mismatch_min_values"),
    ("identity", "name_similarity", "rehire_gap_days"),
    ("validation", "repair_attempts", "missing_min_records"),
    ("batch", "breaker_rate", "min_required_found"),
    ("integration", "push_attempts", "rejection_flood_rate"),
])

DEFAULT_POLICY = Policy()
