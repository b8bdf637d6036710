"""Declarations of tables and rollups, read from YAML and checked before anything runs.

A directory holds ``tables/*.yaml`` (one table each) and ``gold_mappings.yaml``. Unknown keys are ignored, missing ones
and bad references raise ``ConfigError`` with the file's name.
"""

from __future__ import annotations

from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path
from typing import Any

HISTORY_KINDS = ("SCD2", "SCD1", "none")
#: Columns that every bronze and silver table has beside its own.
BATCH_COLUMNS = ("batch_id", "load_timestamp")
METADATA_COLUMNS = (*BATCH_COLUMNS, "_bronze_ingest_timestamp", "_source_file")
VALIDITY_COLUMNS = ("effective_start_date", "effective_end_date", "is_current")
OPEN_END = "9999-12-31"


class ConfigError(Exception):
    """A declaration that cannot be used."""


def _known(cls, raw: dict, where: str):
    names = {f.name for f in fields(cls)}
    missing = [f.name for f in fields(cls) if f.default is MISSING and f.default_factory is MISSING and f.name not in raw]
    if missing:
        raise ConfigError(f"{where}: missing {', '.join(missing)}")
    return cls(**{k: v for k, v in raw.items() if k in names})


@dataclass
class TableSpec:
    """One table: its keys, columns, rules, and how its history is kept. ``primary_key`` may name several columns."""

    table_name: str
    sequence: int
    primary_key: str | list[str]
    scd_type: str = "none"
    expected_file_format: dict[str, Any] = field(default_factory=dict)
    tracked_columns: list[str] = field(default_factory=list)
    mandatory_columns: list[str] = field(default_factory=list)
    foreign_keys: dict[str, str] = field(default_factory=dict)
    business_rules: dict[str, dict] = field(default_factory=dict)
    date_columns: list[str] = field(default_factory=list)
    #: [{column, parent column, key}]: a date here that must not lie before one of the parent's.
    date_relationships: list[dict] = field(default_factory=list)
    source_path: str = ""
    volume_folder: str = ""
    bronze_target: str = ""
    silver_target: str = ""
    gold_target: str | None = None
    effective_start_col: str | None = None
    effective_end_col: str | None = None
    is_current_col: str | None = None

    def __post_init__(self) -> None:
        for name in ("tracked_columns", "mandatory_columns", "date_columns", "date_relationships"):
            setattr(self, name, list(getattr(self, name) or []))
        for name in ("foreign_keys", "business_rules", "expected_file_format"):
            setattr(self, name, dict(getattr(self, name) or {}))
        if self.scd_type not in HISTORY_KINDS:
            raise ConfigError(f"{self.table_name}: scd_type {self.scd_type!r} is none of {', '.join(HISTORY_KINDS)}")

    @property
    def keys(self) -> list[str]:
        return [self.primary_key] if isinstance(self.primary_key, str) else list(self.primary_key)

    @property
    def key_label(self) -> str:
        return ", ".join(self.keys)

    @property
    def headers(self) -> list[str]:
        return list(self.expected_file_format.get("expected_headers", []))

    @property
    def validity(self) -> tuple[str, str, str]:
        """Start, end and current column of a table with versions."""
        return tuple(own or default for own, default in zip((self.effective_start_col, self.effective_end_col, self.is_current_col), VALIDITY_COLUMNS))

    @property
    def versioned(self) -> bool:
        return self.scd_type == "SCD2"

    def rules(self) -> list[tuple[str, dict]]:
        return [(c, r) for c, r in self.business_rules.items() if isinstance(r, dict)]

    @property
    def decimal_columns(self) -> list[str]:
        return [c for c, r in self.rules() if "min" in r or "max" in r]

    @property
    def silver_columns(self) -> list[str]:
        return [*self.headers, *METADATA_COLUMNS, *(self.validity if self.versioned else ())]

    def parents(self) -> list[tuple[str, str, str]]:
        """(column, parent table, parent column) of each foreign key, in order."""
        return [(c, *ref.split(".", 1)) for c, ref in self.foreign_keys.items()]


@dataclass
class RollupSpec:
    """One gold table."""

    gold_table: str
    source_tables: list[str]
    aggregation_type: str
    group_by_columns: list[str] = field(default_factory=list)
    aggregate_columns: list[dict] = field(default_factory=list)
    reconciliation_rule: str = ""


@dataclass
class Catalogue:
    """All declarations, tables in sequence order: parents come before what refers to them."""

    tables: list[TableSpec]
    rollups: list[RollupSpec] = field(default_factory=list)

    def table(self, name: str) -> TableSpec:
        for t in self.tables:
            if t.table_name == name:
                return t
        raise ConfigError(f"no table {name!r}; there are {', '.join(t.table_name for t in self.tables)}")


#: Names of measures (column, function) that name none themselves.
MEASURE_NAMES = {("claim_amount", "sum"): "total_claim_amount", ("claim_id", "count"): "claim_count"}
#: Date relationships of tables that declare none.
DATE_RELATIONSHIPS = {("claims", "policy_id"): {"column": "claim_date", "parent_column": "policy_start_date", "foreign_key": "policy_id"}}


def checked(tables: list[TableSpec], rollups: list[RollupSpec] = ()) -> Catalogue:
    names = {t.table_name for t in tables}
    for t in tables:
        for column, ref in t.foreign_keys.items():
            if "." not in ref or ref.split(".", 1)[0] not in names:
                raise ConfigError(f"{t.table_name}: foreign key {column} refers to an unknown table in {ref!r}")
        t.date_relationships = t.date_relationships or [r for (name, column), r in DATE_RELATIONSHIPS.items() if name == t.table_name and column in t.foreign_keys]
    return Catalogue(sorted(tables, key=lambda t: t.sequence), list(rollups))


def load_catalogue(directory: str | Path) -> Catalogue:
    import yaml

    directory = Path(directory)
    folder = directory / "tables"
    files = [*sorted(folder.glob("*.yaml")), *sorted(folder.glob("*.yml"))]
    if not files:
        raise ConfigError(f"no table declarations in {folder}")
    tables = []
    for f in files:
        raw = yaml.safe_load(f.read_text(encoding="utf-8")) or {}
        try:
            tables.append(_known(TableSpec, raw, f.name))
        except TypeError as e:
            raise ConfigError(f"{f.name}: {e}") from e
    mappings = directory / "gold_mappings.yaml"
    if not mappings.is_file():
        return checked(tables)
    raw = yaml.safe_load(mappings.read_text(encoding="utf-8")) or {}
    return checked(tables, [_known(RollupSpec, r, mappings.name) for r in raw.get("gold_tables", [])])
