"""Settings of a slowly changing dimension, their sources and their checks."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import types as T

from .functions.lists import get_config_value, is_array, list_difference, list_intersection

#: Settings that only the project has, not the single model.
PROJECT_ONLY = ("update_all_previous_records", "collapse_redundant_versions", "default_valid_to", "default_valid_from", "exclude_data_after_run_start")


# Beginnings of messages that callers match on.
WRONG_TYPE = "scd_type must be 0, 1 or 2 for the scd materialization"
NO_DELETIONS = "deletion tracking is not supported for SCD types 0 and 1"


class ConfigError(ValueError):
    """A setting is missing, contradictory or does not fit the data."""


@dataclass(frozen=True)
class ScdConfig:
    """``unique_key`` is the business key. With ``updated_at_column`` it identifies a version.

    ``incremental_predicates`` are SQL conditions that a match in a merge must meet besides the key; they
    see the stored row as ``destination_alias`` and the computed one as ``source_alias``.
    ``audit_timestamp``: ``match_source`` gives ``valid_from`` and ``valid_to`` the type of
    ``updated_at_column``; ``timestamp`` makes them instants in the session's zone.
    ``null_safe_keys`` lets null keys match in types 0 and 1 (type 2 always does);
    ``recompute_valid_from`` lets a late first version correct the one that was first before.
    """

    unique_key: list[str]
    scd_type: int = 2
    is_current_column: str = "_is_current"
    valid_from_column: str = "_valid_from"
    valid_to_column: str = "_valid_to"
    updated_at_column: str = "_updated_at"
    change_type_column: str = "_change_type"
    created_at_column: str | None = None
    deleted_at_column: str | None = None
    change_columns: Mapping[str, list[str]] | None = None
    scd_check_columns: list[str] | None = None
    exclude_columns_from_change_check: list[str] | None = None
    update_all_previous_records: bool = True
    collapse_redundant_versions: bool = True
    default_valid_to: str = "2999-12-31 23:59:59"
    default_valid_from: str = "1900-01-01 00:00:00"
    exclude_data_after_run_start: bool = False
    incremental_predicates: list[str] = field(default_factory=list)
    destination_alias: str = "DEST"
    source_alias: str = "SOURCE"
    loaded_at_column: str = "_loaded_at"
    audit_timestamp: str = "match_source"
    null_safe_keys: bool = False
    recompute_valid_from: bool = False

    def __post_init__(self) -> None:
        if isinstance(self.scd_type, bool) or str(self.scd_type) not in ("0", "1", "2"):
            raise ConfigError(f"{WRONG_TYPE}, got: {self.scd_type}")
        object.__setattr__(self, "scd_type", int(self.scd_type))
        if self.unique_key is None or (is_array(self.unique_key) and not list(self.unique_key)):
            raise ConfigError("unique_key is missing or empty: name the columns of the business key")
        if not is_array(self.unique_key):
            raise ConfigError(f"unique_key takes a list of column names, got: {self.unique_key!r}")
        object.__setattr__(self, "unique_key", list(self.unique_key))
        if self.deleted_at_column and self.scd_type != 2:
            raise ConfigError(f"deleted_at_column is set, but {NO_DELETIONS} (got type {self.scd_type})")
        if self.audit_timestamp not in ("match_source", "timestamp"):
            raise ConfigError(f"audit_timestamp must be match_source or timestamp, got: {self.audit_timestamp}")
        if self.scd_type == 2 and not self.update_all_previous_records:
            warnings.warn("update_all_previous_records is false: this assumes that no data arrives late, and may give a key several versions of change type I", stacklevel=3)
            if self.collapse_redundant_versions:
                warnings.warn("collapse_redundant_versions needs update_all_previous_records: redundant versions are retained", stacklevel=3)

    @classmethod
    def resolve(cls, config: Mapping[str, Any], variables: Mapping[str, Any] | None = None, scd_type: int | None = None) -> "ScdConfig":
        """From a model's settings (its ``meta`` block first), then the project's variables, then defaults."""
        variables = variables or {}
        found = {}
        for f in fields(cls):
            value = variables.get(f.name) if f.name in PROJECT_ONLY else get_config_value(config, f.name, variables.get(f.name))
            if value is not None:
                found[f.name] = value
        if scd_type is not None:
            found["scd_type"] = scd_type
        return cls(**({"unique_key": None} | found))

    @property
    def collapse(self) -> bool:
        return self.collapse_redundant_versions and self.update_all_previous_records

    @property
    def audit_columns(self) -> list[str]:
        return [self.is_current_column, self.valid_from_column, self.valid_to_column, self.change_type_column]

    def check_columns(self, schema: T.StructType) -> None:
        """Whether a model with ``schema`` has the columns that the settings name."""
        have = {n.upper() for n in schema.names}
        for name, column in (("created_at_column", self.created_at_column), ("deleted_at_column", self.deleted_at_column)):
            if column and column.upper() not in have:
                raise ConfigError(f"{name} names '{column}', which the rows lack. They have: {', '.join(schema.names)}")
        for column in [*self.unique_key, self.updated_at_column]:
            if column.upper() not in have:
                raise ConfigError(f"the rows lack column '{column}'. They have: {', '.join(schema.names)}")
        if self.scd_type == 2 and isinstance(next(f.dataType for f in schema.fields if f.name.upper() == self.updated_at_column.upper()), T.DateType):
            warnings.warn(f"{self.updated_at_column} is a DATE: a TIMESTAMP is recommended, or changes within a day are one version", stacklevel=3)

    def business_columns(self, names: list[str]) -> list[str]:
        return list_difference(names, self.audit_columns, case_insensitive=True)

    def tracked_columns(self, names: list[str]) -> list[str]:
        """The columns whose change makes a version: those included (or all), less those excluded, the key,
        ``updated_at`` and the audit columns."""
        if self.change_columns is not None:
            include, exclude = self.change_columns.get("include"), self.change_columns.get("exclude")
        else:
            include, exclude = self.scd_check_columns, self.exclude_columns_from_change_check
        base = list_intersection(names, include, case_insensitive=True) if include else names
        tracked = list_difference(base, [*(exclude or []), self.updated_at_column, *self.unique_key, *self.audit_columns], case_insensitive=True)
        if not tracked:
            raise ConfigError("no column is left to track changes of, once the key, updated_at and the excluded columns are taken out")
        if any(c.upper() == self.loaded_at_column.upper() for c in tracked):
            warnings.warn(f"{self.loaded_at_column} is tracked, so that each load makes a version; exclude it from change tracking", stacklevel=3)
        return tracked
