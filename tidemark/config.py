"""Names of the key columns, and the errors that operators raise."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


class TidemarkError(Exception):
    """Base of the library's errors."""


class ValidationError(TidemarkError, ValueError):
    """An argument or a column does not fit."""


@dataclass(frozen=True)
class PanelConfig:
    date: str = "date"
    id: str = "bid"


_current = PanelConfig()


def set_columns(*, date: str | None = None, id: str | None = None) -> PanelConfig:
    """Change the default key names; a side left as None stays as it is."""
    global _current
    _current = replace(_current, **{k: v for k, v in (("date", date), ("id", id)) if v is not None})
    return _current


def resolve_columns(date_col: str | None = None, id_col: str | None = None) -> tuple[str, str]:
    """The given names, or the defaults where none is given."""
    return date_col or _current.date, id_col or _current.id


def require_columns(df: DataFrame, columns: Iterable[str | None], context: str = "") -> None:
    """Raise if ``df`` lacks one of ``columns``; None entries are skipped."""
    missing = [c for c in columns if c is not None and c not in df.columns]
    if missing:
        where = f"{context}: " if context else ""
        raise ValidationError(f"{where}missing columns {missing}; available: {df.columns}")


def one_of(name: str, value: object, allowed: Iterable[object]) -> None:
    if value not in (allowed := list(allowed)):
        raise ValidationError(f"{name} must be one of {allowed}, not {value!r}")
