"""Limits of a service, checked when they are set."""

from __future__ import annotations

from dataclasses import dataclass, fields

from .errors import EngineError


@dataclass(frozen=True)
class Settings:
    """Studies that are screened and compared at a time, candidates that are listed, and seconds for which a catalogue is current."""

    max_screening: int = 5
    max_comparison: int = 5
    max_listed: int = 50
    catalogue_ttl: int = 30 * 86_400

    def __post_init__(self) -> None:
        for f in fields(self):
            most = 1000 if f.name.startswith("max_") else 1 << 31
            if not 1 <= getattr(self, f.name) <= most:
                raise EngineError("INVALID_SETTING", f"{f.name} is 1 to {most}")
