"""Settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Where the tables are, how often sources are crawled, how long archived events stay, and who geocoders may write to."""

    database_url: str = ""
    sync_interval_seconds: int = 12 * 3600
    archive_retention_days: int = 2
    nominatim_contact: str = ""

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        """Values of the upper-case names; those that are unset or empty keep their defaults, and one that is no number is an error."""
        env = os.environ if env is None else env
        given = {k: env[k.upper()] for k in cls.__dataclass_fields__ if env.get(k.upper())}
        return cls(**{k: int(v) if isinstance(getattr(cls, k), int) else v for k, v in given.items()})
