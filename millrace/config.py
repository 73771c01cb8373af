"""Settings with defaults that environment variables override."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


def env(name: str, default: str) -> str:
    """The variable's value; the default where it is unset or empty."""
    return os.environ.get(name) or default


def env_int(name: str, default: int) -> int:
    """As env; the default also where the value isn't an integer."""
    try:
        return int(env(name, str(default)))
    except ValueError:
        return default


@dataclass(frozen=True)
class Config:
    """Everything that changes results or timing."""

    # Window size, key buckets, allowed lateness, ticks without progress before open windows are published.
    window_ms: int = 10_000
    buckets: int = 64
    lateness_ms: int = 1000
    idle_ticks: int = 3
    partitions: int = 6
    trigger_ms: int = 2000
    mode: str = "staged"
    start: str = "earliest"

    @classmethod
    def from_env(cls, prefix: str = "MILLRACE_") -> Config:
        """MILLRACE_WINDOW_MS and so on."""
        return cls(**{f.name: (env_int if isinstance(f.default, int) else env)(prefix + f.name.upper(), f.default) for f in fields(cls)})
