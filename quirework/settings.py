"""Settings from the environment, read at each call; bad values fall back to the default."""

from __future__ import annotations

import os
from dataclasses import dataclass

PREFIX = "QUIREWORK_"


def _number(name: str, default: float, least: float = 0) -> float:
    try:
        value = float(os.environ.get(PREFIX + name, ""))
    except ValueError:
        return default
    return value if value >= least else default


@dataclass(frozen=True)
class Settings:
    backend: str = "stub"
    timeout_s: float = 180.0
    local_slots: int = 2
    remote_slots: int = 4

    @staticmethod
    def read() -> Settings:
        return Settings(os.environ.get(PREFIX + "BACKEND", "stub"), _number("TIMEOUT", 180.0, 0.001), int(_number("LOCAL_SLOTS", 2, 1)), int(_number("REMOTE_SLOTS", 4, 1)))
