"""Settings of the message engine, with defaults and environment overrides (prefix ``QUILLON_``)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """The defaults decide results, so they are stated as they must be."""

    languages: tuple[str, ...] = ("pt", "en")
    min_text_chars: int = 2
    max_text_chars: int = 5000
    negation_window: int = 3
    max_intents: int = 3
    min_confidence: float = 0.3
    min_script_share: float = 0.85
    min_language_share: float = 0.55
    min_language_margin: float = 0.15
    mixed_language_ratio: float = 0.25

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Settings:
        """Values that don't parse raise ValueError with the variable's name; languages are stripped, lowered, kept once."""
        env, out = os.environ if env is None else env, {}
        for f in fields(Settings):
            name = f"QUILLON_{f.name.upper()}"
            if name not in env:
                continue
            raw = env[name]
            if f.name == "languages":
                value = tuple(dict.fromkeys(x.strip().lower() for x in raw.split(",") if x.strip()))
                if not value:
                    raise ValueError(f"{name} names no language")
                out[f.name] = value
            else:
                try:
                    out[f.name] = type(f.default)(raw)
                except ValueError:
                    raise ValueError(f"{name} must be a number, not {raw!r}") from None
        return Settings(**out)
