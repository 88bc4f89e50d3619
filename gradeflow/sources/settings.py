"""Settings: a validated tree, read from YAML or built in code. Unknown keys are refused at every level."""

from __future__ import annotations

from pathlib import Path
from typing import Literal

from pydantic import BaseModel, ConfigDict, Field


class _Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Splits(_Strict):
    """Sizes and seed of a seeded split."""

    dataset: str = "question_answer"
    seed: int = 42
    train: int = Field(512, ge=0)
    holdout: int = Field(128, ge=0)
    test: int = Field(256, ge=0)


class Transform(_Strict):
    """A penalty transform and its strength."""

    kind: Literal["identity", "exp", "softplus", "clipped_exp"] = "exp"
    beta: float = 1.0


class Report(_Strict):
    """Which runs a report looks at."""

    runs_root: str = "outputs"
    providers: list[str] = Field(default_factory=list)
    datasets: list[str] = Field(default_factory=list)
    seeds: list[int] = Field(default_factory=list)
    inspection_rows: int = Field(16, ge=0)


class Settings(_Strict):
    """All settings of a run."""

    splits: Splits = Field(default_factory=Splits)
    transform: Transform = Field(default_factory=Transform)
    report: Report = Field(default_factory=Report)


def read_settings(path: str) -> Settings:
    """From YAML; an empty file has all defaults."""
    import yaml

    return Settings.model_validate(yaml.safe_load(Path(path).read_text()) or {})


def write_settings(settings: Settings, path: str) -> None:
    """As YAML, keys in order."""
    import yaml

    Path(path).write_text(yaml.safe_dump(settings.model_dump(), sort_keys=False))


def overrides(pairs: list[str]) -> dict[str, str]:
    """key=value pairs, split at the first sign and trimmed."""
    out = {}
    for p in pairs:
        key, sign, value = p.partition("=")
        if not sign:
            raise ValueError(f"no '=' in {p!r}")
        out[key.strip()] = value.strip()
    return out
