"""Settings from the environment, typed and checked."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


class SettingError(ValueError):
    """A setting is missing or out of its range."""


def required(env: Mapping[str, str], name: str) -> str:
    v = env.get(name, "").strip()
    if not v:
        raise SettingError(f"{name} must be set")
    return v


def optional(env: Mapping[str, str], name: str, default: str) -> str:
    return env.get(name, "").strip() or default


def share(env: Mapping[str, str], name: str, default: float) -> float:
    """A number in [0, 1]."""
    raw = optional(env, name, str(default))
    try:
        v = float(raw)
    except ValueError as e:
        raise SettingError(f"{name} must be a number, not {raw!r}") from e
    if not 0.0 <= v <= 1.0:
        raise SettingError(f"{name} must lie in [0, 1], not {v}")
    return v


#: Tables alone, or images beside them; JPEG needs an image library.
FORMATS = ("parquet", "png", "jpg", "jpeg")


@dataclass(frozen=True)
class Settings:
    """What a run of the pipeline needs; stage names are those of ``plans.pipeline``."""

    source_language: str
    target_language: str
    output_dir: str
    detector: str = "ink"
    recognizer: str = "number"
    translator: str = "stub"
    inpainter: str = "none"
    min_quality: float = 0.25
    output_format: str = "parquet"
    model_url: str = ""
    model_name: str = ""

    @staticmethod
    def load(env: Mapping[str, str] | None = None) -> Settings:
        e = os.environ if env is None else env
        fmt = optional(e, "INKGRID_OUTPUT_FORMAT", "parquet").lower()
        if fmt not in FORMATS:
            raise SettingError(f"INKGRID_OUTPUT_FORMAT must be one of {', '.join(FORMATS)}, not {fmt!r}")
        return Settings(
            required(e, "INKGRID_SOURCE_LANGUAGE"),
            required(e, "INKGRID_TARGET_LANGUAGE"),
            required(e, "INKGRID_OUTPUT_DIR"),
            optional(e, "INKGRID_DETECTOR", "ink"),
            optional(e, "INKGRID_RECOGNIZER", "number"),
            optional(e, "INKGRID_TRANSLATOR", "stub"),
            optional(e, "INKGRID_INPAINTER", "none"),
            share(e, "INKGRID_MIN_QUALITY", 0.25),
            fmt,
            optional(e, "INKGRID_MODEL_URL", ""),
            optional(e, "INKGRID_MODEL_NAME", ""),
        )
