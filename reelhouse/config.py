"""Tunables of the media library, with a TOML loader."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from datetime import datetime
from pathlib import Path


class ConfigError(ValueError):
    """A configuration file holds a key that isn't known."""


@dataclass(frozen=True)
class Config:
    """Extension sets hold lower-case suffixes with their dot.

    ``max_year`` is an explicit bound, so that a plan made again later gives the same dates; None takes
    next year when a plan is made. ``time_zone`` is the zone in which modification times are read.
    """

    near_dupe_threshold: int = 5
    burst_window_s: int = 10
    min_year: int = 1990
    max_year: int | None = None
    slug_max: int = 40
    exiftool_batch: int = 200
    time_zone: str = "UTC"
    provenance_prefix: str = "source: "
    # The extensions of each kind.
    image_ext: frozenset[str] = frozenset({".bmp", ".gif", ".heic", ".heif", ".jpeg", ".jpg", ".png", ".tif", ".tiff", ".webp"})
    raw_ext: frozenset[str] = frozenset(
        {".arw", ".cr2", ".cr3", ".dng", ".nef", ".orf", ".pef", ".raf", ".rw2", ".srw", ".x3f"}
    )
    video_ext: frozenset[str] = frozenset({".3gp", ".avi", ".m2ts", ".m4v", ".mov", ".mp4", ".mpeg", ".mpg", ".mts", ".wmv"})
    sidecar_ext: frozenset[str] = frozenset({".aae", ".thm", ".xmp"})
    #: Formats that metadata is embedded in; all others get a sidecar file.
    embed_ext: frozenset[str] = frozenset({".heic", ".heif", ".jpeg", ".jpg", ".png", ".tif", ".tiff"})

    @property
    def last_year(self) -> int:
        return datetime.now().year + 1 if self.max_year is None else self.max_year


def load_config(workdir: str | Path, name: str = "reelhouse.toml") -> Config:
    """The configuration in ``workdir``, or the defaults if there is none; an unknown key is an error."""
    path = Path(workdir) / name
    if not path.exists():
        return Config()
    values = tomllib.loads(path.read_text("utf-8"))
    kinds = {f.name: f for f in fields(Config)}
    unknown = sorted(values.keys() - kinds.keys())
    if unknown:
        raise ConfigError(f"{path.name}: unknown keys {', '.join(unknown)}; known: {', '.join(sorted(kinds))}")
    return Config(**{k: frozenset(v) if k.endswith("_ext") else v for k, v in values.items()})
