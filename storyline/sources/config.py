"""Configuration files: sources, topics, clustering, presets, includes and overlays (driver side)."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.stories import ClusterConfig

# Names that source types go by, and what a source has that says nothing.
TYPE_ALIASES = {"hn_algolia": "hn", "hacker_news": "hn"}
WEIGHT, CATEGORY, KIND = 0.2, "community", "rss"


@dataclass(frozen=True)
class SourceConfig:
    id: str
    name: str
    url: str | None = None
    weight: float = WEIGHT
    category: str = CATEGORY
    type: str = KIND


@dataclass
class Config:
    sources: list[SourceConfig] = field(default_factory=list)
    topics: dict = field(default_factory=dict)
    clustering: ClusterConfig = field(default_factory=ClusterConfig)
    search_key: str | None = None


def slug(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")


def _source(raw: dict) -> SourceConfig:
    name = str(raw.get("name") or raw.get("id") or "")
    kind = raw.get("type", KIND)
    return SourceConfig(raw.get("id") or slug(name) or "source", name, raw.get("url"), float(raw.get("weight", WEIGHT)), raw.get("category", CATEGORY), TYPE_ALIASES.get(kind, kind))


def load_config(path: str | Path, presets: str | Path | None = None) -> Config:
    """The file's configuration: its sources, else its preset's, then those that its includes add under new ids."""
    import yaml

    path = Path(path)
    raw = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    listed = raw.get("sources") or raw.get("feeds") or []
    if not listed and presets and (preset := raw.get("preset")) and preset != "blank":
        file = (Path(presets) / f"{preset}.yaml").resolve()
        if Path(presets).resolve() not in file.parents:
            raise ValueError(f"preset outside the folder: {preset!r}")
        if file.exists():
            found = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
            listed = found.get("sources") or found.get("feeds") or []
        else:
            warnings.warn(f"no preset {preset!r}", stacklevel=2)
    sources = [_source(s) for s in listed]
    known = {s.id for s in sources}
    for other in raw.get("includes") or []:
        try:
            # An absolute path stands for itself.
            extra = yaml.safe_load((path.parent / Path(other).expanduser()).read_text(encoding="utf-8")) or {}
            for s in map(_source, extra.get("sources") or extra.get("feeds") or []):
                if s.id not in known:
                    known.add(s.id)
                    sources.append(s)
        except (OSError, yaml.YAMLError, AttributeError, TypeError) as problem:
            warnings.warn(f"include {other!r} skipped: {problem}", stacklevel=2)
    names = ClusterConfig.__dataclass_fields__
    clustering = ClusterConfig(**{k: v for k, v in (raw.get("clustering") or {}).items() if k in names})
    return Config(sources, raw.get("topics") or {}, clustering, raw.get("tavily_api_key"))


def apply_overlay(config: dict, overlay: dict) -> dict:
    """The older form: feeds added and removed by name, topics added (replacing) and removed, plain values set."""
    out = dict(config)
    gone = set(overlay.get("remove_feeds") or [])
    out["feeds"] = [f for f in config.get("feeds", []) if f.get("name") not in gone] + list(overlay.get("add_feeds") or [])
    topics = {k: v for k, v in (config.get("keywords") or {}).items() if k not in set(overlay.get("remove_keywords") or [])}
    out["keywords"] = topics | (overlay.get("add_keywords") or {})
    out |= {k: overlay[k] for k in ("max_items", "schedule_time", "timezone") if k in overlay}
    return out


def legacy_config(path: str | Path, presets: str | Path | None = None) -> dict:
    """The older pipeline's configuration: the file itself, or its preset with the file's additions and removals."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    base = {}
    if presets and (preset := raw.get("preset")) and preset != "blank":
        file = (Path(presets) / f"{preset}.yaml").resolve()
        if Path(presets).resolve() not in file.parents:
            raise ValueError(f"preset outside the folder: {preset!r}")
        base = yaml.safe_load(file.read_text(encoding="utf-8")) or {}
    return apply_overlay(base, raw) if base or "add_feeds" in raw else raw
