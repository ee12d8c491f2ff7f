"""Configuration: text substitution, profiles and validation. Driver-side; no data passes here."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from pathlib import Path

_VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")

#: Allowed values and ranges of settings, by dotted name.
CHOICES = {"qc.union.fusion.mode": ("staged", "or"), "depth.fusion_mode": ("or", "and", "depth_only"), "depth.baseline_method": ("plane", "median")}
RANGES = {"qc.epsilon": (0.0, 1.0), "contract.review_threshold": (0.0, 1.0), "qc.union.fusion.drift_window": (10, 100_000)}


def substituted(text: str, env: Mapping[str, str] | None = None) -> str:
    """``${NAME:-default}`` by the environment; an unset name without default becomes empty."""
    env = os.environ if env is None else env
    return _VARIABLE.sub(lambda m: env.get(m[1]) or (m[2] or ""), text)


def merged(base: dict, over: Mapping) -> dict:
    """``base`` with ``over`` laid on it, dictionaries key by key."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else v
    return out


def load(path: str, profile: str | None = None, env: Mapping[str, str] | None = None) -> dict:
    """A JSON file (YAML where a parser is installed) with its profile of the folder ``profiles`` beside it."""
    read = lambda p: _parse(substituted(Path(p).read_text(encoding="utf-8"), env), p)
    found = read(path)
    if profile:
        found = merged(found, read(Path(path).parent / "profiles" / f"{profile}{Path(path).suffix}"))
    return found


def _parse(text: str, path) -> dict:
    if str(path).endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def setting(config: Mapping, name: str, default=None):
    for part in name.split("."):
        if not isinstance(config, Mapping) or part not in config:
            return default
        config = config[part]
    return config


def problems(config: Mapping) -> list[str]:
    """All settings out of their choices or ranges, not only the first."""
    out = [f"{n}: {v!r} is none of {', '.join(c)}" for n, c in CHOICES.items() if (v := setting(config, n)) is not None and v not in c]
    return out + [f"{n}: {v!r} is not between {lo} and {hi}" for n, (lo, hi) in RANGES.items() if (v := setting(config, n)) is not None and not (isinstance(v, (int, float)) and lo <= v <= hi)]
