"""Settings of a run: defaults overlaid by what is configured, and what identifies them."""
from __future__ import annotations

import hashlib
import json
from typing import Any

DEFAULTS: dict[str, Any] = {
    "ingest": {"max_sessions": 200, "min_session_bytes": 256, "since_days": 365, "skip_agents": [], "max_turns": 12, "max_chars": 8_000},
    "cluster": {"attach": 0.88, "offer": 0.60, "recheck": 0.85, "wave": 4},
    "dedupe": {"window": 0.92, "fact": 0.92},
    "link": {"semantic": 0.78, "pairs": 200},
}
PROFILES = ("lean", "standard", "deep")


def merged(base: dict[str, Any], over: dict[str, Any] | None) -> dict[str, Any]:
    """``base`` with the values of ``over``: dictionaries key by key, all else whole; a null leaves what was there."""
    out = dict(base)
    for k, v in (over or {}).items():
        if v is not None:
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def settings(over: dict[str, Any] | None = None) -> dict[str, Any]:
    """The settings of a run; an unknown section or key is an error."""
    for section, values in (over or {}).items():
        unknown = set(values or {}) - set(DEFAULTS.get(section, ()))
        if section not in DEFAULTS or unknown:
            raise ValueError(f"unknown settings: {section} {sorted(unknown)}")
    return merged(DEFAULTS, over)


def fingerprint(config: dict[str, Any]) -> str:
    """16 hex digits that differ between different settings, whatever the order of their keys."""
    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def model_ref(ref: str) -> tuple[str, str]:
    """(provider, model) of ``provider:model``; the model may hold colons."""
    provider, colon, model = ref.partition(":")
    if not (colon and provider and model):
        raise ValueError(f"not provider:model: {ref!r}")
    return provider, model


def profile(name: str | None, default: str = "standard") -> str:
    """A known profile, in any case."""
    p = (name or default).strip().lower()
    if p not in PROFILES:
        raise ValueError(f"unknown profile {name!r}")
    return p
