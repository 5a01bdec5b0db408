"""Experiment configuration: layered files, overrides and checks.  Plain driver-side Python."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


def load_file(path: str) -> dict[str, Any]:
    """A JSON file, or YAML where a YAML library is installed; an empty file is an empty mapping."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("YAML files need a YAML library; use JSON") from error
        return yaml.safe_load(text) or {}
    return json.loads(text) if text.strip() else {}


def deep_merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """base with over on top; mappings are merged, everything else is replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = deep_merge(out[key], value) if isinstance(out.get(key), dict) and isinstance(value, dict) else value
    return out


def load_config(base: str | None, experiment: str | None, overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """base, then the experiment, then overrides; keys of `experiment:` that are missing at the top move there."""
    out: dict[str, Any] = {}
    for layer in (load_file(base) if base else {}, load_file(experiment) if experiment else {}, overrides or {}):
        out = deep_merge(out, layer)
    for key, value in (out.get("experiment") or {}).items():
        out.setdefault(key, value)
    check_phases(out.get("training", {}).get("phases", {}))
    return out


def check_phases(phases: dict[str, dict[str, Any]]) -> None:
    """Positive steps, a lone wildcard, lists of datasets; a supervised phase stops early."""
    for name, phase in phases.items():
        if not phase.get("enabled", True):
            continue
        if phase.get("steps", 1) <= 0:
            raise ValueError(f"{name}: steps must be positive")
        parts = phase.get("trainable_parameters", ["*"])
        if not parts or "*" in parts and len(parts) > 1:
            raise ValueError(f"{name}: trainable_parameters is a list of parts, or the wildcard alone")
        if isinstance(phase.get("datasets"), str):
            phase["datasets"] = [phase["datasets"]]
        if name == "sft" and not phase.get("early_stopping"):
            raise ValueError("sft: early_stopping is needed")
