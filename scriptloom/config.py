"""Configuration files: YAML or JSON, whose values may come from the environment."""

from __future__ import annotations

import contextlib
import json
import os
from collections.abc import Mapping
from pathlib import Path
from typing import Any


def typed(text: str) -> Any:
    """true and false (any case), whole numbers and decimal numbers as such; other texts stay."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        with contextlib.suppress(ValueError):
            return kind(text)
    return text


def resolved(value: Any, environment: Mapping[str, str] = os.environ) -> Any:
    """value with texts of the form ${NAME} or ${NAME:-default} replaced, at any depth, by the environment's value, typed.

    Without a default a variable that isn't set gives the empty text. Other texts stay as they are, numbers in quotes too.
    """
    match value:
        case dict():
            return {k: resolved(v, environment) for k, v in value.items()}
        case list():
            return [resolved(v, environment) for v in value]
        case str() if value[:2] == "${" and value[-1] == "}":
            name, _, default = value[2:-1].partition(":-")
            return typed(environment.get(name, default))
    return value


def load(path: str | None = None, environment: Mapping[str, str] = os.environ) -> dict[str, Any]:
    """The settings in a file, by default the one that CONFIG_PATH names, else config.yaml. A missing file is an error."""
    file = Path(path or environment.get("CONFIG_PATH") or "config.yaml")
    text = file.read_text(encoding="utf-8")
    if file.suffix == ".json":
        found = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ImportError("YAML files need PyYAML; JSON files don't") from e
        found = yaml.safe_load(text)
    if not isinstance(found or {}, dict):
        raise ValueError(f"{file} doesn't hold named settings")
    return resolved(found or {}, environment)
