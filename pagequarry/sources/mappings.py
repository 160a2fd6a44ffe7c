"""Small documents that the driver reads itself: setups, reviews, scenarios."""

from __future__ import annotations

import json
from pathlib import Path

from .contracts import InvalidInput

try:
    import yaml
except ImportError:  # YAML is optional; JSON always works
    yaml = None


def _yaml(text: str):
    if yaml is None:
        raise InvalidInput("YAML can't be read here")
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise InvalidInput(f"bad YAML: {e}") from e


def _json(text: str):
    try:
        return json.loads(text)
    except ValueError as e:
        raise InvalidInput(f"bad JSON: {e}") from e


def parse_mapping(text: str, suffix: str = "") -> dict:
    """A mapping from YAML or JSON text, by suffix; without a known one YAML is tried, then JSON."""
    if suffix in (".yaml", ".yml"):
        found = _yaml(text)
    elif suffix == ".json":
        found = _json(text)
    else:
        try:
            found = _yaml(text)
        except InvalidInput:
            found = _json(text)
    if not isinstance(found, dict):
        raise InvalidInput("the root must be a mapping")
    return found


def read_mapping(path: str | Path) -> dict:
    path = Path(path)
    if not path.is_file():
        raise InvalidInput(f"no such file: {path}")
    return parse_mapping(path.read_text(encoding="utf-8"), path.suffix.lower())


def dig(document: dict, dotted: str, missing=None):
    """The value at a dotted path, or `missing` where a part of it is absent; a null that is there is None."""
    for part in dotted.split("."):
        if not isinstance(document, dict) or part not in document:
            return missing
        document = document[part]
    return document


def inside(folder: str | Path, path: str | Path) -> Path:
    """path as an absolute path, refused unless it lies in the folder."""
    folder = Path(folder).resolve()
    found = (folder / path).resolve()
    if found != folder and folder not in found.parents:
        raise InvalidInput(f"outside of the run: {path}")
    return found
