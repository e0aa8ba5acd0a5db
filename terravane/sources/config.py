"""Configuration of a pipeline: nested settings, overrides, validation, registry."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from pathlib import PurePosixPath
from typing import Any

#: reconstruction methods that a configuration may name (fixed values)
METHODS = ("feature-splatting", "rade-features", "rade-gs", "splatfacto")


class ValidationError(ValueError):
    """A configuration that can't be run."""


def deep_merge(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; dictionaries are merged, all else replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def coerce(text: str) -> Any:
    """Booleans and numbers as such; all else stays text."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    try:
        return float(text) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text) else text
    except ValueError:
        return text


def parse_overrides(pairs: Sequence[str]) -> dict:
    """``a.b=1`` as nested dictionaries; only the first ``=`` counts."""
    out: dict = {}
    for pair in pairs:
        if "=" not in pair:
            raise ValidationError(f"{pair!r} is not key=value")
        key, value = pair.split("=", 1)
        node = out
        *path, last = key.split(".")
        for part in path:
            node = node.setdefault(part, {})
        node[last] = coerce(value)
    return out


def validate(config: dict, exists: Callable[[str], bool] = lambda _: True) -> dict:
    """Required settings, a known method, a source that exists, and defaults."""
    for name in ("file_path", "method"):
        if not config.get(name):
            raise ValidationError(f"{name} is required")
    if config["method"] not in METHODS:
        raise ValidationError(f"unknown method {config['method']!r}; one of {METHODS}")
    path = str(config["file_path"])
    if not exists(path):
        raise ValidationError(f"{path} doesn't exist")
    out = {"frame_proportion": 0.25, "min_frames": 300} | config
    if not out.get("output_path"):  # also where it is present but empty
        out["output_path"] = str(PurePosixPath(path).parent / "environment" / PurePosixPath(path).stem)
    return out


def list_datasets(paths: Sequence[str]) -> list[str]:
    """Sorted stems of the data set files."""
    return sorted(PurePosixPath(p).stem for p in paths if p.endswith(".yaml"))


def select_run(paths: Sequence[str], choice: int | None = None) -> str:
    """A run by its place in sorted order; the last one if none is chosen."""
    runs = sorted(paths)
    if not runs:
        raise ValueError("there is no run")
    return runs[-1 if choice is None else choice]


class Registry:
    """Named extractors; a name may have aliases."""

    def __init__(self) -> None:
        self._found: dict[str, Any] = {}

    def register(self, *names: str) -> Callable:
        def add(item: Any) -> Any:
            for n in names:
                self._found[n] = item
            return item

        return add

    def get(self, name: str) -> Any:
        if name not in self._found:
            raise ValueError(f"unknown name {name!r}; one of {sorted(self._found)}")
        return self._found[name]

    def names(self) -> list[str]:
        return sorted(self._found)


EXTRACTORS = Registry()
#: width of the features that each extractor's tables have
EXTRACTORS.register("samclip", "clip-vit")({"space": "text", "width": 512})
EXTRACTORS.register("dinov2")({"space": "image", "width": 384})
