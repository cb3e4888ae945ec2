"""Settings of a run: from arguments, the environment, a file and defaults, in this order for each key."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from pathlib import Path

PREFIX = "SHROUDLINE_"


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    provider: str = "local"
    model: str = "default"
    max_retries: int = 2
    retry_backoff: float = 1.0
    retry_backoff_multiplier: float = 2.0
    pages_per_batch: int = 1
    layout_aware: bool = False
    include_text: bool = False
    retention_hours: int = 720


_LEAST = {"max_retries": 0, "retry_backoff": 0.0, "retry_backoff_multiplier": 1.0, "pages_per_batch": 1, "retention_hours": 0}


def _typed(name: str, kind: str, value):
    if kind == "bool":
        if isinstance(value, bool):
            return value
        if str(value).lower() in ("true", "1", "yes", "false", "0", "no"):
            return str(value).lower() in ("true", "1", "yes")
    elif kind == "str":
        if isinstance(value, str):
            return value
    elif not isinstance(value, bool):
        try:
            out = int(str(value)) if kind == "int" else float(value)
        except ValueError:
            out = None
        if out is not None and out >= _LEAST[name]:
            return out
    raise ConfigError(f"{name}: {value!r} is no valid {kind}" + (f" from {_LEAST[name]} on" if name in _LEAST else ""))


def resolve(arguments: Mapping[str, object] | None = None, env: Mapping[str, str] | None = None, path: str | None = None) -> tuple[Config, dict[str, str]]:
    """The settings, and where each came from. An empty text counts as not given; an unknown key of the file is an error."""
    arguments, env = arguments or {}, os.environ if env is None else env
    stored = tomllib.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    names = {f.name: f.type for f in fields(Config)}
    if unknown := set(stored) - set(names):
        raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
    values, origin = {}, {}
    for name, kind in names.items():
        layers = (("argument", arguments.get(name)), ("environment", env.get(PREFIX + name.upper())), ("file", stored.get(name)))
        where, value = next(((w, v) for w, v in layers if v not in (None, "")), ("default", None))
        origin[name] = where
        values[name] = getattr(Config, name) if where == "default" else _typed(name, kind, value)
    return Config(**values), origin


def write(config: Config, path: str) -> None:
    """Write the settings as TOML, whole or not at all."""
    show = lambda v: str(v).lower() if isinstance(v, bool) else f'"{v}"' if isinstance(v, str) else repr(v)
    temp = Path(f"{path}.tmp")
    temp.write_text("".join(f"{k} = {show(v)}\n" for k, v in asdict(config).items()))
    temp.replace(path)
