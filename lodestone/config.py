"""Settings: defaults, then a JSON file, then environment variables."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass

from lodestone.errors import ConfigError

PREFIX = "LODESTONE_"


@dataclass
class Paths:
    home: str = "~/.lodestone"
    index: str = "~/.lodestone/index"
    history: str = "~/.lodestone/history.json"
    session: str = "~/.lodestone/session.json"


@dataclass
class Search:
    limit: int = 100
    max_bytes: int = 100 << 20
    snippet: int = 150
    semantic_files: int = 1000
    semantic_limit: int = 20


@dataclass
class Limits:
    query_rows: int = 1000
    agent_rows: int = 100
    sample_rows: int = 20
    found_files: int = 200
    search_hits: int = 50


@dataclass
class Watch:
    debounce_ms: int = 500
    poll_ms: int = 100
    keep_log: int = 1000


@dataclass
class Config:
    log_level: str = "warning"
    threads: int = 0
    ignore: list[str] = field(default_factory=lambda: ["node_modules", "target", "__pycache__"])
    paths: Paths = field(default_factory=Paths)
    search: Search = field(default_factory=Search)
    limits: Limits = field(default_factory=Limits)
    watch: Watch = field(default_factory=Watch)

    @staticmethod
    def load(path: str | None = None, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        path = os.path.expanduser(path or env.get(PREFIX + "CONFIG", "~/.lodestone/config.json"))
        out = Config()
        if os.path.exists(path):
            try:
                with open(path, encoding="utf-8") as f:
                    out._update(json.load(f))
            except ValueError as e:
                raise ConfigError(f"not JSON: {path}: {e}") from e
        for key, name in (("LOG", "log_level"), ("THREADS", "threads"), ("HOME", "paths.home"), ("INDEX", "paths.index")):
            if PREFIX + key in env:
                out.set(name, env[PREFIX + key])
        return out

    def _update(self, values: dict, prefix: str = "") -> None:
        for k, v in values.items():
            if isinstance(v, dict):
                self._update(v, f"{prefix}{k}.")
            else:
                self.set(prefix + k, v)

    def _at(self, key: str) -> tuple[object, str]:
        *folders, name = key.split(".")
        at: object = self
        for f in folders:
            at = getattr(at, f, None)
        if not is_dataclass(at) or name not in {f.name for f in fields(at)}:
            raise ConfigError(f"no such setting: {key}")
        return at, name

    def get(self, key: str) -> object:
        at, name = self._at(key)
        return getattr(at, name)

    def set(self, key: str, value: object) -> None:
        at, name = self._at(key)
        old = getattr(at, name)
        try:
            new = int(value) if isinstance(old, int) else [x.strip() for x in value.split(",")] if isinstance(old, list) and isinstance(value, str) else value
        except (TypeError, ValueError):
            raise ConfigError(f"{key} takes a number, not {value}") from None
        setattr(at, name, new)

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)


def configure_logging(level: str = "warning", quiet: bool = False, verbose: bool = False) -> int:
    """Quiet goes before verbose. Returns the level set."""
    chosen = logging.ERROR if quiet else logging.DEBUG if verbose else getattr(logging, level.upper(), logging.WARNING)
    logging.getLogger("lodestone").setLevel(chosen)
    return chosen
