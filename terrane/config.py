"""Settings from TOML files and the environment."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

FILE = "terrane.toml"
PREFIX = "TERRANE_"


@dataclass
class Settings:
    """`terrane.toml` in the working folder, else in the home folder; TERRANE_<NAME> in the environment comes first."""

    migrations_dir: str = "migrations"
    dialect: str = "oracle"
    question_chunks: int = 6
    naming_pattern: str = "^[a-z0-9_]+$"
    cost_profile: str = "default"
    recursive: bool = True
    gate_level: str = "HIGH_RISK"

    @classmethod
    def load(cls, env: dict[str, str] | None = None, folders: tuple[Path, ...] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        folders = (Path.cwd(), Path.home()) if folders is None else folders
        path = next((d / FILE for d in folders if (d / FILE).exists()), None)
        held = tomllib.loads(path.read_text()) if path else {}
        out = cls()
        for f in fields(cls):
            value = env.get(PREFIX + f.name.upper(), held.get(f.name))
            if value is not None:
                kind = type(getattr(out, f.name))
                setattr(out, f.name, parse_bool(str(value)) if kind is bool else kind(value))
        return out


def parse_bool(text: str) -> bool:
    return text.strip().lower() in ("1", "true", "yes")
