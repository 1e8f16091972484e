"""The map from MIME type to chunking method, kept as a TOML file that people may edit."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

from ..functions.fixed import METHODS

FILE = "chunker_map.toml"


def write_toml(path: str, methods: dict[str, str]) -> None:
    quoted = (f'"{k}" = "{v}"' for k, v in methods.items())
    Path(path).write_text("[methods]\n" + "\n".join(quoted) + "\n")


def load_or_create(folder: str) -> dict[str, str]:
    """What the file in ``folder`` says; the defaults are written if there is none."""
    path = os.path.join(folder, FILE)
    if not os.path.exists(path):
        os.makedirs(folder, exist_ok=True)
        write_toml(path, METHODS)
    return tomllib.loads(Path(path).read_text())["methods"]
