"""The report as JSON."""

from __future__ import annotations

import json
import os


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, default=str) + "\n"


def put(path: str, text: str) -> None:
    """Write a text file, with the folders it needs."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text)
