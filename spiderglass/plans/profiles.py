"""Profiles and settings: small JSON configuration, no Spark."""

from __future__ import annotations

import json
from pathlib import Path


class Profiles:
    """Named settings in one JSON file; at most one is the default, and the default can't be deleted."""

    def __init__(self, path: str):
        self.path = Path(path)

    def all(self) -> list[dict]:
        return json.loads(self.path.read_text()) if self.path.exists() else []

    def _save(self, rows: list[dict]) -> None:
        part = self.path.with_suffix(".part")
        part.write_text(json.dumps(rows, indent=1))
        part.replace(self.path)

    def _named(self, name: str) -> dict:
        for r in self.all():
            if r["name"] == name:
                return r
        raise KeyError(name)

    def create(self, name: str, values: dict, start_url: str = "") -> dict:
        rows = self.all()
        if any(r["name"] == name for r in rows):
            raise ValueError(f"there is a profile {name}")
        row = {"id": max([0, *[r["id"] for r in rows]]) + 1, "name": name, "schema_version": 1, "values": values, "start_url": start_url, "is_default": not rows}
        self._save([*rows, row])
        return row

    def duplicate(self, name: str, copy: str) -> dict:
        old = self._named(name)
        return self.create(copy, old["values"], old["start_url"])

    def rename(self, name: str, new: str) -> None:
        self._named(name)
        rows = self.all()
        if any(r["name"] == new for r in rows):
            raise ValueError(f"there is a profile {new}")
        self._save([r | {"name": new} if r["name"] == name else r for r in rows])

    def delete(self, name: str) -> None:
        if self._named(name)["is_default"]:
            raise ValueError("the default profile can't be deleted")
        self._save([r for r in self.all() if r["name"] != name])

    def set_default(self, name: str) -> None:
        self._named(name)
        self._save([r | {"is_default": r["name"] == name} for r in self.all()])


def merged_settings(defaults: dict, stored: dict, free: tuple[str, ...] = ("inputs.customHeaders",), at: str = "") -> dict:
    """Stored values over defaults; unknown keys are dropped, but for free-form objects."""
    out = {}
    for key, value in defaults.items():
        path = f"{at}.{key}" if at else key
        have = stored.get(key, value) if isinstance(stored, dict) else value
        if isinstance(value, dict) and path not in free:
            out[key] = merged_settings(value, have if isinstance(have, dict) else {}, free, path)
        else:
            out[key] = have
    return out
