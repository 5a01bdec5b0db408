"""Plug-in registries of column builders: tokenizers, tasks, scorers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    def __init__(self, name: str) -> None:
        self.name = name
        self._entries: dict[str, Any] = {}

    def register(self, key: str) -> Callable[[Any], Any]:
        if key in self._entries:
            raise ValueError(f"{self.name} {key!r} is registered already")

        def add(entry: Any) -> Any:
            self._entries[key] = entry
            return entry

        return add

    def get(self, key: str) -> Any:
        if key not in self._entries:
            raise KeyError(f"unknown {self.name} {key!r}; known: {self.available()}")
        return self._entries[key]

    def available(self) -> list[str]:
        return sorted(self._entries)


tokenizers, tasks, scorers = Registry("tokenizer"), Registry("task"), Registry("scorer")
