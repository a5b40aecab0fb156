"""Filters by name: functions from DataFrame to DataFrame that a user adds and a job chooses.

The start of a name tells when a filter runs: main filters come before the erasing of marks, post filters after.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Filter = Callable[[DataFrame], DataFrame]
# How names of main and of post filters begin.
MAIN, POST = "メイン_", "ポスト_"


class Filters:
    """A registry; names are unique."""

    def __init__(self) -> None:
        self._known: dict[str, Filter] = {}

    def add(self, name: str, function: Filter) -> None:
        if not name.startswith((MAIN, POST)):
            raise ValueError(f"{name} begins neither with {MAIN} nor with {POST}")
        if name in self._known:
            raise ValueError(f"{name} is there already")
        self._known[name] = function

    def names(self, start: str) -> list[str]:
        return sorted(name for name in self._known if name.startswith(start))

    def run(self, frames: DataFrame, main: str | None, post: str | None, erase: Filter | None = None) -> DataFrame:
        """The main filter, the erasing of marks and the post filter, each where it is given; a name that isn't known is a KeyError."""
        for step in (self._known[main] if main else None, erase, self._known[post] if post else None):
            frames = frames.transform(step) if step else frames
        return frames
