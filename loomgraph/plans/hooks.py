"""Plugins and hooks: callables that see or change a build's tables between its stages."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order of a build.
STAGES = ("this_compilation", "compilation", "finish_modules", "process_assets", "done")


class Hooks:
    """Taps of each stage, called one after the other in the order they were added."""

    def __init__(self) -> None:
        self._taps: dict[str, list[tuple[str, Callable]]] = {stage: [] for stage in STAGES}

    def tap(self, stage: str, name: str, call: Callable[[Any], Any]) -> None:
        self._taps[stage].append((name, call))

    def call(self, stage: str, value: Any) -> Any:
        """What the taps make of the value; one that returns None leaves it."""
        for _, call in self._taps[stage]:
            changed = call(value)
            value = value if changed is None else changed
        return value


def apply_plugins(hooks: Hooks, plugins: Iterable[Any]) -> Hooks:
    """Each plugin in turn: a function of the hooks or an object with ``apply``; None, False, 0 and "" are skipped."""
    for i, plugin in enumerate(plugins):
        if plugin is None or (isinstance(plugin, bool | int | str) and not plugin):
            continue
        run = getattr(plugin, "apply", None) or plugin
        if not callable(run):
            raise TypeError(f"plugin {i} is neither a function nor has it apply")
        run(hooks)
    return hooks


def emit_assets(assets: DataFrame, new: DataFrame) -> DataFrame:
    """assets(filename, content) with new ones added or put in place of those of the same name."""
    return assets.join(new.select("filename"), "filename", "left_anti").unionByName(new.select(*assets.columns))


def missing_assets(assets: DataFrame, names: DataFrame) -> DataFrame:
    """(filename) that an update names but no asset has: such an update is an error."""
    return names.select("filename").distinct().join(assets.select("filename"), "filename", "left_anti")


def update_assets(assets: DataFrame, changes: DataFrame) -> DataFrame:
    """assets with the contents of changes(filename, content); check :func:`missing_assets` first."""
    new = changes.select("filename", F.col("content").alias("_new"), F.lit(True).alias("_has"))
    content = F.when(F.col("_has"), F.col("_new")).otherwise(F.col("content")).alias("content")
    return assets.join(new, "filename", "left").select(*(content if c == "content" else c for c in assets.columns))
