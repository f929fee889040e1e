"""What is done with modules of each type, and taps around the parsing of a source."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.javascript import SCHEMA, _arrow, extract

Step = Callable[[DataFrame], DataFrame]
#: In the order of their calls.
PHASES = ("program", "finish")


class ModuleTypes:
    """A parser and a generator, functions of tables, for each module type, and which type a path has."""

    def __init__(self) -> None:
        self._steps: dict[str, tuple[Step, Step]] = {}
        self._rules: list[tuple[str, Callable[[Column], Column]]] = []
        self._default: str | None = None

    def register(self, kind: str, parse: Step, generate: Step) -> None:
        if kind in self._steps:
            raise ValueError(f"module type {kind} is registered already")
        self._steps[kind] = parse, generate

    def rule(self, kind: str, fits: Callable[[Column], Column]) -> None:
        """Paths that fit are of this type; of several rules the first counts."""
        self._rules.append((kind, fits))

    def default(self, kind: str) -> None:
        if self._default is not None:
            raise ValueError(f"{self._default} is the default type already")
        self._default = kind

    def type_of(self, path: Column) -> Column:
        """The type of a path; null without a rule or default, as for a null path."""
        fits = [F.when(fit(path), kind) for kind, fit in self._rules]
        return F.when(path.isNotNull(), F.coalesce(*fits, F.lit(self._default).cast("string")))

    def unregistered(self, modules: DataFrame) -> DataFrame:
        """modules(module_type, ...) of no type that is registered: each is an error."""
        known = F.col("module_type").isin(*self._steps) if self._steps else F.lit(False)
        return modules.where(~F.coalesce(known, F.lit(False)))

    def _each(self, modules: DataFrame, step: int) -> DataFrame:
        if not self._steps:
            raise ValueError("no module type is registered")
        return reduce(DataFrame.unionByName, (f[step](modules.where(F.col("module_type") == kind)) for kind, f in self._steps.items()))

    def parse(self, modules: DataFrame) -> DataFrame:
        return self._each(modules, 0)

    def generate(self, modules: DataFrame) -> DataFrame:
        return self._each(modules, 1)


class ParserHooks:
    """Taps on each source: program before its dependencies are read, finish with what was found; both return rows or None to leave them."""

    def __init__(self) -> None:
        self.taps: dict[str, list[tuple[str, bytes, Callable]]] = {phase: [] for phase in PHASES}

    def tap(self, phase: str, name: str, key: bytes, call: Callable[[str, list[dict]], list[dict] | None]) -> None:
        """key: changes with what the tap does."""
        self.taps[phase].append((name, key, call))

    def fingerprint(self) -> str:
        """Equal for the same taps in the same order; lengths are counted in, so that neighbours can't run together."""
        state = hashlib.sha256()
        for phase in PHASES:
            state.update(f"{phase}:{len(self.taps[phase])};".encode())
            for name, key, _ in self.taps[phase]:
                for part in (name.encode(), key):
                    state.update(b"%d:" % len(part) + part)
        return state.hexdigest()

    def run(self, source: str | None) -> list[dict]:
        rows: list[dict] = []
        for phase in PHASES:
            for _, _, call in self.taps[phase]:
                changed = call(source or "", rows)
                rows = rows if changed is None else changed
            if phase == "program":
                rows = rows + extract(source)
        return rows


def hooked_dependencies(modules: DataFrame, hooks: ParserHooks) -> DataFrame:
    """As the extractor's table of modules(module_id, source), with the hooks' rows; the hooks go to the workers with the task."""
    schema = _arrow(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for module, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += [{**r, "module_id": module, "dep_index": i} for i, r in enumerate(hooks.run(source))]
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return modules.select("module_id", "source").mapInArrow(run, SCHEMA)
