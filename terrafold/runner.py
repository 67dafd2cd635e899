"""Stages of a run: order by needs, resume, force, selection, dry run, and a manifest."""

from __future__ import annotations

import fnmatch
import json
import platform
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyspark
from pyspark.sql import DataFrame, SparkSession

from .sources.readers import optional
from .sources.writers import read_text, write_table, write_text


@dataclass
class Stage:
    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    seconds: float = 0.0  # estimate


@dataclass
class Runner:
    """Runs stages into folder/<stage>; a stage with a table there is read, not run, unless forced."""

    spark: SparkSession
    folder: str
    stages: list[Stage]
    settings: dict = field(default_factory=dict)

    def order(self, only: str | None = None) -> list[Stage]:
        """Stages in the order of their needs; ``only`` is a pattern of names."""
        by, out, seen = {s.name: s for s in self.stages}, [], set()

        def visit(name: str, above: tuple[str, ...] = ()) -> None:
            if name in above:
                raise ValueError(f"stages need each other: {' -> '.join([*above, name])}")
            if name in seen:
                return
            for n in by[name].needs:
                visit(n, (*above, name))
            seen.add(name)
            out.append(by[name])

        for s in self.stages:
            visit(s.name)
        return [s for s in out if only is None or fnmatch.fnmatch(s.name, only)]

    def table(self, name: str) -> DataFrame | None:
        done = read_text(self.spark, f"{self.folder}/{name}.json")
        return optional(self.spark, f"{self.folder}/{name}") if done else None

    def plan(self, only: str | None = None, force: bool = False, workers: int = 1) -> dict:
        """What a run would do: its stages and, longest first on so many workers, how long."""
        todo = [s for s in self.order(only) if force or self.table(s.name) is None]
        ends = [0.0] * workers
        for s in sorted(todo, key=lambda s: -s.seconds):
            ends[ends.index(min(ends))] += s.seconds
        return {"stages": [s.name for s in todo], "seconds": max(ends)}

    def __call__(self, only: str | None = None, force: bool = False) -> dict:
        started, timings, failed = time.time(), {}, []
        manifest = {"settings": self.settings, "spark": pyspark.__version__, "python": platform.python_version(), "complete": False}
        for s in self.order(only):
            if not force and self.table(s.name) is not None:
                continue
            tables = {n: self.table(n) for n in s.needs}
            if missing := [n for n, t in tables.items() if t is None]:
                raise RuntimeError(f"{s.name} needs the stage {missing[0]}; run it first")
            began = time.time()
            write_table(s.run(self.spark, tables), f"{self.folder}/{s.name}", {"stage": s.name, **self.settings})
            timings[s.name] = round(time.time() - began, 3)
        manifest |= {"timings": timings, "failed": failed, "seconds": round(time.time() - started, 3), "complete": all(self.table(s.name) is not None for s in self.stages)}
        write_text(self.spark, f"{self.folder}/manifest.json", json.dumps(manifest, indent=1))
        return manifest
