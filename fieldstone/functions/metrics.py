"""Metrics of queries and commits: filter complexity, durations, errors, row counts.

Sessions record ``query``, ``load`` and ``save`` as commands, and ``query_rows`` and ``save_rows``.
"""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fieldstone.plans.filters import complexity


@dataclass
class Metrics:
    """Counts and sums by name; ``enabled`` off costs nothing."""

    enabled: bool = True
    count: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    total: dict[str, float] = field(default_factory=lambda: defaultdict(float))

    def add(self, name: str, value: float = 1.0) -> None:
        if self.enabled:
            self.count[name] += 1
            self.total[name] += value

    def filter(self, doc: dict) -> dict:
        """Records a filter's complexity and gives it back."""
        self.add("filter_complexity", complexity(doc))
        return doc

    @contextmanager
    def command(self, name: str) -> Iterator[None]:
        """Records an action's duration and errors."""
        began = time.perf_counter()
        try:
            yield
        except Exception:
            self.add(f"{name}_errors")
            raise
        finally:
            self.add(f"{name}_seconds", time.perf_counter() - began)

    def observed(self, rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
        """Rows whose count the next action on them also delivers, without another job."""
        seen = Observation(name)
        return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen
