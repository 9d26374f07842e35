"""Extensions: named rules and listeners that are told of results, in order, each on its own."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


class Plugin:
    """Override what is needed; `order` sorts plugins, ties go by name."""

    name, order = "plugin", 100

    def on_result(self, df: DataFrame) -> None: ...

    def on_batch(self, df: DataFrame, number: int) -> None: ...

    def on_close(self) -> None: ...


class Registry:
    def __init__(self) -> None:
        self._plugins: list[Plugin] = []
        self.rules: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, p: Plugin) -> None:
        self._plugins = sorted([*self._plugins, p], key=lambda x: (x.order, x.name))

    def rule(self, name: str) -> Callable:
        """Decorator: a function of bars that gives (code, date, side)."""

        def keep(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
            self.rules[name] = fn
            return fn

        return keep

    def tell(self, event: str, *args) -> dict[str, Exception]:
        """Call `event` on every plugin; one that raises doesn't stop the others. Returns what was raised, by name."""
        failed = {}
        for p in self._plugins:
            try:
                getattr(p, event)(*args)
            except Exception as e:  # noqa: BLE001
                log.exception("plugin %s failed in %s", p.name, event)
                failed[p.name] = e
        return failed

    def signals(self, bars: DataFrame) -> DataFrame | None:
        """(algo, code, date, side) of all rules."""
        from pyspark.sql import functions as F

        out = None
        for name, fn in self.rules.items():
            one = fn(bars).select(F.lit(name).alias("algo"), "code", "date", "side")
            out = one if out is None else out.unionByName(one)
        return out


class Listener:
    """foreachBatch function that tells a registry of each batch."""

    def __init__(self, registry: Registry) -> None:
        self.registry = registry

    def __call__(self, df: DataFrame, number: int) -> None:
        self.registry.tell("on_batch", df, number)
