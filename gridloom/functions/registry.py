"""Named functions of columns: defaults, overrides that reach what they replace, calls by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Body = Callable[..., Column]


class Registry:
    """Functions by name and number. A missing argument is 0. An override is given the function before it as its first argument."""

    def __init__(self) -> None:
        self._chain: dict[str, list[tuple[Body, int]]] = {}
        self._numbers: dict[int, str] = {}

    def add(self, name: str, params: int, body: Body, number: int | None = None) -> None:
        if name in self._chain:
            raise ValueError(f"{name} is there already; override it")
        self._chain[name] = [(body, params)]
        self._numbers[max(self._numbers, default=0) + 1 if number is None else number] = name

    def override(self, name: str, params: int, body: Body) -> None:
        if name not in self._chain:
            raise KeyError(name)
        self._chain[name].append((body, params))

    def call(self, name: str | int, *args: Column) -> Column:
        """Call by name or by number."""
        return self._call(self._numbers[name] if isinstance(name, int) else name, -1, args)

    def _call(self, name: str, level: int, args: tuple[Column, ...]) -> Column:
        chain = self._chain[name]
        level = len(chain) + level if level < 0 else level
        body, params = chain[level]
        full = [*args[:params], *[F.lit(0).cast("long")] * (params - len(args))]
        return body(lambda *more: self._call(name, level - 1, more), *full) if level else body(*full)

    def dispatch(self, which: Column, *args: Column) -> Column:
        """The function whose number each row names; null where there is none."""
        out = F.lit(None).cast("long")
        for number, name in sorted(self._numbers.items()):
            out = F.when(which == number, self.call(name, *args)).otherwise(out)
        return out

    def names(self) -> dict[int, str]:
        return dict(self._numbers)
