"""What a named analysis view is, and how one is chosen for the tables at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


class Tables(Mapping):
    """Tables of a recording by name, looked up without regard to case."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self._held = {name.lower(): (name, df) for name, df in tables.items()}

    def __getitem__(self, name: str) -> DataFrame:
        return self._held[name.lower()][1]

    def __iter__(self) -> Iterator[str]:
        return (name for name, _ in self._held.values())

    def __len__(self) -> int:
        return len(self._held)

    def __contains__(self, name: object) -> bool:
        return str(name).lower() in self._held

    def has(self, names) -> bool:
        return all(n in self for n in names)


Builder = Callable[[Tables], DataFrame | None]


@dataclass(frozen=True)
class View:
    """A view needs all tables of ``requires`` and, where given, one of ``any_of``. Alternatives need other tables."""

    name: str
    category: str
    title: str
    requires: tuple[str, ...]
    build: Builder
    any_of: tuple[str, ...] = ()
    alternatives: tuple[tuple[tuple[str, ...], Builder], ...] = field(default=())

    def choose(self, tables: Tables) -> Builder | None:
        """The builder whose tables are all there; of several the one that uses most tables."""
        if tables.has(self.requires) and (not self.any_of or any(n in tables for n in self.any_of)):
            return self.build
        fit = [(len(names), build) for names, build in self.alternatives if tables.has(names)]
        return max(fit, key=lambda x: x[0])[1] if fit else None

    def frame(self, tables: Tables) -> DataFrame | None:
        """The view over these tables, or None where they don't suffice."""
        build = self.choose(tables)
        return build(tables) if build else None


VIEWS: dict[str, View] = {}


def view(name: str, category: str, title: str, *requires: str, any_of: tuple[str, ...] = (), alternatives=()):
    """Register the decorated builder."""

    def add(build: Builder) -> Builder:
        VIEWS[name] = View(name, category, title, requires, build, any_of, tuple(alternatives))
        return build

    return add
