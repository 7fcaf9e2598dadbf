"""What can be plugged in, as protocols over DataFrames and columns, and registries to plug it in by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


@runtime_checkable
class Retriever(Protocol):
    def query(self, queries: DataFrame, k: int, same_owner: bool = True) -> DataFrame: ...
    def insert(self, cells: DataFrame) -> None: ...
    def remove(self, ids: DataFrame) -> None: ...
    def __len__(self) -> int: ...


class CellSource(Protocol):
    """Tokens of cells on demand: late materialisation of candidates (cell_id)."""

    def tokens(self, ids: DataFrame) -> DataFrame: ...


class Refinement(Protocol):
    """Given queries and cells, the k best (query_id, rank, cell_id, owner, score)."""

    def __call__(self, queries: DataFrame, cells: DataFrame, k: int, **options) -> DataFrame: ...


class Quantizer(Protocol):
    def quantize(self, v: Column) -> Column: ...
    def restore(self, q: Column) -> Column: ...


class Capture(Protocol):
    """A text's retrieval key: a column of vectors."""

    def __call__(self, text: Column) -> Column: ...


class Hook(Protocol):
    """What a generating model reports (layer, state) to a keep decision with a salience, and what it may be given before."""

    def on_generate(self, states: DataFrame) -> DataFrame: ...
    def on_prefill(self, states: DataFrame) -> DataFrame: ...


class Framing(Protocol):
    def __call__(self, text: Column) -> Column: ...


class Adapter(Protocol):
    """A system under test: items in, (query_id, rank, text) out."""

    def ingest(self, items: DataFrame) -> None: ...
    def query(self, items: DataFrame, k: int) -> DataFrame: ...
    def reset(self) -> None: ...
    def metadata(self) -> dict[str, str]: ...


class Dataset(Protocol):
    def items(self) -> DataFrame: ...


class Evaluator(Protocol):
    def __call__(self, expected: Column, answer: Column) -> Column: ...


class Registry:
    """Implementations by name; names are compared in lower case, and a name is given once unless `replace` is said."""

    def __init__(self, what: str):
        self.what, self._by_name = what, {}

    def add(self, name: str, made: Callable, replace: bool = False) -> Callable:
        if name.lower() in self._by_name and not replace:
            raise ValueError(f"there is a {self.what} {name!r} already")
        self._by_name[name.lower()] = made
        return made

    def __getitem__(self, name: str) -> Callable:
        found = self._by_name.get(name.lower())
        if found is None:
            raise ValueError(f"unknown {self.what} {name!r}; known are {sorted(self._by_name)}")
        return found

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._by_name

    def names(self) -> list[str]:
        return sorted(self._by_name)


class StoredCells:
    """A CellSource over a table of cells."""

    def __init__(self, cells: DataFrame):
        self.cells = cells

    def tokens(self, ids: DataFrame) -> DataFrame:
        """(cell_id, owner, tokens) of the ids that are there; only their rows leave the scan's side of the join."""
        return self.cells.join(ids.select("cell_id").distinct(), "cell_id", "left_semi").select("cell_id", "owner", "tokens")
