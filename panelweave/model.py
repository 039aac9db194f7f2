"""What a panel is made of: units of analysis, variable groups, and the specification of an output."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from panelweave.functions.time import Granularity
from panelweave.operators.members import MemberSet

#: The default range of an output, in milliseconds.
DEFAULT_RANGE = (-6_857_222_390_000, 7_258_118_400_000)


@dataclass(frozen=True)
class Unit:
    """A unit of analysis: entity types in order, with repeats, and a time granularity."""

    code: str
    entities: tuple[str, ...]
    granularity: Granularity = Granularity.NONE

    @property
    def counts(self) -> Counter:
        return Counter(self.entities)


@dataclass(frozen=True)
class Group:
    """A variable group: a table whose rows are stamped [start, end) in milliseconds and keyed by entities.

    keys: (column, entity) in the unit's order. order: the columns whose values give the import order, on which
    first-wins and last-wins depend; without it, all columns do. Without start and end, rows hold at any time.
    one_unit: every row holds for exactly one unit of the granularity, from boundary to boundary, as imports that name
    a single year, month or day give; such rows need no cutting.
    """

    code: str
    unit: Unit
    table: DataFrame
    keys: tuple[tuple[str, str], ...]
    start: str | None = None
    end: str | None = None
    order: tuple[str, ...] | None = None
    numeric: frozenset[str] = frozenset()
    one_unit: bool = False
    description: str = ""

    def __post_init__(self):
        if tuple(entity for _, entity in self.keys) != self.unit.entities:
            raise ValueError(f"{self.code}: the keys' entities are not those of unit {self.unit.code}")
        for name, kind in self.table.dtypes:
            if kind == "binary":
                raise ValueError(f"{self.code}: binary column {name} is not supported")
            if kind in ("float", "double") and name in self.key_columns:
                raise ValueError(f"{self.code}: key column {name} is floating-point")

    @property
    def key_columns(self) -> tuple[str, ...]:
        return tuple(column for column, _ in self.keys)


@dataclass(frozen=True)
class Spec:
    """An output: which variables of which groups, how many of each entity (k), when, whom, and in which form."""

    select: Mapping[str, Sequence[str]]
    k: Mapping[str, int] = field(default_factory=dict)
    start: int = DEFAULT_RANGE[0]
    end: int = DEFAULT_RANGE[1]
    limits: Mapping[str, Sequence | DataFrame | MemberSet] = field(default_factory=dict)
    consolidate: bool = True
    sample: int | None = None
    seed: int = 0
    show_time: bool = False
    primary: str | None = None
    strict: bool = False

    @staticmethod
    def rounded(ms: int) -> int:
        """A bound as the range picker keeps it: to the nearest 10 seconds."""
        return (ms + 5_000) // 10_000 * 10_000
