"""Resolves a specification against the groups: which drives the rows, what joins it, and on which columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

from panelweave.functions.time import Granularity
from panelweave.model import Group, Spec


class PlanError(ValueError):
    """A specification that cannot be run."""


@dataclass(frozen=True)
class Child:
    """A group on fewer entities. places: per slot the place of each of its key columns, as ('branch', column number)
    or ('leaf', leaf number, column number)."""

    group: Group
    places: tuple[tuple[tuple, ...], ...]

    @property
    def slots(self) -> int:
        return len(self.places)


@dataclass(frozen=True)
class Resolved:
    spec: Spec
    primary: Group
    tops: tuple[Group, ...]
    children: tuple[Child, ...]
    branch: tuple[str, ...]  # key columns of the primary group
    leaf: tuple[str, ...]
    k: int
    variables: Mapping[str, tuple[str, ...]]

    @property
    def unit(self) -> Granularity:
        return self.primary.unit.granularity


def minimum_k(groups: list[Group]) -> dict[str, int]:
    """The least k of each entity that the groups allow."""
    least: dict[str, int] = {}
    for group in groups:
        for entity, n in group.unit.counts.items():
            least[entity] = max(n, least.get(entity, 0))
    return least


def _levels(groups: list[Group]) -> tuple[list[Group], list[Group]]:
    """The groups on the largest set of entities, and those on parts of it."""
    groups = sorted(groups, key=lambda g: -len(g.unit.counts))
    big: Counter = groups[0].unit.counts
    for group in groups:
        counts = group.unit.counts
        if big <= counts:
            big = counts
        elif not counts <= big:
            raise PlanError(f"neither of {dict(big)} and {dict(counts)} contains the other")
    return [g for g in groups if g.unit.counts == big], [g for g in groups if g.unit.counts != big]


def resolve(spec: Spec, groups: Mapping[str, Group]) -> Resolved:
    """Checks the specification and lays out its plan; raises PlanError."""
    variables: dict[str, tuple[str, ...]] = {}
    for code, wanted in spec.select.items():
        group = next((g for c, g in groups.items() if c.casefold() == code.casefold()), None)
        if group is None:
            raise PlanError(f"no such group: {code}")
        by_name = {c.casefold(): c for c in group.table.columns}
        missing = [v for v in wanted if v.casefold() not in by_name]
        if missing:
            raise PlanError(f"{code} has no {missing}")
        variables[group.code] = tuple(by_name[v.casefold()] for v in wanted)
    if not any(variables.values()):
        raise PlanError("no variable is selected")
    if spec.end <= spec.start + 999:
        raise PlanError("the time range is empty")
    tops, below = _levels([groups[c] for c in variables])
    if spec.primary is not None:
        primary = next((g for g in tops if g.code == spec.primary), None)
        if primary is None:
            raise PlanError(f"{spec.primary} is not on the largest unit of analysis")
    elif len({g.unit.granularity for g in tops}) > 1 or len(tops) > 1:
        raise PlanError(f"name the primary group, one of {[g.code for g in tops]}")
    else:
        primary = tops[0]
    if not spec.consolidate and spec.sample is None and primary.unit.granularity is Granularity.NONE:
        raise PlanError("without time granularity there are no single time units; consolidate instead")
    if spec.sample is not None and spec.sample <= 0:
        raise PlanError("the sample is empty")

    inner = primary.unit.counts
    spin = {e: spec.k.get(e, n) for e, n in inner.items()}
    for entity, n in inner.items():
        if spin[entity] < n or spin[entity] % n:
            raise PlanError(f"k of {entity} is {spin[entity]}, not a multiple of {n}")
    several = [e for e, n in inner.items() if spin[e] > n]
    if len(several) > 1:
        raise PlanError(f"only one entity may be multiplied, not {several}")
    many = several[0] if several else None
    k = spin[many] // inner[many] if many else 1
    branch = tuple(c for c, e in primary.keys if e != many)
    leaf = tuple(c for c, e in primary.keys if e == many)

    children = []
    for group in below:
        own = group.unit.counts
        for entity, n in own.items():
            if n not in (1, inner[entity]):
                raise PlanError(f"{group.code}: {entity} occurs {n} times, not once or {inner[entity]} times")
            if n < inner[entity] and many is not None and entity != many:
                raise PlanError(f"{group.code}: only {many} may occur less often than in {primary.code}")
        fewer = [e for e, n in own.items() if n < inner[e]]
        if len(fewer) > 1:
            raise PlanError(f"{group.code}: more than one entity occurs less often than in {primary.code}")
        slots = max(spin[e] // n for e, n in own.items())
        columns = {e: [c for c, x in primary.keys if x == e] for e in inner}
        places = []
        for slot in range(slots):
            seen: Counter = Counter()
            place = []
            for _, entity in group.keys:
                at = (slot * own[entity] if spin[entity] // own[entity] > 1 else 0) + seen[entity]
                seen[entity] += 1
                name = columns[entity][at % inner[entity]]
                place.append(("leaf", at // inner[entity], leaf.index(name)) if entity == many else ("branch", branch.index(name)))
            places.append(tuple(place))
        children.append(Child(group, tuple(places)))
    return Resolved(spec, primary, tuple(g for g in tops if g is not primary), tuple(children), branch, leaf, k, variables)
