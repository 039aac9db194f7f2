"""Granulated outputs made unit by unit, so that a run that was stopped goes on with the units that are not yet written.

Each group's rows are written once in partitions by the primary group's units of time (a row once for each unit that it
touches), so that the job of some units reads their partitions only. The output is partitioned by unit too: a job
overwrites just the partitions of its units, and notes them as finished when it has ended.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.functions.time import after, align_down, pieces
from panelweave.model import Group, Spec
from panelweave.plans.analyze import PlanError, resolve
from panelweave.plans.engine import Plan

UNIT = "_unit"


class UnitRun:
    """The granulated output of a specification at ``path``, made in jobs of ``each`` units."""

    def __init__(self, spec: Spec, groups: Mapping[str, Group] | Sequence[Group], path: str, each: int = 12):
        self.groups = dict(groups) if isinstance(groups, Mapping) else {g.code: g for g in groups}
        resolved = resolve(spec, self.groups)
        if spec.consolidate or spec.sample is not None:
            raise PlanError("only granulated outputs of all k-ads are made unit by unit")
        self.spec, self.path, self.each, self.unit = spec, path.rstrip("/"), each, resolved.unit
        self.primary, self.spark = resolved.primary.code, resolved.primary.table.sparkSession
        whole = Plan(resolved)
        self.start, self.end = whole.start, whole.end

    def _there(self, name: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def stage(self) -> None:
        """Writes the rows of each group with time in partitions by unit, unless that was done before."""
        for code in self.spec.select:
            group = self.groups[code]
            if group.start is None or self._there(f"facts/{code}"):
                continue
            s, e = (F.col(c).cast("long") for c in (group.start, group.end))
            inside = group.table.where((s < self.end) & (e > self.start) & (s < e))
            touched = F.transform(pieces(F.greatest(s, F.lit(self.start)), F.least(e, F.lit(self.end)), self.unit), lambda p: align_down(p["s"], self.unit))
            rows = inside.withColumn(UNIT, F.explode(touched)).repartition(UNIT, F.pmod(F.xxhash64(*group.key_columns), F.lit(8)))
            rows.write.mode("overwrite").partitionBy(UNIT).parquet(f"{self.path}/facts/{code}")

    def _facts(self, code: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/facts/{code}")

    def _facts_of(self, code: str, units: list[int]) -> DataFrame:
        """A group's rows that touch any of these units, once each."""
        group, rows = self.groups[code], self._facts(code).where((F.col(UNIT) >= units[0]) & (F.col(UNIT) <= units[-1])).drop(UNIT)
        # A row that touches several of these units is there for each; one that holds for a single unit has no copies to drop.
        return rows if group.one_unit and group.unit.granularity is self.unit else rows.distinct()

    def finished(self) -> set[int]:
        return {r[0] for r in self.spark.read.parquet(f"{self.path}/finished").select(UNIT).distinct().collect()} if self._there("finished") else set()

    def pending(self) -> list[int]:
        """The starts of the units that the primary group has rows for and that are not finished; partitions alone tell."""
        have = {r[0] for r in self._facts(self.primary).select(UNIT).distinct().collect()}
        return sorted(have - self.finished())

    def run(self, jobs: int | None = None) -> None:
        """Makes what is pending, in at most so many jobs."""
        self.stage()
        todo = self.pending()
        batches = [todo[i : i + self.each] for i in range(0, len(todo), self.each)]
        for batch in batches[:jobs]:
            self._make(batch)

    def _make(self, units: list[int]) -> None:
        end = self.spark.range(1).select(after(F.lit(units[-1]).cast("long"), self.unit)).first()[0]
        groups = {}
        for code in self.spec.select:
            group = self.groups[code]
            if group.start is not None:
                group = replace(group, table=self._facts_of(code, units))
            groups[code] = group
        spec = replace(self.spec, start=max(units[0], self.start), end=min(end, self.end))
        plan = Plan(resolve(spec, groups))
        rows = plan.rows().withColumn(UNIT, align_down(F.col("_a"), self.unit)).where(F.col(UNIT).isin(units))
        plan.shown(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(UNIT).parquet(f"{self.path}/output")
        self.spark.createDataFrame([(u,) for u in units], f"{UNIT} long").coalesce(1).write.mode("append").parquet(f"{self.path}/finished")

    def output(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/output").drop(UNIT)
