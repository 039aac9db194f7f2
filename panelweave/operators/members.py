"""Sets of members as bits: one row for each 64 neighbouring numbers, so that set operations meet few and small rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _word(number: Column) -> Column:
    return F.shiftright(number.cast("long"), 6)


def _bit(number: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(number.cast("long"), F.lit(64)).cast("int"))


@dataclass(frozen=True)
class MemberSet:
    """A set of whole numbers. words: ``word`` (number div 64) and ``bits``, one row for each word that has any."""

    words: DataFrame

    @classmethod
    def of(cls, numbers: DataFrame) -> MemberSet:
        """The set of a table's first column; nulls and what is no number are left out, repeats count once."""
        number = F.col(numbers.columns[0]).try_cast("long")
        some = numbers.select(number.alias("_n")).where("_n is not null")
        return cls(some.groupBy(_word(F.col("_n")).alias("word")).agg(F.bit_or(_bit(F.col("_n"))).alias("bits")))

    def union(self, other: MemberSet) -> MemberSet:
        return MemberSet(self.words.unionByName(other.words).groupBy("word").agg(F.bit_or("bits").alias("bits")))

    def _with(self, other: MemberSet, how: str) -> DataFrame:
        return self.words.join(other.words.withColumnsRenamed({"word": "_word", "bits": "_bits"}), F.col("word") == F.col("_word"), how)

    def minus(self, other: MemberSet) -> MemberSet:
        left = self._with(other, "left").select("word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_bits", F.lit(0).cast("long")))).alias("bits"))
        return MemberSet(left.where("bits <> 0"))

    def both(self, other: MemberSet) -> MemberSet:
        return MemberSet(self._with(other, "inner").select("word", F.col("bits").bitwiseAND(F.col("_bits")).alias("bits")).where("bits <> 0"))

    def size(self) -> DataFrame:
        """One row: how many members there are."""
        return self.words.agg(F.coalesce(F.sum(F.bit_count("bits").cast("long")), F.lit(0).cast("long")).alias("members"))

    def numbers(self, name: str = "member") -> DataFrame:
        """The members, one a row."""
        each = self.words.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("at"))
        return each.where(F.getbit("bits", F.col("at")) == 1).select((F.col("word") * 64 + F.col("at")).alias(name))

    def flagged(self, rows: DataFrame, column: str, flag: str) -> DataFrame:
        """rows with ``flag``: whether the column's value is a member."""
        words, number = self.words.withColumnsRenamed({"word": "_word", "bits": "_bits"}), F.col(column).try_cast("long")
        met = rows.join(words, _word(number) == F.col("_word"), "left")
        return met.withColumn(flag, F.coalesce(F.getbit("_bits", F.pmod(number, F.lit(64)).cast("int")) == 1, F.lit(False))).drop("_word", "_bits")
