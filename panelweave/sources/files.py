"""CSV imports with declared schemas, rejects and time ranges; appends, refreshes and CSV outputs."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.ranges import MAPPINGS
from panelweave.functions.time import form_of, parse_as
from panelweave.functions.validation import checked

#: The type names of a header's third row.
TYPES = {"int": T.IntegerType(), "int32": T.IntegerType(), "int64": T.LongType(), "string": T.StringType(), "float": T.DoubleType(), "double": T.DoubleType()}
START, END = "DATETIME_ROW_START", "DATETIME_ROW_END"  # fixed values: default names of the time columns
LONGEST_LINE = 262_144


@dataclass(frozen=True)
class Header:
    """The columns of a file in order: names, descriptions and Spark types."""

    names: tuple[str, ...]
    descriptions: tuple[str, ...]
    kinds: tuple[T.DataType, ...]
    rows: int

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, k, True, {"comment": d} if d else {}) for n, k, d in zip(self.names, self.kinds, self.descriptions)])


def read_header(spark: SparkSession, path: str, sep: str = ",", quote: str = '"', descriptions: bool = False, kinds: bool = False, declared: Mapping[str, str] | None = None) -> Header:
    """The names in the first line, and descriptions and types in those after it if they are there."""
    count = 1 + descriptions + kinds
    # Of a folder's files the first by name tells; all of them have the same header.
    place = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    name = place.agg(F.min("file_path")).first()[0]
    lines = [row["value"] for row in place.where((F.col("file_path") == name) & (F.col("file_block_start") == 0)).limit(count).collect()]
    if len(lines) < count:
        raise ValueError(f"{path} has fewer than {count} header rows")
    split = lambda line: spark.range(1).select(fields(F.lit(line), sep, quote).alias("x")).first()["x"]
    names = [checked(n, "column") for n in split(lines[0])]
    if len({n.casefold() for n in names}) != len(names):
        raise ValueError(f"{path} has a column name twice")
    told = split(lines[1]) if descriptions else [""] * len(names)
    typed = [k.lower() for k in split(lines[count - 1])] if kinds else [(declared or {}).get(n, "string") for n in names]
    if len(typed) != len(names):
        raise ValueError(f"{path} has {len(names)} columns and {len(typed)} types")
    unknown = [k for k in typed if k not in TYPES]
    if unknown:
        raise ValueError(f"{path} has unknown types {unknown}")
    return Header(tuple(names), tuple((told + [""] * len(names))[: len(names)]), tuple(TYPES[k] for k in typed), count)


@dataclass(frozen=True)
class Imported:
    """Accepted rows, and rejected ones as their text with the reason."""

    rows: DataFrame
    rejects: DataFrame
    judged: DataFrame
    columns: tuple[Column, ...]

    def saved(self, path: str, mode: str = "overwrite") -> dict[str, int]:
        """Writes the accepted rows as Parquet; how many lines were read, bad and written, counted by this very write."""
        lines, kept = Observation(), Observation()
        seen = self.judged.observe(lines, F.count(F.lit(1)).alias("read"), F.count("_reason").alias("bad"))
        rows = seen.where("_reason is null").select(*self.columns).observe(kept, F.count(F.lit(1)).alias("written"))
        rows.write.mode(mode).parquet(path)
        return {**lines.get, **kept.get}

    def counts(self) -> DataFrame:
        """One row: how many lines were good and bad, in one pass over the file."""
        good = F.col("_reason").isNull()
        return self.judged.agg(F.count(F.when(good, 1)).alias("good"), F.count(F.when(~good, 1)).alias("bad"))


def fields(line: Column, sep: str = ",", quote: str = '"') -> Column:
    """The fields of a line as an array of texts.

    quote: the mark around fields that may hold separators, or ``either`` for single and double ones, also within one
    line. What stands between a closing mark and the next separator is discarded; a backslash takes the next character
    as it is; blanks around a field are trimmed.
    """
    at = "\\t" if sep == "\t" else re.escape(sep)
    marks = ('"', "'") if quote == "either" else (quote,)
    forms = [rf"{m}([^{m}\\]*+(?:\\.[^{m}\\]*+)*+){m}[^{at}]*+" for m in marks]
    blank = r"\x20*+" if sep == "\t" else r"\s*+"
    pattern = f"(?s){at}{blank}(?:{'|'.join(forms)}|([^{at}\\\\]*+(?:\\\\.[^{at}\\\\]*+)*+))"

    def text(token: Column) -> Column:
        found = F.trim(F.regexp_extract(token, pattern, len(marks) + 1))
        for i, m in enumerate(marks):
            found = F.when(token.rlike(rf"^{at}{blank}{m}[^{m}\\]*+(?:\\.[^{m}\\]*+)*+{m}"), F.regexp_extract(token, pattern, i + 1)).otherwise(found)
        return F.regexp_replace(found, r"(?s)\\(.)", "$1")

    return F.transform(F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(pattern), F.lit(0)), text)


def _field(text: Column, kind: T.DataType) -> Column:
    """A trimmed field as its type: an empty number is 0, anything that does not parse is null."""
    text = F.trim(text)
    if isinstance(kind, T.StringType):
        return text
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast(kind)).otherwise(text.try_cast(kind))


def read_csv(
    spark: SparkSession,
    path: str,
    header: Header,
    keys: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    renamed: Mapping[str, str] | None = None,
    constants: Mapping[str, object] | None = None,
    time_range: tuple[str, Sequence[str]] | None = None,
    sep: str = ",",
    quote: str = '"',
    one_form: bool = False,
) -> Imported:
    """Reads a file under its header.

    Rows with a field that does not parse, an empty key or no time range are rejected. time_range names a mapping of
    ``functions.ranges`` and its columns. For sep and quote see ``fields``. Further output columns come from ``constants``.
    one_form: each column of dates has one form, the one that most of its texts fit (found in a pass of its own), and
    dates of other forms are rejected; otherwise each date is read by the form that fits it.
    """
    lines = spark.read.text(path).select(F.col("value").alias("_line"), F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    # The header rows are the first lines of each file; only the first split of a file can hold them.
    first = lines.groupBy("_file").agg(F.min("_at").alias("_first"))
    body = lines.join(F.broadcast(first), "_file").where((F.col("_at") >= F.col("_first") + header.rows) & (F.trim("_line") != ""))
    short = F.char_length("_line") <= LONGEST_LINE
    # A generator keeps the filter on rejects from being pushed below, where each test would split the line again.
    parsed = body.select("_line", F.explode(F.array(F.when(short, fields(F.col("_line"), sep, quote)))).alias("_f"))
    at = {n: F.get("_f", F.lit(i)) for i, n in enumerate(header.names)}
    kinds = dict(zip(header.names, header.kinds))
    wanted = list(columns or header.names)
    typed = {n: _field(at[n], kinds[n]) for n in wanted}
    reason = F.when(F.col("_f").isNull(), "line too long").when(F.size("_f") != len(header.names), "wrong number of fields")
    for n in wanted:
        reason = reason.when(typed[n].isNull() & ~F.lit(isinstance(kinds[n], T.StringType)), f"{n} does not parse")
    for n in keys:
        reason = reason.when(F.coalesce(F.trim(at[n]), F.lit("")) == "", f"{n} is empty")
    out = {(renamed or {}).get(n, n): column for n, column in typed.items()} | {n: F.lit(x) for n, x in (constants or {}).items()}
    if time_range:
        texts = [F.nullif(F.trim(at[n]), F.lit("")) for n in time_range[1]]
        own = {}
        if one_form:
            if not time_range[0].endswith("_texts"):
                raise ValueError(f"{time_range[0]} has no date forms")
            forms = [form_of(parsed.select(x.alias("_text")).where("_text is not null"), "_text") for x in texts]
            own = {"parse": [partial(parse_as, form=form) for form in forms]}
        start, end = MAPPINGS[time_range[0]](*texts, **own)
        parsed = parsed.withColumns({"_start": start, "_end": end})
        out |= {START: F.col("_start"), END: F.col("_end")}
        reason = reason.when(F.col("_start").isNull() | F.col("_end").isNull(), "no time range")
    judged = parsed.withColumn("_reason", reason)
    columns = tuple(column.alias(n) for n, column in out.items())
    rows = judged.where("_reason is null").select(*columns)
    return Imported(rows, judged.where("_reason is not null").select(F.col("_line").alias("line"), F.col("_reason").alias("reason")), judged, columns)


def same_columns(table: DataFrame, more: DataFrame) -> None:
    """A later import must have the columns of the first."""
    if [c.casefold() for c in table.columns] != [c.casefold() for c in more.columns]:
        raise ValueError(f"the columns {more.columns} are not {table.columns}")


def append(table: DataFrame, more: DataFrame) -> DataFrame:
    same_columns(table, more)
    return table.unionByName(more)


def upsert(table: DataFrame, fresh: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A refresh: every row of ``table`` with a key of ``fresh`` becomes the last fresh row of that key; other fresh rows are added."""
    same_columns(table, fresh)
    late = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))).where("_n = 1").drop("_n")
    hits = table.groupBy(*keys).agg(F.count("*").alias("_times"))
    # As often as the key was there, at least once.
    again = late.join(hits, list(keys), "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("_times", F.lit(1)).cast("int"))))
    return table.join(late.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(again.select(*table.columns))


def upsert_counts(table: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows of ``table`` a refresh updates, and how many keys it inserts."""
    late = fresh.select(*keys).distinct()
    updated = table.join(late, list(keys), "left_semi").agg(F.count("*").alias("updated"))
    return updated.crossJoin(late.join(table.select(*keys).distinct(), list(keys), "left_anti").agg(F.count("*").alias("inserted")))


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite", single: bool = False, sort: Sequence[str] | None = None) -> None:
    """An output as CSV with a header; nulls are empty, and fields with commas or quotes are quoted.

    Rows come in order of their time and then of their values from left to right, unless ``sort`` names other columns
    (none: as they are). mode ``append`` to a folder that has files adds files without a header, so that all of them
    read one after the other are one output.
    """
    spark = rows.sparkSession
    order = [c for c in ("row_starts_at", "row_ends_at") if c in rows.columns] + [c for c in rows.columns if c not in ("row_starts_at", "row_ends_at")] if sort is None else list(sort)
    if order:
        rows = rows.orderBy(*(_day_order(c) if c in ("row_starts_at", "row_ends_at") else F.col(c) for c in order))
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    goes_on = mode == "append" and there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    (rows.coalesce(1) if single else rows).write.mode(mode).option("header", not goes_on).option("nullValue", "").option("emptyValue", "").csv(path)


def _day_order(column: str) -> Column:
    """Days are shown with the month's name; they sort by date."""
    return F.try_to_timestamp(F.col(column), F.lit("yyyy-MMM-dd"))
