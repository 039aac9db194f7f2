"""CSV imports, time ranges, refreshes and CSV outputs."""

import pytest
from pyspark.sql import functions as F

from panelweave.functions import ranges, time, validation
from panelweave.functions.time import Granularity
from panelweave.sources import files


def shown(spark, columns, **texts):
    row = spark.createDataFrame([tuple(texts.values())], ", ".join(f"{n} string" for n in texts))
    start, end = columns(*(F.col(n) for n in texts))
    found = row.select(time.display(start).alias("s"), time.display(end).alias("e")).first()
    return found["s"], found["e"]


@pytest.mark.parametrize(
    ("mapping", "texts", "expected"),
    [
        ("year_numbers", ["1990"], ("1990-Jan-01", "1991-Jan-01")),
        ("year_numbers", ["1990", "1992"], ("1990-Jan-01", "1993-Jan-01")),
        ("year_numbers", [None, "1992"], ("1992-Jan-01", "1993-Jan-01")),
        ("year_numbers", [None, None], (None, None)),
        ("year_texts", ["Feb 12, 1990"], ("1990-Jan-01", "1991-Jan-01")),
        ("year_texts", ["1990", "3/1/1991"], ("1990-Jan-01", "1992-Jan-01")),
        ("month_numbers", ["1990", "12"], ("1990-Dec-01", "1991-Jan-01")),
        ("month_numbers", ["1990", "13"], ("1990-Jan-01", "1990-Feb-01")),
        ("month_numbers", ["1990", "0"], ("1990-Jan-01", "1990-Feb-01")),
        ("month_numbers", ["1990", "3", "1991", "5"], ("1990-Mar-01", "1991-Jun-01")),
        ("month_numbers", ["1990", "12", "1990", "0"], ("1990-Dec-01", "1991-Jan-01")),
        ("month_numbers", ["1990", "3", "1992", "0"], ("1990-Mar-01", "1992-Apr-01")),
        ("month_numbers", ["1990", "3", "1992", "13"], ("1990-Mar-01", "1992-Feb-01")),
        ("month_texts", ["1990-02-17"], ("1990-Feb-01", "1990-Mar-01")),
        ("month_texts", ["Feb 1990", "March 1990"], ("1990-Feb-01", "1990-Apr-01")),
        ("day_numbers", ["1990", "2", "28"], ("1990-Feb-28", "1990-Mar-01")),
        ("day_numbers", ["1990", "2", "30"], (None, None)),
        ("day_numbers", ["1990", "2", "3", "1990", "4", "0"], ("1990-Feb-03", "1990-May-01")),
        ("day_numbers", ["1990", "0", "0", "1990", "0", "0"], ("1990-Jan-01", "1991-Jan-01")),
        ("day_numbers", ["1990", "2", "3", "1990", "0", "7"], ("1990-Feb-03", "1990-Dec-08")),
        ("day_texts", ["12-31-1990"], ("1990-Dec-31", "1991-Jan-01")),
        ("day_texts", ["1990/1/2", "1990/1/5"], ("1990-Jan-02", "1990-Jan-06")),
        ("range_texts", ["1990-01-02", "1990-01-05"], ("1990-Jan-02", "1990-Jan-05")),
    ],
)
def test_time_ranges(spark, mapping, texts, expected):
    assert shown(spark, ranges.MAPPINGS[mapping], **{f"c{i}": t for i, t in enumerate(texts)}) == expected


def test_every_date_form_parses(spark):
    import datetime

    at = datetime.datetime(1990, 2, 3, 4, 5, 6)
    for pattern in time.DATE_FORMS:
        python = pattern
        for java, c in (("yyyy", "%Y"), ("MMMM", "%B"), ("MMM", "%b"), ("MM", "%m"), ("dd", "%d")):
            python = python.replace(java, c)
        python = python.replace("M", "%m") if "%m" not in python and "%b" not in python and "%B" not in python else python
        import re

        python = re.sub(r"(?<![%a-zA-Z])d(?![a-z])", "%d", python).replace("H:m:s", "%H:%M:%S").replace("H:%m:s", "%H:%M:%S")
        text = at.strftime(python)
        got = spark.range(1).select(time.display(time.parse_date(F.lit(text))).alias("x")).first()["x"]
        has_day, has_month = "d" in pattern, "M" in pattern
        assert got == f"1990-{'Feb' if has_month else 'Jan'}-{'03' if has_day else '01'}", (pattern, text, got)


def test_alignment(spark):
    ts = F.lit("1987-05-06 07:08:09").cast("timestamp_ntz")
    at = time.ms_of_timestamp(ts)
    g = Granularity
    row = spark.range(1).select(*(time.display(time.align_down(at, u)).alias(u.name) for u in (g.DAY, g.MONTH, g.YEAR, g.DECADE, g.CENTURY)), time.display(time.align_up(at, g.DECADE)).alias("up"), time.units(at, at + time.DAY_MS, g.DAY).alias("n")).first()
    assert tuple(row) == ("1987-May-06", "1987-May-01", "1987-Jan-01", "1980-Jan-01", "1900-Jan-01", "1990-Jan-01", 2)
    with pytest.raises(ValueError):
        time.align_down(at, g.WEEK)


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        "code,year,name,score\n"
        "a code,the year,,points\n"
        "string,int,string,float\n"
        'A,1990,"one, two",1.5\n'
        "B, 1991 ,plain,\n"
        "C,12abc,bad int,1\n"
        ",1990,no key,1\n"
        "D,,no year,2\n"
        "E,1990,short\n"
        "\n"
        'F,1992,say \\"hi\\",3\n'
    )
    return str(path)


def test_import(spark, csv):
    header = files.read_header(spark, csv, descriptions=True, kinds=True)
    assert header.names == ("code", "year", "name", "score") and header.schema()["year"].metadata == {"comment": "the year"}
    got = files.read_csv(spark, csv, header, keys=["code"], renamed={"name": "label"}, constants={"source": "x"}, time_range=("year_numbers", ["year"]))
    rows = {r["code"]: r for r in got.rows.collect()}
    assert set(rows) == {"A", "B", "F"}
    assert rows["A"]["label"] == "one, two" and rows["B"]["score"] == 0 and rows["B"]["year"] == 1991 and rows["F"]["source"] == "x"
    reasons = {r["line"].split(",")[0]: r["reason"] for r in got.rejects.collect()}
    assert reasons == {"C": "year does not parse", "": "code is empty", "D": "no time range", "E": "wrong number of fields"}
    assert tuple(got.counts().first()) == (3, 4)
    assert files.read_csv(spark, csv, header, columns=["score", "code"]).rows.columns == ["score", "code"]


def test_header_errors(spark, tmp_path):
    for n, text in enumerate(("a,A\n", "a,b c\n", "a,b\nint,nope\n")):
        path = tmp_path / f"{n}.csv"
        path.write_text(text)
        with pytest.raises(ValueError):
            files.read_header(spark, str(path), kinds=n == 2)


def test_single_quotes(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text("a,b\n'x, y',1\n\"u, v\",2\n")
    got = files.read_csv(spark, str(path), files.read_header(spark, str(path)), quote="either").rows.collect()
    assert sorted(r["a"] for r in got) == ["u, v", "x, y"]


@pytest.mark.parametrize(
    ("line", "options", "want"),
    [
        ("a,b", {}, ["a", "b"]),
        (",x,", {}, ["", "x", ""]),
        ("", {}, [""]),
        ('"a, b" junk, c ', {}, ["a, b", "c"]),
        ("\"a, b\", 'c, d' , e", {"quote": "either"}, ["a, b", "c, d", "e"]),
        ("'it''s", {"quote": "either"}, ["it"]),
        (r'"say \"hi\", you",x\,y', {}, ['say "hi", you', "x,y"]),
        ("a\t 'b, c'\t", {"sep": "\t", "quote": "'"}, ["a", "b, c", ""]),
        ('"open, b', {}, ['"open', "b"]),
    ],
)
def test_fields(spark, line, options, want):
    assert spark.range(1).select(files.fields(F.lit(line), **options).alias("x")).first()["x"] == want


def test_append_has_one_header(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("b", "1990-Feb-01", "1990-Mar-01"), ("a", "1990-Feb-01", "1990-Mar-01"), ("c", "1989-Dec-01", "1990-Jan-01")], "k string, row_starts_at string, row_ends_at string")
    files.write_csv(rows, path, single=True)
    files.write_csv(rows.where("k = 'b'"), path, mode="append", single=True)
    parts = sorted((p.stat().st_mtime_ns, p.read_text()) for p in (tmp_path / "out").glob("part-*"))
    assert [text for _, text in parts] == ["k,row_starts_at,row_ends_at\nc,1989-Dec-01,1990-Jan-01\na,1990-Feb-01,1990-Mar-01\nb,1990-Feb-01,1990-Mar-01\n", "b,1990-Feb-01,1990-Mar-01\n"]


def test_upsert(spark):
    table = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    fresh = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k int, v string")
    got = sorted(map(tuple, files.upsert(table, fresh, ["k"], ["v"]).collect()))
    assert got == [(1, "y"), (1, "y"), (2, "c"), (3, "z")]
    with pytest.raises(ValueError):
        files.append(table, fresh.withColumnRenamed("v", "w"))


def test_csv_output(spark, tmp_path):
    rows = spark.createDataFrame([("b", None), ("a", "x, y")], "k string, v string")
    files.write_csv(rows, str(tmp_path / "out"), single=True, sort=["k"])
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_text() == 'k,v\na,"x, y"\nb,\n'


def test_validation(spark):
    assert validation.checked(" ab-1 ", "code") == "ab-1"
    for bad in ("", "a b", "x" * 129):
        with pytest.raises(ValueError):
            validation.checked(bad, "code")
    row = spark.range(1).select(validation.is_integer(F.lit("12")), validation.is_date(F.lit(1990), F.lit(2), F.lit(30)), validation.is_valid(F.lit("a*b"), "member")).first()
    assert tuple(row) == (True, False, True)
