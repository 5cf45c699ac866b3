import datetime

from pyspark.sql import functions as F

from tablefacts.functions import formats as fmt
from tablefacts.functions.dates import guess_format
from tablefacts.functions.names import clean_names, header_names, resolve_columns

DOUBLES = [
    0.0, 1.0, -1.0, 0.1, 0.25, 0.35, 1.005, 2.675, 2.5, 3.5, -0.04, 1234567.891, 12345678.0, 1e15, 123456789012345.6,
    1e16, 1.5e17, 1e-4, 1e-5, 2.5e-7, 99.95, 999999.95, 0.05, 1e22,
]


def texts(spark, values, dtype, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    kind = df.schema["v"].dataType
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"), kind)).collect()]


def test_double_texts(spark):
    assert texts(spark, DOUBLES, "double", fmt.plain_text) == [str(v) for v in DOUBLES]


def test_kpi_value_texts(spark):
    small = [v for v in DOUBLES if abs(v) < 1e13]
    expected = [f"{int(v):,}" if v.is_integer() else f"{v:,.1f}" for v in small]
    assert texts(spark, small, "double", fmt.single_value_text) == expected
    assert texts(spark, [0, -5, 1234567], "bigint", fmt.single_value_text) == ["0", "-5", "1,234,567"]
    day = datetime.datetime(2024, 1, 31, 13, 5)
    assert texts(spark, [day], "timestamp_ntz", fmt.single_value_text) == ["2024-01-31"]
    assert texts(spark, ["x"], "string", fmt.single_value_text) == ["x"]


def test_fact_and_cell_texts(spark):
    small = [v for v in DOUBLES if abs(v) < 1e13]
    assert texts(spark, small, "double", fmt.fact_text) == [f"{v:,.2f}" for v in small]
    assert texts(spark, [1234567], "bigint", fmt.fact_text) == ["1,234,567"]
    assert texts(spark, [1234.5, None], "double", fmt.cell_text) == ["1,234.50", "—"]
    assert texts(spark, [1234, None], "bigint", fmt.cell_text) == ["1234", "—"]
    assert texts(spark, [True, False, None], "boolean", fmt.cell_text) == ["True", "False", "—"]


def test_timestamp_texts(spark):
    values = [datetime.datetime(2024, 1, 31), datetime.datetime(2024, 1, 31, 1, 2, 3, 500000)]
    expected = ["2024-01-31 00:00:00", "2024-01-31 01:02:03.500000"]
    assert texts(spark, values, "timestamp_ntz", fmt.plain_text) == expected
    assert texts(spark, values, "timestamp", fmt.plain_text) == expected
    iso = texts(spark, values, "timestamp_ntz", lambda c, _: fmt.iso_text(c))
    assert iso == [v.isoformat() for v in values]
    assert texts(spark, [datetime.date(2024, 1, 31)], "date", lambda c, _: fmt.iso_text(c)) == ["2024-01-31T00:00:00"]


def test_missing_categories(spark):
    assert texts(spark, [None], "string", fmt.category_text) == ["nan"]
    assert texts(spark, [None], "date", fmt.category_text) == ["NaT"]


def test_four_digits(spark):
    values = [4.00525, 0.00015, 1.23456789, -2.00015, 1e6 / 7]
    got = texts(spark, values, "double", lambda c, _: fmt.four_digits(c))
    assert got == [round(v, 4) for v in values]


def test_share(spark):
    df = spark.createDataFrame([(1.0, 3.0), (5.0, 0.0), (-1.0, 4.0)], "a double, b double")
    got = [r[0] for r in df.select(fmt.share_text(fmt.share(F.col("a"), F.col("b")))).collect()]
    assert got == ["33.3%", "0.0%", "-25.0%"]


def test_resolve_columns():
    actual = ["ROI %", "Units Sold", "unitssold", "Region"]
    assert resolve_columns(["roi%", "UNITS\tSOLD", "x", "region "], actual) == (["ROI %", "Units Sold", "Region"], ["x"])
    assert resolve_columns([], actual) == ([], [])


def test_clean_names():
    assert clean_names([" a ", "a", "A", "Unnamed: 3", "a_2"]) == ["a", "a_2", "A_3", "Column_4", "a_2_2"]


def test_header_names():
    assert header_names(["x", None, "x", "", "x"], 6) == ["x", "Unnamed: 1", "x.1", "Unnamed: 3", "x.2", "Unnamed: 5"]


def test_guess_format():
    assert guess_format("2024-01-31") == "yyyy-M-d"
    assert guess_format("01/31/2024") == "M/d/yyyy"
    assert guess_format("31/01/2024") == "d/M/yyyy"
    assert guess_format("31.01.2024 10:20") == "d.M.yyyy H:mm"
    assert guess_format("2024-01-31T10:20:30") == "yyyy-M-d'T'H:mm:ss"
    assert guess_format("Jan 31, 2024") == "MMM d, yyyy"
    assert guess_format("Q1") is None
    assert guess_format("10") is None


def test_every_date_shape_is_read(spark):
    from tablefacts.functions.dates import parse_date

    days = [
        "2024-01-31", "2024/01/31", "20240131", "01/31/2024", "31/01/2024", "01-31-2024", "31-01-2024", "31.01.2024",
        "Jan 31, 2024", "January 31, 2024", "31 Jan 2024", "31 January 2024", "31-Jan-2024", "01/31/24", "31-Jan-24",
    ]
    times = {"": (0, 0, 0, 0), " 1:20 PM": (13, 20, 0, 0), " 1:20:30 AM": (1, 20, 30, 0), " 10:20": (10, 20, 0, 0), " 9:20:30": (9, 20, 30, 0), " 10:20:30.25": (10, 20, 30, 250000),
             "T10:20:30": (10, 20, 30, 0), "T10:20:30.125": (10, 20, 30, 125000)}
    cases = [(day + time, clock) for day in days for time, clock in times.items()]
    patterns = [guess_format(value) for value, _ in cases]
    assert all(patterns)
    read = [parse_date(F.lit(v), p).alias(str(i)) for i, ((v, _), p) in enumerate(zip(cases, patterns))]
    got = spark.range(1).select(*read).first()
    for (value, clock), pattern, time in zip(cases, patterns, got):
        assert time == datetime.datetime(2024, 1, 31, *clock), (value, pattern)


def test_times_out_of_range_are_missing(spark):
    from tablefacts.functions.dates import parse_date

    df = spark.createDataFrame([("1001",), ("2024",), ("9999",)], "v string")
    got = [r[0] for r in df.select(parse_date(F.col("v"), guess_format("2024"))).collect()]
    assert got == [None, datetime.datetime(2024, 1, 1), None]
