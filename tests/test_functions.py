"""Column rules on hand-made values."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import labels, text, values
from tallyframe.sources import ids


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value, plain, without_none",
    [
        (None, "", ""),
        ("", "", ""),
        ("   ", "", ""),
        ("Hello World", "hello world", "hello world"),
        ("  hello   world  ", "hello world", "hello world"),
        ("a__b", "a  b", "a  b"),
        (" _x_ ", "x", "x"),
        ("hello-world", "hello world", "hello world"),
        ("None value", "none value", "value"),
        ("before None after", "before none after", "before after"),
        ("none-x", "none x", "x"),
        ("none_x", "none x", "none x"),
        ("a  b", "a b", "a b"),
        ("a\x1cb", "a b", "a b"),
    ],
)
def test_normalize_text(spark, value, plain, without_none):
    assert one(spark, value, text.normalize_text) == plain
    assert one(spark, value, text.normalize_without_none) == without_none


def test_na_tokens(spark):
    for token in (None, "", "NA", "null", "None", "<NA>", "#N/A N/A", "-1.#IND"):
        assert one(spark, token, text.na_to_empty) == ""
    for kept in ("na", "none", "NONE", " NA", "0"):
        assert one(spark, kept, text.na_to_empty) == kept


@pytest.mark.parametrize(
    "uri, masked",
    [
        ("postgresql://alice:secret@host:5432/db", "postgresql://alice:****@host:5432/db"),
        ("postgresql://alice@host/db", "postgresql://alice@host/db"),
        ("postgresql://alice:p@ss@host/db", "postgresql://alice:****@host/db"),
        ("postgresql://alice:p%40ss@host/db", "postgresql://alice:****@host/db"),
        ("", ""),
    ],
)
def test_redact_uri(spark, uri, masked):
    assert one(spark, uri, text.redact_uri) == masked


@pytest.mark.parametrize(
    "header, name, sep",
    [
        ("a|b|c", "x.psv", "|"),
        ("a,b,c", "x.csv", ","),
        ("a|b,c", "x.csv", "|"),
        ("a", "x.CSV", ","),
        ("a", "x.psv", "|"),
        ("", "x.csv", ","),
    ],
)
def test_header_separator(spark, header, name, sep):
    df = spark.createDataFrame([(header, name)], "h string, n string")
    assert df.select(text.header_separator(F.col("h"), F.col("n"))).first()[0] == sep


def test_json_flag_takes_any_blanks(spark):
    for raw, flag in (
        ('{"is_dependent":  true}', True),
        ('{"is_dependent": true}', True),
        ('{"IS_DEPENDENT":TRUE}', True),
        ('{"is_dependent": false}', False),
        (None, False),
    ):
        assert one(spark, raw, lambda c: text.json_flag(c, "is_dependent")) is flag


def test_dataset_order(spark):
    df = spark.createDataFrame([("10-b",), ("2a-x",), ("zzz",), ("2-y",)], "n string")
    assert [r.n for r in df.orderBy(*labels.dataset_order(F.col("n"))).collect()] == ["2-y", "2a-x", "10-b", "zzz"]


@pytest.mark.parametrize("rate, status", [(100.0, "PERFECT"), (95.0, "MINOR ISSUES"), (90.0, "MINOR ISSUES"), (89.9, "NEEDS REVIEW")])
def test_parity_status(spark, rate, status):
    assert one(spark, rate, labels.parity_status, "double") == status


def test_numbers_and_times(spark):
    assert one(spark, "12.50", values.try_number) == 12.5
    assert one(spark, "x", values.try_number) is None
    assert one(spark, "soon", values.try_time) is None
    assert str(one(spark, "2024-01-02 03:04:05", values.try_time)) == "2024-01-02 03:04:05"
    assert one(spark, "abc", text.digits_or_zero) == 0
    assert one(spark, "42", text.digits_or_zero) == 42
    times = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS a, TIMESTAMP_NTZ '2024-01-01 02:30:59' AS b")
    assert times.select(values.minutes_between(F.col("a"), F.col("b"))).first()[0] == 150
    assert times.select(values.run_name(F.lit(150), F.col("b"))).first()[0] == "150 01-01-24 0230"
    zero = spark.createDataFrame([(1, 0), (1, 3)], "a long, b long")
    assert [r[0] for r in zero.select(values.percent(F.col("a"), F.col("b"))).collect()] == [None, 33.3]


def test_targets(spark):
    given = [*ids.TARGET_ALIASES, " PRIMARY-QA ", "both", None]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    rows = df.select("t", *ids.resolve_target(F.col("t"))).collect()
    for r in rows[: len(ids.TARGET_ALIASES)]:
        assert r.target == ids.TARGET_ALIASES[r.t] and r.error is None
        assert r.is_deprecated == (r.t in ids.DEPRECATED_ALIASES)
    assert rows[-3].target == "primary-qa"
    assert rows[-2].target is None and "unknown target 'both'" in rows[-2].error
    assert rows[-1].target is None and rows[-1].error
