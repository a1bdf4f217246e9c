"""Exact numbers against Python's own."""

import random
from decimal import Decimal, localcontext

from pyspark.sql import functions as F

from tallyframe.functions.numbers import digit_number, exact_number, number_text


def texts():
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    out = ["0", "-0", "+0.000", "0e5", ".5", "-.5", "5.", "1e3", "1E-3", "1000", "1000.0", "+1.0e+3", "0.001", " 12 ", "9" * 60, "9" * 59 + "8"]
    out += ["1e400", "10e399", "-1e-400", "1" + "0" * 39, "1" + "0" * 40, "1" + "0" * 41, "0." + "0" * 38 + "1", "0." + "0" * 45 + "1", "1e000000000000000000000003"]
    for _ in range(400):
        body = digits(rng.choice([1, 3, 20, 29, 45]))
        if rng.random() < 0.5:
            at = rng.randrange(len(body) + 1)
            body = body[:at] + "." + body[at:]
        if rng.random() < 0.3:
            body = "0" * rng.randrange(4) + body
        if rng.random() < 0.3:
            body += f"e{rng.randrange(-50, 50)}"
        out.append(rng.choice(["", "-", "+"]) + body)
    return out


NONE = ["", " ", None, ".", "-", "12d", "1e", "e5", "0x10", "nan", "inf", "1,000", "1 2", "--1", "1e9999999999999999999", "１２"]


def test_against_decimal(spark):
    values = texts()
    rows = spark.createDataFrame(list(enumerate([*values, *NONE])), "k int, x string").withColumn("n", exact_number(F.col("x")))
    found = rows.withColumn("text", number_text(F.col("n"))).orderBy("n", "k").collect()
    numbers = [r for r in found if r["n"] is not None]
    assert {r["x"] for r in found if r["n"] is None} == set(NONE)
    assert len(numbers) == len(values)
    with localcontext() as context:
        context.prec = 1000
        exact = [Decimal(r["x"].strip()) for r in numbers]
        assert exact == sorted(exact)  # the order of the structs
        for r, x in zip(numbers, exact, strict=True):
            assert Decimal(r["text"]) == x
        assert len({tuple(r["n"]) for r in numbers}) == len(set(exact)) == len({r["text"] for r in numbers})


def test_plain_texts(spark):
    want = {"007": "7", "-1.50": "-1.5", "1e3": "1000", "0.0010": "0.001", "1e41": "1E41", "12.5e-60": "1.25E-59", "0.0": "0", "x": None}
    rows = spark.createDataFrame([(x,) for x in want], "x string")
    assert {r["x"]: r["t"] for r in rows.select("x", number_text(exact_number(F.col("x"))).alias("t")).collect()} == want
    typed = spark.range(1).select(*[number_text(exact_number(F.expr(x))).alias("t") for x in ("CAST(10 AS INT)", "1.50BD", "1e7D", "true")])
    assert tuple(typed.first()) == ("10", "1.5", "10000000", None)


def test_order_of_digit_texts(spark):
    values = ["10", "9", "x", "9" * 40, "8" * 41, None, "-5", "007"]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x string")
    ordered = [r["x"] for r in rows.orderBy(digit_number(F.col("x")), "k").collect()]
    assert ordered == ["x", None, "-5", "007", "9", "10", "9" * 40, "8" * 41]


def test_digits_alone_give_the_struct_of_any_other_text(spark):
    """They take a way of their own; a sign sends the same number the general way."""
    rows = [(t, f"+{t}") for t in ["0", "000", "7", "0070", "1200", "9" * 50, "0" * 30 + "10" + "0" * 30]]
    found = spark.createDataFrame(rows, "a string, b string").select(exact_number(F.col("a")).alias("a"), exact_number(F.col("b")).alias("b"))
    assert all(r.a is not None and r.a == r.b for r in found.collect())
    assert found.select("a")._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") >= 2
