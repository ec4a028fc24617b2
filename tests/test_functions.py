import datetime as dt
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from panelloom.functions import calendar as C
from panelloom.functions import scalars as X


def one(make, value, kind, expr):
    return make([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


def test_normal_quantile_matches_the_standard_library(make):
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.0249, 0.075, 0.0751, 0.25, 0.5, 0.75, 0.925, 0.999, 1 - 1e-12]
    rows = make([(p,) for p in ps], "p double").select("p", X.normal_quantile("p").alias("q")).collect()
    assert max(abs(r.q - NormalDist().inv_cdf(r.p)) for r in rows) < 1e-12
    assert [r.q for r in make([(0.0,), (1.0,), (None,)], "p double").select(X.normal_quantile("p").alias("q")).collect()] == [None] * 3


def test_month_arithmetic(make):
    d = make([(dt.date(2000, 1, 31),), (dt.date(1999, 12, 1),)], "d date")
    rows = d.select(
        C.month_index("d").alias("mi"), C.ym_of_date("d").alias("ym"), C.shift_ym(C.ym_of_date("d"), -1).alias("prev"),
        C.month_end(C.month_index("d")).alias("end"), C.first_of_ym(C.ym_of_date("d")).alias("start"),
        C.load_start("d").alias("load"),
    ).collect()
    assert rows[0] == (24000, 200001, 199912, dt.date(2000, 1, 31), dt.date(2000, 1, 1), dt.date(1998, 12, 1))
    assert rows[1] == (23999, 199912, 199911, dt.date(1999, 12, 31), dt.date(1999, 12, 1), dt.date(1998, 11, 1))
    assert C.period_index("2000-01") == 24000
    with pytest.raises(ValueError):
        C.in_period("mi", "2001-01", "2000-12")


def test_codes_and_missing_values(make):
    assert one(make, "AAPL.O", "string", X.strip_exchange_suffix("x")) == "AAPL"
    assert one(make, "BRK-B.N", "string", X.strip_exchange_suffix("x")) == "BRK-B"
    assert one(make, "600519.SHX", "string", X.strip_exchange_suffix("x")) == "600519.SHX"
    assert one(make, "600519.SHX", "string", X.strip_exchange_suffix("x", 3)) == "600519"
    assert one(make, float("nan"), "double", X.nan_to_null("x")) is None
    assert one(make, " NA ", "string", X.tokens_to_null("x")) is None
    assert one(make, "Z", "string", X.exchange_code("x")) == 3
    assert one(make, "?", "string", X.exchange_code("x")) is None
    assert one(make, "/a/1999/19990104.csv", "string", C.date_in_path("x")) == dt.date(1999, 1, 4)
    assert one(make, "/a/day=19990104.csv/part-0.csv", "string", C.date_in_path("x")) == dt.date(1999, 1, 4)
    assert one(make, "/a/readme.csv", "string", C.date_in_path("x")) is None


def test_delisting_returns(make):
    rows = make([(None, "552"), (None, "231"), (None, None), (0.1, "552")], "r double, c string")
    assert [x.y for x in rows.select(X.delisting_return("r", "c").alias("y")).collect()] == [-0.30, None, None, 0.1]
    rows = make([(0.1, -0.5), (None, -0.5), (0.1, None)], "r double, d double")
    got = [x.y for x in rows.select(X.compound_delisting("r", "d").alias("y")).collect()]
    assert got == pytest.approx([1.1 * 0.5 - 1, -0.5, 0.1])


def test_fitting_months(make):
    rows = make([(2000 * 12 + m,) for m in range(4)] + [(2001 * 12 + m,) for m in range(4)], "mi int")
    assert [r.f for r in rows.select(C.is_fitting_month("mi").alias("f")).collect()] == [False, True] * 2 + [True, False] * 2
    assert rows.filter(F.lit(True)).count() == 8
