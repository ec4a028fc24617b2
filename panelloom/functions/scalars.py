"""Scalar expressions that stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    """NaN and NULL both mean missing; only NULL is kept (NaN sorts above every number)."""
    c = _col(c).cast("double")
    return F.when(~F.isnan(c), c)


def tokens_to_null(c: Column | str, tokens: Sequence[str] = K.NULL_TOKENS) -> Column:
    c = F.trim(_col(c))
    return F.when(~c.isin(list(tokens)), c)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, NULL when the denominator is 0 or missing."""
    return F.try_divide(num, den)


def strip_exchange_suffix(code: Column | str, max_letters: int = 2) -> Column:
    """``AAPL.O`` -> ``AAPL``. US codes use up to 2 letters, Chinese codes up to 3."""
    return F.regexp_replace(F.trim(_col(code)), rf"\.[A-Za-z]{{1,{int(max_letters)}}}$", "")


def exchange_code(letter: Column | str) -> Column:
    pairs = [F.lit(x) for kv in K.EXCHANGE_CODES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _col(letter))


def percent_to_decimal(c: Column | str, per_year: bool = False) -> Column:
    out = _col(c) / 100
    return out / K.MONTHS_PER_YEAR if per_year else out


def delisting_return(ret: Column | str, reason: Column | str) -> Column:
    """Missing return of a forced delisting becomes the fixed loss."""
    r = _col(ret)
    forced = _col(reason).cast("string").startswith(K.FORCED_DELISTING_PREFIX)
    return F.when(r.isNull() & forced, F.lit(K.FORCED_DELISTING_RETURN)).otherwise(r)


def compound_delisting(ret: Column | str, dlret: Column | str) -> Column:
    """Return and delisting return compounded when both exist, else the one that exists."""
    r, d = _col(ret), _col(dlret)
    return F.when(r.isNotNull() & d.isNotNull(), (1 + r) * (1 + d) - 1).otherwise(F.coalesce(r, d))


def ordinary_share() -> Column:
    return (
        (F.col("USIncFlg") == "Y")
        & (F.col("SecurityType") == "EQTY")
        & (
            F.col("ShareType").isin(*K.SHARE_TYPES)
            | F.col("SecuritySubType").isin(*K.SECURITY_SUBTYPES)
        )
    )


def z_score(x: Column | str, mean: Column | str, std: Column | str) -> Column:
    return F.try_divide(_col(x) - _col(mean), _col(std))


def is_outlier(x, mean, std, threshold: float = K.OUTLIER_Z) -> Column:
    return F.abs(z_score(x, mean, std)) > threshold


# Rational approximations of the normal quantile, algorithm AS 241
# (Wichura, Applied Statistics 37, 1988), highest power first.
_CENTRE_NUM = (
    2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
    45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
    133.14166789178437745, 3.387132872796366608,
)
_CENTRE_DEN = (
    5226.495278852854561, 28729.085735721942674, 39307.89580009271061,
    21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
    42.313330701600911252, 1.0,
)
_MIDDLE_NUM = (
    7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
    1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
    4.6303378461565452959, 1.42343711074968357734,
)
_MIDDLE_DEN = (
    1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
    0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
    2.05319162663775882187, 1.0,
)
_TAIL_NUM = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
    0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
    5.4637849111641143699, 6.6579046435011037772,
)
_TAIL_DEN = (
    2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
    7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
    0.59983220655588793769, 1.0,
)


def _horner(x: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(float(coefficients[0]))
    for c in coefficients[1:]:
        out = out * x + F.lit(float(c))
    return out


def normal_quantile(p: Column | str) -> Column:
    """Inverse of the standard normal distribution function; NULL outside (0, 1)."""
    p = _col(p)
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    centre = q * _horner(r, _CENTRE_NUM) / _horner(r, _CENTRE_DEN)
    s = F.sqrt(-F.log(F.when(q < 0, p).otherwise(1 - p)))
    near, far = s - 1.6, s - 5.0
    tail = F.when(s <= 5.0, _horner(near, _MIDDLE_NUM) / _horner(near, _MIDDLE_DEN)).otherwise(
        _horner(far, _TAIL_NUM) / _horner(far, _TAIL_DEN)
    )
    inside = (p > 0) & (p < 1)
    return (
        F.when(inside & (F.abs(q) <= 0.425), centre)
        .when(inside & (q < 0), -tail)
        .when(inside, tail)
    )


def exact_sum(value: Column | str) -> Column:
    """Sum of doubles that is the same in every order of the rows.

    Each value is cut into two integers (steps of 2**-14, and of 2**-46 inside a step), which add up
    exactly; only the total is rounded. Smaller parts of a value do not count.
    """
    scaled = _col(value) * float(2**14)
    whole = F.floor(scaled)
    part = F.floor((scaled - whole) * float(2**32))
    return (F.sum(whole).cast("double") + F.sum(part).cast("double") / float(2**32)) / float(2**14)
