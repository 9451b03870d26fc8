"""A linear model of one column by another, its residuals, and filters decided by them.

The model is in whole numbers, pred = a + floor(b_num x / b_den), so that decoding is exact and
no comparison flips by rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Denominator of the whole-number slope.
DEN = 1_000_000


def fit(df: DataFrame) -> DataFrame:
    """intercept, slope of y by x (least squares); a constant x gives slope 0 and the mean."""
    flat = F.coalesce(F.var_pop("x"), F.lit(0.0)) < 1e-18
    return df.agg(F.when(flat, F.avg("y")).otherwise(F.regr_intercept("y", "x")).alias("intercept"), F.when(flat, F.lit(0.0)).otherwise(F.regr_slope("y", "x")).alias("slope"))


def whole_model(df: DataFrame) -> tuple[int, int]:
    """(a, b_num) of :func:`fit`, rounded: any rounding is made good by the residuals."""
    r = fit(df).first()
    return round(r.intercept or 0), round((r.slope or 0) * DEN)


def predict(x, model: tuple[int, int]):
    a, b = model
    n = x * F.lit(b)
    return F.lit(a).cast("bigint") + F.call_function("div", n - F.pmod(n, F.lit(DEN)), F.lit(DEN))


def encode(df: DataFrame, model: tuple[int, int]) -> DataFrame:
    """id, x, resid: y is left out."""
    return df.select("id", "x", (F.col("y") - predict(F.col("x"), model)).alias("resid"))


def residual_range(encoded: DataFrame) -> DataFrame:
    return encoded.agg(F.min("resid").alias("rmin"), F.max("resid").alias("rmax"), F.count("*").alias("n"))


def decode(encoded: DataFrame, model: tuple[int, int]) -> DataFrame:
    return encoded.select("id", "x", (predict(F.col("x"), model) + F.col("resid")).alias("y"))


def count_below(df: DataFrame, t: int) -> DataFrame:
    return df.filter(F.col("y") < t).agg(F.count("*").alias("n"))


def count_below_pruned(encoded: DataFrame, model: tuple[int, int], bounds: tuple[int, int], t: int) -> DataFrame:
    """n of y < t and how it was decided: rejected and accepted by the residual range alone, the rest decoded."""
    pred = predict(F.col("x"), model)
    low, high = bounds
    verdict = F.when(pred + low >= t, "reject").when(pred + high < t, "accept").otherwise("decode")
    hit = F.when(verdict == "decode", pred + F.col("resid") < t).otherwise(verdict == "accept")
    return encoded.agg(F.count_if(hit).alias("n"), *(F.count_if(verdict == v).alias(v) for v in ("reject", "accept", "decode")))
