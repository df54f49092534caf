"""Student's t quantiles and confidence intervals."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return out


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x == 1:
        return 0.5
    tail = front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b
    return 1 - tail / 2 if t > 0 else tail / 2


@lru_cache(maxsize=4096)
def t_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1e12
    if p < 0.5:
        return -t_quantile(1 - p, df)
    for _ in range(400):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
        if hi - lo <= 1e-15 * max(1.0, hi):
            break
    return (lo + hi) / 2


#: Sizes up to which exact quantiles are tabled; beyond, an expansion in 1/df is accurate to 1e-9.
TABLED = 200


def t_table(spark, confidence: float) -> DataFrame:
    return spark.createDataFrame([(n, t_quantile(0.5 + confidence / 2, n - 1)) for n in range(2, TABLED + 2)], "n_valid long, t double")


def mean_confidence_interval(df: DataFrame, keys: list[str], value: str, confidence: float = 0.95) -> DataFrame:
    """keys, n_valid, mean, lower, upper of value; NaN and null are left out, bounds are null below two values."""
    if isinstance(confidence, bool) or not 0 < confidence < 1:
        raise ValueError("confidence must lie between 0 and 1")
    v = F.when(~F.isnan(value), F.col(value))
    out = df.groupBy(*keys).agg(F.count(v).alias("n_valid"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"))
    z = _normal_quantile(0.5 + confidence / 2)
    nu = F.col("n_valid") - 1
    far = z + (z**3 + z) / (4 * nu) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * nu**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * nu**3)
    out = out.join(F.broadcast(t_table(df.sparkSession, confidence)), "n_valid", "left")
    t = F.when(F.col("n_valid") > TABLED + 1, far).otherwise(F.col("t"))
    half = F.when(F.col("n_valid") >= 2, t * F.col("sd") / F.sqrt("n_valid"))
    return out.select(*keys, "n_valid", "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))


def _normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2
