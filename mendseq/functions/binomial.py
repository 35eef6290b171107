"""How many sampled k-mers make a base trusted."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendseq.model import check_alpha, check_k

# Fixed values of the rule.
CONFIDENCE = 1 - 0.5 * 1e-2
LEAST_MULTIPLICITY = 2


def binomial_cdf(n: int, p: float) -> list[float]:
    """P(X <= j) for j = 0..n and X ~ Bin(n, p)."""
    total, out = 0.0, []
    for j in range(n + 1):
        total += comb(n, j) * p**j * (1 - p) ** (n - j)
        out.append(total)
    return out


def untrusted_rate(alpha: float, false_positive: float = 0.0) -> float:
    """Chance that a k-mer seen in few erroneous copies is found in the sample."""
    check_alpha(alpha)
    copies = max(LEAST_MULTIPLICITY, int(0.1 / alpha * 2))
    p = 1 - (1 - alpha) ** copies
    return p + false_positive - p * false_positive


def thresholds(alpha: float, k: int, false_positive: float = 0.0) -> list[int]:
    """Entry n: hits among n windows that an untrusted base may still reach."""
    check_k(k)
    p = untrusted_rate(alpha, false_positive)
    table = [0]
    for n in range(1, k + 1):
        cdf = binomial_cdf(n, p)
        table.append(next((j for j, c in enumerate(cdf) if c >= CONFIDENCE), n))
    return table


def _choose(n: Column, m: Column) -> Column:
    factors = F.when(m > 0, F.sequence(F.lit(1).cast("int"), m)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(factors, F.lit(1.0), lambda product, i: product * (n - m + i) / i)


def threshold_table(rates: DataFrame, k: int) -> DataFrame:
    """(n, threshold) for n = 1..k as a query on one row with the sampling rate ``alpha``."""
    check_k(k)
    alpha, n, m = F.col("alpha"), F.col("n"), F.col("m")
    copies = F.greatest(F.lit(LEAST_MULTIPLICITY), (F.lit(0.1) / alpha * 2).cast("int"))
    cells = (rates.select((1 - F.pow(1 - alpha, copies)).alias("p"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("n"))
             .select("p", "n", F.explode(F.sequence(F.lit(0), n)).alias("m")))
    mass = _choose(n, m) * F.pow("p", m) * F.pow(1 - F.col("p"), n - m)
    so_far = F.sum(mass).over(Window.partitionBy("n").orderBy("m"))
    return cells.withColumn("c", so_far).where(F.col("c") >= CONFIDENCE).groupBy("n").agg(F.min("m").alias("threshold"))
