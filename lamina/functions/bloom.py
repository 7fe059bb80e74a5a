"""Sizes of Bloom filters, as SQL expressions and for Parquet's writer options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(n: Column, p: Column) -> Column:
    """ceil(-n ln p / (ln 2)^2), at least 1."""
    exact = F.ceil(-F.greatest(n, F.lit(1)) * F.log(p) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0))))
    return F.greatest(exact.cast("long"), F.lit(1).cast("long"))


def hashes(m: Column, n: Column) -> Column:
    """round(m / n * ln 2) within 1..255."""
    k = F.round(m / F.greatest(n, F.lit(1)) * F.log(F.lit(2.0))).cast("int")
    return F.when(n <= 0, F.lit(1)).otherwise(F.least(F.greatest(k, F.lit(1)), F.lit(255)))


def parquet_options(column: str, expected: int, fpp: float = 0.01) -> dict[str, str]:
    """Writer options for a Bloom filter on ``column`` sized for ``expected`` distinct values a file."""
    return {
        f"parquet.bloom.filter.enabled#{column}": "true",
        f"parquet.bloom.filter.expected.ndv#{column}": str(max(int(expected), 1)),
        f"parquet.bloom.filter.fpp#{column}": str(fpp),
    }
