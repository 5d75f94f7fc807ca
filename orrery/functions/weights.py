"""Distance weights: columns from a distance column to a weight."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def gauss(d: Column, mu: float = 0.0, sigma: float = 2.0) -> Column:
    return F.exp(-((d - mu) * (d - mu)) / (2.0 * sigma * sigma))


def weights(r_max: float = 6.0, r_min: float = 1.0, middle: float = 3.0, power: float = 2.0, sigma: float = 2.0) -> dict[str, Callable[[Column], Column]]:
    """The eight weight functions by name, with their radii bound."""
    return {
        "ONE": lambda d: F.lit(1.0),
        "NEW": lambda d: F.when(d <= middle, 1.0).otherwise(F.lit(middle * middle) / (d * d)),
        "OLD": lambda d: F.when(d <= middle, 1.0).otherwise(F.pow(F.lit(middle) / d, F.lit(power))),
        "GAUSS": lambda d: gauss(d, 0.0, sigma),
        "INV": lambda d: 1.0 - d / r_max,
        "INVPOW": lambda d: F.pow(1.0 - d / r_max, F.lit(power)),
        "INV2": lambda d: (r_max - d) / (r_max - r_min),
        "INVPOW2": lambda d: F.pow((r_max - F.greatest(d, F.lit(r_min))) / (r_max - r_min), F.lit(power)),
    }
