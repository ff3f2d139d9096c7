"""Column expressions on reflectance bands and humidity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def _ratio(a: str, b: str) -> Column:
    return (F.col(a) - F.col(b)) / (F.col(a) + F.col(b) + EPS)


def indices() -> dict[str, Column]:
    """Vegetation, water, burn and built-up indices of bands b2..b7."""
    b2, b4, b5 = F.col("b2"), F.col("b4"), F.col("b5")
    return {"ndvi": _ratio("b5", "b4"), "evi": 2.5 * (b5 - b4) / (b5 + 6 * b4 - 7.5 * b2 + 1 + EPS),
            "ndwi": _ratio("b3", "b5"), "mndwi": _ratio("b3", "b6"), "nbr": _ratio("b5", "b7"), "ndbi": _ratio("b6", "b5")}


def humidity_deficit(temp_c: Column, rh_pct: Column) -> Column:
    """Saturation less actual vapour pressure (hPa), at least zero."""
    es = 6.112 * F.exp(17.67 * temp_c / (temp_c + 243.5))
    return F.greatest(es - es * rh_pct / 100.0, F.lit(0.0))
