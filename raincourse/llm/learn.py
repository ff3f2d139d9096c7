"""Sampling and training helpers of the two text classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F


def remainder(column: str, parts: int) -> F.Column:
    """crc32 of an id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def drawn(rate: F.Column, *columns: str) -> F.Column:
    """True for about a share ``rate`` of rows, by a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit("draw"), *columns), F.lit(1 << 30)) < rate * (1 << 30)
