"""Column expressions on names, lists and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_name(name: Column) -> Column:
    return F.translate(F.lower(name), " -", "__")


def content_key(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)])), 256)


def shortened(items: Column, n: int) -> Column:
    """First n items and a note on the rest."""
    more = F.when(F.size(items) > n, F.format_string(" (+%d more)", F.size(items) - n)).otherwise("")
    return F.concat(F.array_join(F.slice(items, 1, n), ", "), more)
