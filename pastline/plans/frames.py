"""Window frames of strictly earlier rows. The order key is an integer (microseconds), so ``-1`` excludes every peer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql.window import WindowSpec


def past(keys: str | list[str], width: int, order: str = "us") -> WindowSpec:
    """Rows of the same keys with ``now - width <= t < now``."""
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order).rangeBetween(-width, -1)


def history(keys: str | list[str], order: str = "us") -> WindowSpec:
    """All rows of the same keys with ``t < now``."""
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
