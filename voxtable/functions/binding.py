"""Binding of values for use inside higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Evaluate ``values`` once per row and hand them to ``body`` as a struct.

    The optimizer copies a computed column into every lambda that names it, where it would run once
    per array element. A lambda variable is not copied.
    """
    bound = F.struct(*[column.alias(name) for name, column in values.items()])
    return F.get(F.transform(F.array(bound), body), F.lit(0))
