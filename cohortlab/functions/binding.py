"""Name a sub-expression once inside a projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(body, /, **values: Column) -> Column:
    """Evaluate ``values`` once per row and build ``body`` from them.

    A one-element ``transform`` binds them, which stands in for common
    sub-expression elimination inside large nested projections.
    """
    bound = F.array(F.struct(*[col.alias(name) for name, col in values.items()]))
    return F.get(F.transform(bound, body), F.lit(0))
