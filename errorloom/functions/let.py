"""Naming an intermediate result inside a column expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often ``use`` names it.

    Spark shares repeated subexpressions in a projection, but not in a filter and not behind a
    condition. There every mention of a costly value would compute it again.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
