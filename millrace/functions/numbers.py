"""Rounding of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, places: int) -> Column:
    """``x`` to so many places, half away from zero, as SQL on doubles has it: the product with the power of ten is what is rounded.

    Spark's own goes by the shortest decimal that names the double, and takes up what lies just below a half.
    What is not finite, or not once it is multiplied, stays as it is.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    near = F.round(x * float(10**places), 0) / float(10**places)
    return F.when(F.abs(near) < float("inf"), near).otherwise(x)
