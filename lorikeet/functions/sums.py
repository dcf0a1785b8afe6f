"""Sums and means of doubles that don't depend on the order of rows.

Adding doubles rounds at every step, so a plain sum varies with the order in which
a shuffle brings its rows, and whatever is compared with it varies too. Here each
value is cut into whole numbers of three units, whose sums are exact; the result
is rounded once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first unit is 2^-22, each further one 2^-32 of the one before.
_FIRST, _NEXT = float(1 << 22), float(1 << 32)
#: Values below it are summed exactly, over up to 2^31 rows.
_LARGE = float(1 << 10)


def exact_sum(value: Column | str) -> Column:
    """The sum of the values that aren't null, null if there are none. Values of
    1,024 and more, and those that aren't finite, are added as doubles."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    fits = F.abs(x) < _LARGE
    units = F.when(fits, x) * _FIRST
    parts = []
    for _ in range(3):
        whole = F.floor(units)
        parts.append(F.sum(whole).cast("double"))
        units = (units - whole) * _NEXT
    small = parts[0] / _FIRST + (parts[1] / (_FIRST * _NEXT) + parts[2] / (_FIRST * _NEXT * _NEXT))
    large = F.sum(F.when(~fits, x))
    return F.when(large.isNull(), small).otherwise(large + F.coalesce(small, F.lit(0.0)))


def exact_avg(value: Column | str) -> Column:
    """The mean of the values that aren't null, null if there are none."""
    return exact_sum(value) / F.nullif(F.count(value), F.lit(0))
