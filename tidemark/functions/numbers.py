"""Expressions on numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def euros(price: Column, rate: float = 0.908) -> Column:
    """price times rate in single precision, cut to a whole number."""
    return (price.cast("float") * F.lit(rate).cast("float")).cast("long")


def slice_end(t: Column, width: int) -> Column:
    """End of the slice of that width in which t lies."""
    return (F.floor(t / width) + 1) * width


def share(rank: Column, degree: Column) -> Column:
    """What a page passes on along each link, in whole numbers: five sixths of its rank over its links."""
    return F.floor((rank * 5) / (degree * 6)).cast("long")


def near(a: Column, b: Column, tolerance: float = 0.1) -> Column:
    return F.abs(a - b) < tolerance


def dilated(t: Column, factor: int) -> Column:
    """Model time of a processing time that runs factor times slower."""
    return t * factor


def contracted(t: Column, factor: int) -> Column:
    """The processing time of a model time."""
    return F.floor(t / factor).cast("long")


def elbow(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """How far (x0, y0) lies off the line through two points, over the square of their distance once more."""
    return F.abs((y2 - y1) * x0 - (x2 - x1) * y0 + x2 * y1 - y2 * x1) / (F.pow(y2 - y1, F.lit(2)) + F.pow(x2 - x1, F.lit(2)))


def bin_of(key: Column, bits: int) -> Column:
    """The leading bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - bits)


@F.pandas_udf(IntegerType())
def collatz_steps(n: pd.Series) -> pd.Series:
    """Steps to 1, 1000 at most: whole batches in numpy, finished numbers drop out of the work."""
    x = n.to_numpy(np.int64).copy()
    steps = np.zeros(len(x), np.int32)
    live = np.flatnonzero(x > 1)
    for _ in range(1000):
        if not len(live):
            break
        v = x[live]
        x[live] = np.where(v & 1, 3 * v + 1, v >> 1)
        steps[live] += 1
        live = live[x[live] > 1]
    return pd.Series(steps)
