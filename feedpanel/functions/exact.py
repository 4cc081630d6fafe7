"""Sums of doubles without rounding errors.

A value is cut into whole numbers of ever smaller units, 32 bits each. Whole numbers
add up exactly in any order, so running sums, their differences and sums of parts
are exact as well; one rounding happens when the result is put together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 32
#: Three cuts reach 2^-95 of the largest value, beyond the last bit of any that is not below 2^-42 of it.
CUTS = 3


def unit_of(largest: float | None) -> float:
    """Unit of the first cut for values up to ``largest``: a power of two. A sum may
    have 2^30 terms."""
    return 2.0 ** (math.frexp(largest)[1] - _BITS) if largest else 1.0


def cuts(value: Column, unit: float) -> list[Column]:
    """Whole numbers k0, k1, k2 with value = (k0 + k1 / 2^32 + k2 / 2^64) * unit."""
    rest, out = value.cast("double") / F.lit(unit), []
    for i in range(CUTS):
        part = F.floor(rest) if i < CUTS - 1 else F.rint(rest).cast("bigint")
        out.append(part)
        rest = (rest - part) * F.lit(2.0**_BITS)
    return out


def put_together(parts: Sequence[Column], unit: float) -> Column:
    """The double nearest to a sum of cuts."""
    low = F.lit((1 << _BITS) - 1).cast("bigint")
    whole, out = parts[CUTS - 1], F.lit(0.0)
    for part in reversed(parts[: CUTS - 1]):
        # what does not fit into 32 bits is carried over
        out = (out + whole.bitwiseAND(low)) / F.lit(2.0**_BITS)
        whole = part + F.shiftright(whole, _BITS)
    return (whole + out) * F.lit(unit)
