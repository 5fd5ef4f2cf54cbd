"""Dates as day numbers, money as whole cents, and the opt-in arithmetic modulo a prime."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2000-01-01 as days since 1970-01-01.
DAYS_TO_2000 = 10957
#: The modulus whose wrap-around the mod_ functions reproduce.
PRIME = 65537


def days_since_2000(day: Column) -> Column:
    return F.unix_date(day.cast("date")) - DAYS_TO_2000


def from_days_2000(days: Column) -> Column:
    return F.date_from_unix_date((days + DAYS_TO_2000).cast("int"))


def cents(amount: Column) -> Column:
    """A money or rate column in hundredths, as a long: sums of it do not depend on their order."""
    return F.round(amount * 100).cast("long")


def mod_p(x: Column, p: int = PRIME) -> Column:
    """The value that arithmetic modulo p would show; sums and products may be reduced at the end."""
    return F.pmod(x, F.lit(p)).cast("long")


def mod_signed(x: Column, p: int = PRIME) -> Column:
    """The representative of x nearest to zero."""
    r = F.pmod(x, F.lit(p))
    return F.when(r > (p - 1) // 2, r - p).otherwise(r).cast("long")


def mod_less(a: Column, b: Column, p: int = PRIME) -> Column:
    """Less-than as the upper half of the residues of a - b: a < b only while they differ by at most (p - 1) / 2."""
    return F.pmod(a - b, F.lit(p)) > (p - 1) // 2


def vector_add(a: Column, b: Column, p: int = PRIME) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(p)))


def vector_sub(a: Column, b: Column, p: int = PRIME) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(p)))


def vector_mul(a: Column, b: Column, p: int = PRIME) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(x * y, F.lit(p)))


def vector_rotate(a: Column, steps: int) -> Column:
    """Cyclic rotation to the left; by any number of steps, to the right if negative."""
    n = F.size(a)
    k = F.when(n > 0, F.pmod(F.lit(steps), n)).otherwise(0)
    return F.concat(F.slice(a, k + 1, n), F.slice(a, F.lit(1), k))
