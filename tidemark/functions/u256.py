"""256-bit integers as 32 big-endian bytes: comparison, MIN, MAX, grouping and DISTINCT work on the bytes themselves.

Arithmetic runs on Arrow batches in Python, the only place where it has to; SUM splits each value into eight 32-bit limbs,
adds the limbs with native aggregates, and carries once at the end.
"""

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from tidemark.plans.evaluate import apply

WIDTH = 32
FLAGGED = StructType([StructField("v", BinaryType()), StructField("err", BooleanType())])


def encode(value: int) -> bytes:
    return int(value).to_bytes(WIDTH, "big")


def decode(data: bytes) -> int:
    return int.from_bytes(data, "big")


def literal(value: int) -> Column:
    return F.lit(bytearray(encode(value)))


def widen(number: Column) -> Column:
    """A non-negative BIGINT or DECIMAL(38,0) as 32 bytes."""
    base = F.lit(1 << 60).cast("decimal(38,0)")
    x = number.cast("decimal(38,0)")
    low = x % base
    rest = (x - low) / base
    rest = rest.cast("decimal(38,0)")
    middle, top = rest % base, (rest - rest % base) / base
    # 60-bit digits in hex: 15 places each.
    digits = F.concat(*[F.lpad(F.hex(v.cast("bigint")), 15, "0") for v in (top, middle, low)])
    return F.unhex(F.lpad(digits, 2 * WIDTH, "0"))


def narrow(value: Column) -> Column:
    """A 32-byte integer below 10^38 as DECIMAL(38,0); null if it is greater."""
    base = F.lit(1 << 56).cast("decimal(38,0)")
    digit = lambda at, n: F.conv(F.hex(F.substring(value, at, n)), 16, 10).cast("decimal(38,0)")
    high, middle, low = digit(17, 2), digit(19, 7), digit(26, 7)
    fits = F.substring(value, 1, 16) == F.lit(bytearray(16))
    return F.when(fits, F.try_add(F.try_multiply(F.try_add(F.try_multiply(high, base), middle).cast("decimal(38,0)"), base), low).cast("decimal(38,0)"))


def _operation(op: str) -> Callable:
    @F.pandas_udf(FLAGGED)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [(None, None) if x is None or y is None else apply(op, decode(x), decode(y)) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"v": [None if v is None else encode(v) for v, _ in got], "err": [f for _, f in got]})

    return run


def arithmetic(op: str, a: Column, b: Column) -> tuple[Column, Column]:
    """Value and error flag of + - * / % on 32-byte integers."""
    got = _operation(op)(a, b)
    return got["v"], got["err"]


def limb_sums(value: Column) -> list[Column]:
    """Native sums of the eight 32-bit limbs, most significant first. DECIMAL(18,0) terms give DECIMAL(28,0) sums: room for 10^18 rows."""
    return [F.sum(F.conv(F.hex(F.substring(value, 4 * k + 1, 4)), 16, 10).cast("decimal(18,0)")) for k in range(8)]


@F.pandas_udf(FLAGGED)
def carry(limbs: pd.Series) -> pd.DataFrame:
    """The sum from its limb sums (an array, most significant first), modulo 2^256, and whether it wrapped."""
    out = []
    for x in limbs:
        if x is None or any(v is None for v in x):
            out.append((None, False))
            continue
        total = 0
        for v in x:
            total = (total << 32) + int(v)
        out.append((encode(total % (1 << 256)), total >= 1 << 256))
    return pd.DataFrame(out, columns=["v", "err"])


@F.pandas_udf(BinaryType())
def divide(total: pd.Series, count: pd.Series) -> pd.Series:
    """floor(total / count), null where total is."""
    return pd.Series([None if t is None else encode(decode(t) // int(n)) for t, n in zip(total, count, strict=True)])
