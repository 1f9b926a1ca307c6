"""Column helpers with the number types of print jobs: 32-bit floats step by step, unsigned 32-bit mixing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF
A4_CM = (21.0, 29.7)
CM_PER_INCH = 2.54


def f32(x: Column | float | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def fdiv(a: Column, b: Column) -> Column:
    """a / b rounded to a 32-bit float: Spark divides in double, and one cast of that is the correct rounding."""
    return (f32(a) / f32(b)).cast("float")


def trunc(x: Column) -> Column:
    return x.cast("long")


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division of values that are not negative."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a.cast("long"), b.cast("long"))


def cm_to_px(cm: Column, dpi: Column) -> Column:
    return trunc(fdiv(f32(cm) * f32(dpi), f32(CM_PER_INCH)) + f32(0.5))


def clamp(x: Column, low: Column | int, high: Column | int) -> Column:
    return F.greatest(F.least(x, F.lit(high) if isinstance(high, int) else high), F.lit(low) if isinstance(low, int) else low)


def mix32(state: Column, value: Column) -> Column:
    """One step of the 32-bit signature: state ^= value + 0x9e3779b9 + (state << 6) + (state >> 2)."""
    added = (value.bitwiseAND(F.lit(MASK32)) + F.lit(0x9E3779B9) + F.shiftleft(state, 6) + F.shiftright(state, 2)).bitwiseAND(F.lit(MASK32))
    return state.bitwiseXOR(added)


def byte_at(data: Column, i: Column | int) -> Column:
    """Byte i (from 0) of binary data as an int."""
    at = (i if isinstance(i, Column) else F.lit(i)).cast("int")
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(1))), 16, 10).cast("int")


def little_endian(data: Column, at: Column | int, size: int) -> Column:
    """An integer of ``size`` bytes from position ``at`` on; 8-byte values wrap into a signed long."""
    at = at if isinstance(at, Column) else F.lit(at)
    total = F.lit(0).cast("long")
    for k in range(size):
        total = total.bitwiseOR(F.shiftleft(byte_at(data, at + k).cast("long"), 8 * k))
    return total
