"""Numeric helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def sign(x: Column) -> Column:
    return F.signum(x)


def lowest_bit(x: Column) -> Column:
    """Place of the lowest set bit from 0; 64 for zero."""
    return F.bit_count(x.bitwiseAND(-x) - F.lit(1).cast("long"))


def floor_log2(x: Column) -> Column:
    """0 for 0 and 1."""
    return F.when(x < 2, F.lit(0)).otherwise(F.length(F.bin(x)) - 1)


def bits_to_hold(x: Column) -> Column:
    """Bits that a number needs: 0 for 0, 1 for 1, 2 for 2 and 3."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def log_base(base: float, x: Column) -> Column:
    return F.log(base, x)


def power_of_two(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), p.cast("int"))


def power_of_two_or_zero(p: Column) -> Column:
    """As power_of_two, but 0 for 0."""
    return F.when(p == 0, F.lit(0).cast("long")).otherwise(power_of_two(p))


def largest(*xs: Column) -> Column:
    return F.greatest(*xs)


def smallest(*xs: Column) -> Column:
    return F.least(*xs)


def xorshift(x: Column) -> Column:
    """The next number of the 64-bit xorshift generator with shifts 13, 7 and 17."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it: within a lambda Spark computes each mention anew."""
    return F.transform(F.array(value), then)[0]


def bisect_root(f, low: Column, high: Column, steps: int = 60) -> Column:
    """A root of a rising Column function between two bounds by bisection."""
    span = F.struct(low.cast("double").alias("low"), high.cast("double").alias("high"))

    def halve(s: Column, _: Column) -> Column:
        return let((s["low"] + s["high"]) / 2, lambda mid: F.when(f(mid) < 0, F.struct(mid.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), mid.alias("high"))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), span, halve, lambda s: (s["low"] + s["high"]) / 2)


def _steps(n: int, begin: Column, onward, result) -> Column:
    """A state carried through ``n`` steps."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), begin, lambda s, _: onward(s), result)


def regula_falsi_root(f, low: Column, high: Column, steps: int = 60) -> Column:
    """A root between two bounds at which a Column function differs in sign, by false position; a bound that stays put twice counts half (Illinois)."""
    low, high = low.cast("double"), high.cast("double")
    begin = F.struct(low.alias("a"), f(low).cast("double").alias("fa"), high.alias("b"), f(high).cast("double").alias("fb"), F.lit(0).alias("side"))

    def onward(s: Column) -> Column:
        c = F.when(s["fa"] == s["fb"], s["b"]).otherwise((s["a"] * s["fb"] - s["b"] * s["fa"]) / (s["fb"] - s["fa"]))
        return let(c, lambda c: let(f(c).cast("double"), lambda fc: at(s, c, fc)))

    def at(s: Column, c: Column, fc: Column) -> Column:
        state = lambda a, fa, b, fb, side: F.struct(a.alias("a"), fa.alias("fa"), b.alias("b"), fb.alias("fb"), F.lit(side).alias("side"))
        upper = state(s["a"], F.when(s["side"] == 1, s["fa"] / 2).otherwise(s["fa"]), c, fc, 1)
        lower = state(c, fc, s["b"], F.when(s["side"] == -1, s["fb"] / 2).otherwise(s["fb"]), -1)
        return F.when(fc * s["fb"] > 0, upper).otherwise(lower)

    return _steps(steps, begin, onward, lambda s: F.when(F.abs(s["fa"]) < F.abs(s["fb"]), s["a"]).otherwise(s["b"]))


def secant_root(f, first: Column, second: Column, steps: int = 40) -> Column:
    """A root near two guesses by the secant method; it stays where two values are equal."""
    first, second = first.cast("double"), second.cast("double")
    begin = F.struct(first.alias("x"), second.alias("y"))

    def onward(s: Column) -> Column:
        further = lambda fx, fy: F.when(fx == fy, s["y"]).otherwise(s["y"] - fy * (s["y"] - s["x"]) / (fy - fx))
        return F.struct(s["y"].alias("x"), let(f(s["x"]).cast("double"), lambda fx: let(f(s["y"]).cast("double"), lambda fy: further(fx, fy))).alias("y"))

    return _steps(steps, begin, onward, lambda s: s["y"])


def descend(slope, start: Column, rate: float = 0.1, steps: int = 100) -> Column:
    """The place to which gradient descent comes from ``start``; ``slope`` is the function's derivative as a Column function."""
    return _steps(steps, start.cast("double"), lambda x: x - rate * slope(x).cast("double"), lambda x: x)
