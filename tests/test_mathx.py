import math

from impactrank.functions import mathx
from pyspark.sql import functions as F


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(columns))).first()


def test_roots_of_several_functions(spark):
    """Bisection, false position and secant find the same roots; exact where a bound is one."""
    cube, wave = (lambda x: x * x * x - 20), (lambda x: F.cos(x) - x)
    for f, low, high, want in ((cube, 0.0, 5.0, 20 ** (1 / 3)), (wave, 0.0, 1.0, 0.7390851332151607), (lambda x: x - 3, 3.0, 9.0, 3.0)):
        rising = f if f is not wave else (lambda x: -wave(x))
        got = one(spark, mathx.bisect_root(rising, F.lit(low), F.lit(high)), mathx.regula_falsi_root(f, F.lit(low), F.lit(high)), mathx.secant_root(f, F.lit(low + 0.1), F.lit(high)))
        assert all(abs(x - want) < 1e-9 for x in got)


def test_descent_and_sums_of_logarithms(spark):
    got = one(spark, mathx.descend(lambda x: 2 * (x - 7), F.lit(0.0), 0.25, 200), mathx.log_add(F.lit(-1000.0), F.lit(-1000.0)))
    assert abs(got[0] - 7) < 1e-9 and abs(got[1] - (math.log(2) - 1000)) < 1e-9


def test_shift_generator_keeps_to_64_bits(spark):
    def plain(x):
        x ^= (x << 13) & (2**64 - 1)
        x ^= x >> 7
        return x ^ ((x << 17) & (2**64 - 1))

    for seed in (1, 88172645463325252, 2**63 - 1):
        got = one(spark, mathx.xorshift(F.lit(seed).cast("long")))[0]
        assert got % 2**64 == plain(seed)
