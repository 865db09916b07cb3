import math

from pyspark.sql import functions as F

from plumbline.functions import vectors as V


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def array(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_softmax_is_stable_and_sums_to_one(spark):
    r = one(spark, p=V.softmax(array(1000, 1001)), n=V.softmax(F.lit(None).cast("array<double>")))
    assert abs(sum(r.p) - 1) < 1e-12 and abs(r.p[1] / r.p[0] - math.e) < 1e-9 and r.n is None


def test_temperature_one_is_identity(spark):
    r = one(spark, p=V.temperature(array(0.2, 0.8), F.lit(1.0)), q=V.temperature(array(0.2, 0.8), F.lit(100.0)))
    assert r.p == [0.2, 0.8] and abs(r.q[0] - 0.5) < 0.01


def test_rotation_round_trip(spark):
    for rot in range(4):
        r = one(spark, x=V.rotate_back(V.rotate(array(1, 2, 3, 4), F.lit(rot)), F.lit(rot)))
        assert r.x == [1, 2, 3, 4]


def test_first_of_equal_tops_and_last_bin(spark):
    r = one(spark, top=V.top(array(0.4, 0.4, 0.2)), bin=V.bin10(F.lit(1.0)), low=V.bin10(F.lit(0.1)))
    assert (r.top, r.bin, r.low) == (0, 9, 1)


def test_wilson_of_nothing_is_zero(spark):
    low, high = V.wilson(F.lit(0), F.lit(0))
    r = one(spark, low=low, high=high)
    assert (r.low, r.high) == (0.0, 0.0)


def test_rps(spark):
    r = one(spark, rps=V.ranked_probability_score(array(0.2, 0.3, 0.5), F.lit(1)))
    assert abs(r.rps - (0.04 + 0.25)) < 1e-12
