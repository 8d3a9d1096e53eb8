import math

import pytest

from oreline.functions import tails
from oreline.operators import hypothesis as hy


def test_tails_against_the_textbook():
    assert tails.t_two_sided(1.96, 1e5) == pytest.approx(0.05, abs=1e-4)
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi2_upper(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi2_upper(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    for x in (0.3, 2.0, 9.0, 40.0):
        assert tails.chi2_upper(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-10)
    assert tails.f_upper(1, 10, 10) == pytest.approx(0.5, abs=1e-9)
    assert tails.f_upper(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi2_upper(1e6, 1e6) == pytest.approx(0.5, abs=1e-3)
    assert tails.t_two_sided(1.96, 1e9) == pytest.approx(0.0499958, abs=1e-6)


def groups(spark, *samples):
    return spark.createDataFrame([(f"g{i}", float(v)) for i, s in enumerate(samples) for v in s], "g string, v double")


def test_t(spark):
    far = hy.t_test_welch(groups(spark, [5, 6, 7, 5, 6, 7], [9, 10, 11, 9, 10, 11]), "v", "g").first()
    assert far.significant and far.p_value < 0.001 and far.mean_a == 6.0
    near = hy.t_test_welch(groups(spark, [5, 6, 5, 6, 5, 6], [5, 6, 5, 6, 6, 5]), "v", "g").first()
    assert not near.significant and near.p_value == 1.0


def test_anova_chi2_correlation(spark):
    a = hy.anova_oneway(groups(spark, [1, 2, 1, 2], [5, 6, 5, 6], [9, 8, 9, 8]), "v", "g").first()
    assert a.significant and (a.df1, a.df2) == (2, 9)
    df = spark.createDataFrame([("x", "a")] * 5 + [("y", "b")] * 5, "a string, b string")
    c = hy.chi2_independence(df, "a", "b").first()
    assert c.significant and c.cramers_v == 1.0 and c.statistic == 10.0 and c.df == 1
    r = hy.correlation_test(spark.createDataFrame([(float(i), 2.0 * i) for i in range(1, 7)], "x double, y double"), "x", "y").first()
    assert r.r == 1.0 and r.p_value == 0.0 and r.strength == "strong"


def test_jarque_bera(spark):
    df = spark.createDataFrame([(float(v),) for v in [1] * 8 + [2, 3, 10, 50, 100]], "v double")
    r = hy.jarque_bera(df, "v").first()
    assert r.skewness > 0.5 and r.significant
