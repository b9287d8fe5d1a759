import math

import pytest
from pyspark.sql import functions as F

from sparkcell.functions.scalar import chi2_sf, gamma_q, normal_sf, p_adjust, t_two_sided


def test_tails():
    assert normal_sf(1.959963985) == pytest.approx(0.025, abs=1e-9)
    assert chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(11.070497694, 5) == pytest.approx(0.05, abs=1e-9)
    assert gamma_q(0.5, 0.5) == pytest.approx(math.erfc(math.sqrt(0.5)), abs=1e-12)
    assert t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)


def test_p_adjust_by_hand(spark):
    p = [0.01, 0.04, 0.03, 0.005, None]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    get = lambda m: [r.q for r in p_adjust(df, "p", "q", method=m).orderBy("i").collect()]
    assert get("holm") == pytest.approx([0.03, 0.06, 0.06, 0.02, None])
    assert get("bh") == pytest.approx([0.02, 0.04, 0.04, 0.02, None])
    assert get("bonferroni") == pytest.approx([0.04, 0.16, 0.12, 0.02, None])
    with pytest.raises(ValueError):
        p_adjust(df, "p", "q", method="other")
    assert p_adjust(df.where(F.lit(False)), "p", "q").count() == 0
