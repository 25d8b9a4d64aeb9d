"""Published tables of designs: what follows from their own columns, and what this library makes of the same numbers."""

import numpy as np
import pytest

from stridewell.operators import designs as D
from stridewell.operators import evaluation as E
from stridewell.operators import models as L

#: Source, SS, ddof1, ddof2, MS, F, p, p corrected, np2, eps.
ANOVA = [
    ("device_combo", 1.2423034478167798, 6, 24, 0.20705057463612997, 2.541271039486758, 0.04766345253239806, 0.15787016182421837, 0.3884980494075585, 0.2630495523594696),
    ("motion_combo", 4.703366174116965, 14, 56, 0.3359547267226404, 6.950039225295786, 5.646451437137303e-08, 0.010067527840617594, 0.6347045049154195, 0.17871991172743526),
    ("device_combo * motion_combo", 2.37116717739016, 84, 336, 0.02822818068321619, 0.6325142287223392, 0.9936922017828735, 0.5547292524253025, 0.1365380002074572, 0.023595215963091196),
]
#: Dof, Q, p of Cochran's test.
COCHRAN = [(2, 0.7867648702059862, 0.6747706422549421), (59, 141.62675832478075, 9.510629610985643e-09)]
#: The least p of 105 pairs of conditions, and what Holm's correction makes of it.
HOLM = (105, 0.0001785436555466713, 0.018747083832400487)


@pytest.mark.parametrize("row", ANOVA, ids=[r[0] for r in ANOVA])
def test_table_of_variances(row):
    _, ss, d1, d2, ms, f, p, corrected, np2, eps = row
    assert ss / d1 == pytest.approx(ms, rel=1e-12) and f * d1 / (f * d1 + d2) == pytest.approx(np2, rel=1e-12)
    assert L.f_tail(f, d1, d2) == pytest.approx(p, rel=1e-9) and L.f_tail(f, d1 * eps, d2 * eps) == pytest.approx(corrected, rel=1e-9)


@pytest.mark.parametrize("dof, q, p", COCHRAN)
def test_tails_of_chi_square(dof, q, p):
    assert L.chi2_tail(q, dof) == pytest.approx(p, rel=1e-9)


def test_holm_order(spark):
    n, least, corrected = HOLM
    table = spark.createDataFrame([(1, least)] + [(1, 0.001 * k) for k in range(1, n)], "g int, p double")
    assert min(r.p_holm for r in E.holm(table, ["g"]).collect()) == pytest.approx(corrected, rel=1e-12)


def test_made_tables_keep_the_same_rules(spark):
    rng = np.random.default_rng(3)
    rows = [(s, f"a{a}", f"b{b}", float(rng.normal() + a + s * 0.1)) for s in range(8) for a in range(3) for b in range(4)]
    cube = np.array([r[3] for r in rows]).reshape(8, 3, 4)
    got = {r.source: r for r in D.rm_table(spark.createDataFrame(rows, "subject int, a string, b string, value double")).collect()}
    assert len(got) == 3
    for r in got.values():
        assert r.ms == pytest.approx(r.ss / r.df1) and r.np2 == pytest.approx(r.f * r.df1 / (r.f * r.df1 + r.df2))
    means = cube.mean((0, 2)) - cube.mean()
    assert got["a"].ss == pytest.approx(8 * 4 * (means**2).sum())
    error = ((cube.mean(2) - cube.mean((1, 2))[:, None] - cube.mean((0, 2))[None] + cube.mean()) ** 2).sum() * 4
    assert got["a"].f == pytest.approx(got["a"].ss / 2 / (error / 14))
