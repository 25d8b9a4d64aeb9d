"""The exact two-sample tail of large samples against closed forms."""

import math

import pytest

from stridewell.operators import models as L


def test_equal_sizes():
    # Gnedenko and Korolyuk: of two samples of n, by reflection at both ends of the band.
    n, h = 12_000, 150
    ways = lambda k: math.exp(2 * math.lgamma(n + 1) - math.lgamma(n - k + 1) - math.lgamma(n + k + 1))
    want = 2 * sum((-1) ** (k - 1) * ways(k * h) for k in range(1, n // h + 1))
    assert L.ks_two_sided(h / n, n, n) == pytest.approx(want, rel=1e-8)


def test_one_among_many():
    # The one lies anywhere among the others with equal chance.
    assert L.ks_two_sided(0.9, 20_000, 1) == pytest.approx(2 * 2001 / 20_001, rel=1e-10)


def test_beyond_the_limit(monkeypatch):
    exact = L.ks_two_sided(0.02, 9000, 8000)
    monkeypatch.setattr(L, "EXACT", 10**6)
    assert L.ks_two_sided(0.02, 9000, 8000) == L.ks_tail(0.02, 9000, 8000) != exact
