import numpy as np
import pytest

from lectern.functions.stats import bootstrap_mean, clopper_pearson, fisher_exact, histogram_bootstrap, jeffreys


@pytest.mark.parametrize("k,n,low,high", [(21, 61, 0.2273, 0.4769), (0, 90, 0, 0.0402), (1, 50, 0.0005, 0.1065), (0, 87, 0, 0.0415)])
def test_exact_intervals(k, n, low, high):
    assert np.round(clopper_pearson(k, n), 4) == pytest.approx((low, high))


def test_edges_and_fisher():
    assert np.isnan(clopper_pearson(0, 0)).all() and clopper_pearson(5, 5)[1] == 1.0
    assert fisher_exact(27, 22, 14, 42) == pytest.approx(0.0025, abs=5e-5) and fisher_exact(3, 0, 0, 3) == pytest.approx(0.1)
    low, high = jeffreys(5, 10)
    assert low < 0.5 < high and low + high == pytest.approx(1.0)


def test_bootstraps_agree():
    values = [0.0] * 30 + [1.0] * 10
    a = bootstrap_mean(values)
    b = histogram_bootstrap(np.array([0.0, 1.0]), np.array([30, 10]), np.ones(2), 4000, 1)
    assert a == pytest.approx(b, abs=0.03) and np.isnan(bootstrap_mean([])).all() and np.isnan(histogram_bootstrap(np.array([]), np.array([]), np.array([]), 10, 1)).all()
