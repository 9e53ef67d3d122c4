"""numpy kernels against brute force and known answers."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.functions import geometry, kernels
from tessera.operators import markers, resolve


@pytest.mark.parametrize("move", [(3, -2), (0, 4), (-5, 1), (0, 0)])
def test_phase_correlation_finds_a_shift(move):
    truth = kernels.gaussian(np.random.default_rng(0).uniform(0, 1, (60, 60)), 2)
    fixed = truth[10:50, 10:50]
    moving = truth[10 - move[0] : 50 - move[0], 10 - move[1] : 50 - move[1]]
    t, quality = kernels.phase_correlation(fixed, moving)
    assert np.abs(t - np.array(move)).max() <= 0.5
    assert quality > 0.95


def test_phase_correlation_with_pixels_outside():
    truth = kernels.gaussian(np.random.default_rng(3).uniform(0, 1, (60, 60)), 2)
    fixed, moving = truth[10:50, 10:50].copy(), truth[8:48, 13:53].copy()
    fixed[:6], moving[:, -5:] = np.nan, np.nan
    t, _ = kernels.phase_correlation(fixed, moving)
    assert np.abs(t - np.array([2, -3])).max() <= 0.5


def test_variants_of_a_pair_are_ranked_once(monkeypatch):
    truth = kernels.gaussian(np.random.default_rng(3).uniform(0, 1, (60, 60)), 2)
    fixed, moving = truth[10:50, 10:50].copy(), truth[8:48, 13:53].copy()
    fixed[:6], moving[:, -5:] = np.nan, np.nan
    calls, ranked, read = [], kernels.spearman, kernels.resample
    monkeypatch.setattr(kernels, "spearman", lambda a, b: calls.append("rank") or ranked(a, b))
    monkeypatch.setattr(kernels, "resample", lambda *a, **b: calls.append("read") or read(*a, **b))
    t, quality = kernels.phase_correlation(fixed, moving)
    moved = read(moving, np.eye(2), t, moving.shape)
    both = ~np.isnan(fixed) & ~np.isnan(moved)
    assert np.isclose(quality, ranked(fixed[both], moved[both])) and len(calls) == 1


@pytest.mark.parametrize("shape", [(7, 9), (1, 6), (4, 5, 6)])
def test_shifts_together_are_those_one_by_one(shape, monkeypatch):
    rng = np.random.default_rng(2)
    image = np.where(rng.uniform(size=shape) < 0.1, np.nan, rng.uniform(0, 1, shape))
    moves = np.r_[rng.uniform(-3, 3, (6, len(shape))), np.zeros((1, len(shape)))]
    found = kernels.shifted_all(image, moves)
    for t, x in zip(moves, found, strict=True):
        assert np.array_equal(x, kernels.resample(image, np.eye(len(shape)), t, shape), equal_nan=True)
    other = np.roll(image, 1, axis=0)
    whole = kernels.phase_correlation(image, other)
    monkeypatch.setattr(kernels, "SHIFTED_PIXELS", 1)
    single = kernels.phase_correlation(image, other)
    assert np.array_equal(whole[0], single[0]) and np.isclose(whole[1], single[1], equal_nan=True)


def test_constant_images_have_no_quality():
    t, quality = kernels.phase_correlation(np.ones((8, 8)), np.ones((8, 8)))
    assert (t == 0).all() and np.isnan(quality)


@given(st.lists(st.integers(0, 5), min_size=2, max_size=12), st.integers(0, 99))
@settings(max_examples=30, deadline=None)
def test_ranks(values, seed):
    x = np.array(values, float)
    brute = [np.mean([r + 1 for r, v in enumerate(sorted(values)) if v == u]) for u in values]
    assert np.allclose(kernels.average_ranks(x), brute)


def test_resample_is_linear_and_marks_the_outside():
    image = np.arange(12.0).reshape(3, 4)
    out = kernels.shifted(image, (0.5, 0.25))
    assert np.isclose(out[0, 0], image[0, 0] * 0.375 + image[0, 1] * 0.125 + image[1, 0] * 0.375 + image[1, 1] * 0.125)
    assert np.isnan(out[2]).all() and np.isnan(out[:, 3]).all()
    assert np.allclose(kernels.shifted(image, (0, 0)), image)


def test_volumes():
    eye, turn = np.eye(3), np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    box = lambda lo, hi, m: geometry.halfspaces(np.array(lo, float), np.array(hi, float), m)
    assert geometry.volume(np.concatenate([box((0, 0), (4, 3), eye), box((1, 1), (9, 9), eye)])) == pytest.approx(6)
    assert geometry.volume(np.concatenate([box((0, 0), (4, 3), eye), box((4, 0), (9, 3), eye)])) == -1
    assert geometry.volume(np.concatenate([box((0, 0), (2, 2), eye), box((0, -2), (2, 0), turn)])) == pytest.approx(4)
    cube = np.eye(4)
    assert geometry.volume(np.concatenate([box((0, 0, 0), (2, 3, 4), cube), box((1, 1, 1), (9, 9, 9), cube)])) == pytest.approx(6)


def test_spots_are_found_once():
    image = np.zeros((40, 40))
    image[10, 12] = image[30, 25] = 100
    found = kernels.spots(kernels.gaussian(image, 1.0), [1, 1], 3.0)
    assert found.tolist() == [[10, 12], [30, 25]]


def test_content_weights_prefer_the_sharp_view():
    sharp = np.random.default_rng(0).uniform(0, 1, (40, 40))
    views = np.stack([sharp, kernels.gaussian(sharp, 2)])
    for weights in (kernels.content_weights(views, 2, 4), kernels.dct_weights(views)):
        assert np.allclose(weights.sum(axis=0), 1)
    assert kernels.content_weights(views, 2, 4)[0].mean() > 0.6


def test_deconvolution_sharpens():
    truth = np.zeros((32, 32))
    truth[16, 16] = truth[8, 20] = 10
    psf = kernels.gaussian_psf(1.0, 2)
    blurred = kernels._convolve(truth, psf)
    for kind in ("independent", "efficient_bayesian", "optimization_i", "optimization_ii"):
        out = kernels.deconvolve(np.stack([blurred, blurred]), np.full((2, 32, 32), 0.5), [psf, psf], 10, kind)
        assert ((out - truth) ** 2).sum() < ((blurred - truth) ** 2).sum()


@pytest.mark.parametrize("kind", ["translation", "rigid", "similarity", "affine"])
def test_fit_recovers_transforms(kind):
    r = np.random.default_rng(1)
    src, angle = r.normal(size=(9, 2)), 0.4
    linear = {"translation": np.eye(2), "affine": np.array([[1.2, 0.3], [-0.1, 0.8]])}.get(kind, np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]]) * (1.5 if kind == "similarity" else 1))
    m = resolve.fit(kind, src, src @ linear.T + [2, -1])
    assert np.allclose(m[:2, :2], linear) and np.allclose(m[:2, 2], [2, -1])


def test_ransac_leaves_outliers_out():
    r = np.random.default_rng(2)
    src = r.uniform(0, 20, (20, 2))
    dst = src + [3, 4]
    dst[:6] = r.uniform(0, 20, (6, 2))
    m, quality = markers.ransac(src, dst, "rigid", 0.5)
    assert np.allclose(m[:2, 2], [3, 4], atol=1e-6) and quality > 0.6
    assert markers.ransac(src[:1], dst[:1], "affine", 0.5) is None


def test_two_pass_rejects_an_outlier():
    import pandas as pd

    eye = np.eye(3)
    rows = [(a, b, [0.0, 0.0], [10.0, 10.0], 0.9, 5.0, eye.ravel().tolist()) for a in range(5) for b in range(a + 1, 5)]
    off = eye.copy()
    off[:2, 2] = 9
    rows[3] = (*rows[3][:6], off.ravel().tolist())
    edges = pd.DataFrame(rows, columns=["src", "dst", "bbox_lower", "bbox_upper", "quality", "overlap", "transform"])
    for solver in (resolve.two_pass, resolve.relaxed):
        out = solver(edges, list(range(5)), 2)
        assert max(np.abs(m - eye).max() for m in out.values()) < 0.05


def test_sparse_differences_equal_dense_ones():
    from tessera.functions.laplacian import sparse_differences

    r = np.random.default_rng(1)
    for links in (200, 700):
        pairs = r.integers(0, 250, (links, 2))
        w, b = r.random(links) * (r.random(links) < 0.8), r.normal(size=(links, 2))
        want = resolve._differences(pairs, b, w, 250, 7)
        for most in (10**9, 0):
            assert np.abs(sparse_differences(pairs, b, w, 250, 7, most) - want).max() < 1e-8


def test_two_pass_of_a_long_strip_takes_no_square_of_its_views():
    import tracemalloc

    import pandas as pd

    n, eye = 2500, np.eye(3)
    truth = np.random.default_rng(2).integers(-3, 4, (n, 2)).astype(float)
    rows = []
    for a in range(n):
        for c in (a + 1, a + 9, a + 10, a + 11):
            if c < n:
                m = eye.copy()
                m[:2, 2] = truth[a] - truth[c]
                rows.append((a, c, [0.0, 0.0], [10.0, 10.0], 0.5, 45.0, m.ravel().tolist()))
    edges = pd.DataFrame(rows, columns=["src", "dst", "bbox_lower", "bbox_upper", "quality", "overlap", "transform"])
    tracemalloc.start()
    try:
        out = resolve.two_pass(edges, list(range(n)), 2, 0)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8 * n * n
    assert max(np.abs(out[v][:2, 2] - (truth[v] - truth[0])).max() for v in out) < 1e-6


def test_nearest_points_equal_brute_force():
    from tessera.functions.nearest import nearest

    r = np.random.default_rng(3)
    for points in (r.normal(size=(700, 6)), r.integers(0, 9, (700, 2)).astype(float), np.zeros((300, 2)), np.zeros((0, 2))):
        ids = r.permutation(len(points))
        queries = r.normal(size=(150, 6)) if points.shape[1] == 6 else points[:150]
        for k, most in ((1, np.inf), (5, np.inf), (5, 1.0)):
            d2, at = nearest(points, ids, queries, k, most, 16)
            for x, d, p in zip(queries, d2, at, strict=True):
                apart = sum((x[c] - points[:, c]) ** 2 for c in range(points.shape[1]))
                want = np.lexsort((ids, apart))
                want = want[apart[want] <= most * most][:k]
                assert p[: len(want)].tolist() == want.tolist() and (p[len(want) :] == -1).all()
                assert np.array_equal(d[: len(want)], apart[want])
