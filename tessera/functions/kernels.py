"""numpy kernels of single images: filters, resampling, similarity, shifts, spots, deconvolution. NaN is outside."""

from __future__ import annotations

from itertools import product

import numpy as np


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / max(sigma, 1e-12)) ** 2)
    return k / k.sum()


def convolve_axis(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation along an axis with half-sample symmetric borders."""
    r = len(kernel) // 2
    x = np.moveaxis(image, axis, -1)
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(r, r)], mode="symmetric")
    windows = np.lib.stride_tricks.sliding_window_view(padded, len(kernel), axis=-1)
    return np.moveaxis(windows @ kernel, -1, axis)


def gaussian(image: np.ndarray, sigma) -> np.ndarray:
    sigmas = np.broadcast_to(sigma, (image.ndim,))
    for d in range(image.ndim):
        if sigmas[d] > 0 and image.shape[d] > 1:
            image = convolve_axis(image, gaussian_kernel(float(sigmas[d])), d)
    return image


def nan_gaussian(image: np.ndarray, sigma) -> np.ndarray:
    """Normalised convolution; what is outside stays outside."""
    valid = ~np.isnan(image)
    top, bottom = gaussian(np.where(valid, image, 0.0), sigma), gaussian(valid.astype(float), sigma)
    return np.where(valid, top / np.maximum(bottom, 1e-12), np.nan)


def laplacian_of_gaussian(image: np.ndarray, sigma) -> np.ndarray:
    sigmas = np.broadcast_to(sigma, (image.ndim,))
    total = np.zeros(image.shape)
    for d in range(image.ndim):
        part = image
        for e in range(image.ndim):
            k = gaussian_kernel(float(sigmas[e]))
            if e == d:
                t = np.arange(-(len(k) // 2), len(k) // 2 + 1)
                k = k * (t**2 / sigmas[e] ** 4 - 1 / sigmas[e] ** 2)
            part = convolve_axis(part, k, e)
        total += part
    return total


def resample(image: np.ndarray, matrix: np.ndarray, offset: np.ndarray, shape: tuple[int, ...], fill: float = np.nan) -> np.ndarray:
    """Linear interpolation at input index = matrix @ output index + offset; ``fill`` outside of the input.

    Matrix and offset are rounded to 10 decimals, and offsets within 1e-6 of whole numbers snap to them.
    """
    n = image.ndim
    matrix, offset = np.round(matrix, 10), np.round(offset, 10)
    whole = np.round(offset)
    offset = np.where(np.abs(offset - whole) < 1e-6, whole, offset)
    grid = np.stack(np.meshgrid(*(np.arange(s, dtype=float) for s in shape), indexing="ij"), axis=-1)
    at = grid @ matrix.T + offset
    size = np.array(image.shape)
    ok = ((at >= -1e-9) & (at <= size - 1 + 1e-9)).all(axis=-1)
    at = np.clip(at, 0, size - 1)
    low = np.minimum(np.floor(at).astype(int), np.maximum(size - 2, 0))
    frac = at - low
    out = np.zeros(shape)
    for far in product((0, 1), repeat=n):
        w = np.prod([frac[..., d] if far[d] else 1 - frac[..., d] for d in range(n)], axis=0)
        index = tuple(np.minimum(low[..., d] + far[d], size[d] - 1) for d in range(n))
        out += np.where(w > 0, w * np.where(w > 0, image[index], 0.0), 0.0)
    return np.where(ok, out, fill)


def shifted_all(image: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The image read at index + t for each t of ``moves``, by the rules of ``resample``."""
    n, moves = image.ndim, np.round(np.asarray(moves, dtype=float), 10)
    whole = np.round(moves)
    moves = np.where(np.abs(moves - whole) < 1e-6, whole, moves)
    across = lambda x, d: x.reshape(len(moves), *(image.shape[d] if e == d else 1 for e in range(n)))
    ok, low, frac = True, [], []
    for d, size in enumerate(image.shape):
        at = np.arange(size, dtype=float) + moves[:, d, None]
        ok = ok & across((at >= -1e-9) & (at <= size - 1 + 1e-9), d)
        at = np.clip(at, 0, size - 1)
        low.append(np.minimum(np.floor(at).astype(int), max(size - 2, 0)))
        frac.append(at - low[d])
    out = np.zeros((len(moves), *image.shape))
    for far in product((0, 1), repeat=n):
        w, index = 1.0, []
        for d in range(n):
            w = w * across(frac[d] if far[d] else 1 - frac[d], d)
            index.append(across(np.minimum(low[d] + far[d], image.shape[d] - 1), d))
        out += np.where(w > 0, w * np.where(w > 0, image[tuple(index)], 0.0), 0.0)
    return np.where(ok, out, np.nan)


def shifted(image: np.ndarray, t) -> np.ndarray:
    """The image read at index + t."""
    return shifted_all(image, np.asarray(t, dtype=float)[None])[0]


def _box_mean(x: np.ndarray, w: int, n: int) -> np.ndarray:
    """Means of the windows of w entries along each of the last n axes."""
    for d in range(-n, 0):
        c = np.cumsum(x, axis=d)
        at = lambda *s, d=d: (..., slice(*s), *[slice(None)] * (-d - 1))
        top = c[at(w - 1, None)].copy()
        top[at(1, None)] -= c[at(None, x.shape[d] - w)]
        x = top / w
    return x


def similarities(a: np.ndarray, many: np.ndarray, span: float, window: int = 7) -> np.ndarray:
    """Mean structural similarity of ``a`` and each image of ``many`` over whole windows."""
    n = window**a.ndim
    mean = lambda x: _box_mean(x, window, a.ndim)
    ma, aa = mean(np.stack([a, a * a]))
    mb, bb, ab = mean(np.stack([many, many * many, a * many]))
    unbiased = n / max(n - 1, 1)
    va, vb = unbiased * (aa - ma * ma), unbiased * (bb - mb * mb)
    cov = unbiased * (ab - ma * mb)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return (((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).reshape(len(many), -1).mean(axis=1)


def structural_similarity(a: np.ndarray, b: np.ndarray, span: float, window: int = 7) -> float:
    """Mean structural similarity over whole windows."""
    return float(similarities(a, b[None], span, window)[0])


def average_ranks(x: np.ndarray) -> np.ndarray:
    value, place, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[place.reshape(-1)] if len(value) else np.zeros(0)


def spearman(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) < 2:
        return float("nan")
    ra, rb = average_ranks(a), average_ranks(b)
    return float("nan") if ra.std() == 0 or rb.std() == 0 else float(np.corrcoef(ra, rb)[0, 1])


def otsu(values: np.ndarray, bins: int = 256) -> float:
    """Threshold (a bin's centre) with the largest variance between the classes below and above it."""
    count, edge = np.histogram(values, bins)
    centre = (edge[1:] + edge[:-1]) / 2
    below, mass = np.cumsum(count), np.cumsum(count * centre)
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return float(centre[np.nanargmax(np.where((below > 0) & (above > 0), between, -1.0))])


def _peak(product_: np.ndarray, upsample: int) -> np.ndarray:
    """Place of the largest cross-correlation, refined on a grid of 1 / upsample by a local inverse transform."""
    shape = np.array(product_.shape)
    coarse = np.abs(np.fft.ifftn(product_))
    t = np.array(np.unravel_index(np.argmax(coarse), coarse.shape), dtype=float)
    t = np.where(t > shape // 2, t - shape, t)
    if upsample > 1:
        near = np.arange(-int(1.5 * upsample) // 2, int(1.5 * upsample) // 2 + 1) / upsample
        cube = product_
        for d in range(product_.ndim):
            wave = np.exp(2j * np.pi * np.outer(t[d] + near, np.fft.fftfreq(shape[d])))
            cube = np.moveaxis(np.tensordot(wave, cube, axes=(1, d)), 0, d)
        best = np.unravel_index(np.argmax(np.abs(cube)), cube.shape)
        t = t + near[np.array(best)]
    return t


def masked_correlation_shift(a: np.ndarray, b: np.ndarray, least: float = 0.3) -> np.ndarray:
    """Whole-pixel shift with the largest normalised correlation of valid pixels, where enough of them overlap."""
    size = tuple(x + y - 1 for x, y in zip(a.shape, b.shape, strict=True))
    ma, mb = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
    fa, fb = np.nan_to_num(a), np.nan_to_num(b)
    flip, axes = tuple(slice(None, None, -1) for _ in size), tuple(range(1, a.ndim + 1))
    xa = np.fft.rfftn(np.stack([ma, fa, fa**2]), size, axes)
    xb = np.fft.rfftn(np.stack([mb, fb, fb**2])[(slice(None), *flip)], size, axes)
    n, sa, sb, top, qa, qb = np.fft.irfftn(xa[[0, 1, 0, 1, 2, 0]] * xb[[0, 0, 1, 1, 0, 2]], size, axes)
    n = np.maximum(np.round(n), 0)
    some = np.maximum(n, 1)
    top = top - sa * sb / some
    va, vb = np.maximum(qa - sa**2 / some, 0), np.maximum(qb - sb**2 / some, 0)
    score = np.where((n >= least * n.max()) & (va * vb > 1e-12), top / np.sqrt(np.maximum(va * vb, 1e-12)), -np.inf)
    best = np.array(np.unravel_index(np.argmax(score), score.shape))
    return (best - (np.array(b.shape) - 1)).astype(float)


#: Pixels of shifted images that are held at a time, about.
SHIFTED_PIXELS = 1 << 16


def _boxes(masks: np.ndarray) -> np.ndarray:
    """(first, end) of what is set along each axis, for each of the masks."""
    out = np.zeros((len(masks), masks.ndim - 1, 2), np.int64)
    for d in range(masks.ndim - 1):
        seen = masks.any(axis=tuple(e for e in range(1, masks.ndim) if e != d + 1))
        out[:, d, 0], out[:, d, 1] = seen.argmax(axis=1), seen.shape[1] - seen[:, ::-1].argmax(axis=1)
    return out


def phase_correlation(fixed: np.ndarray, moving: np.ndarray, upsample: int | None = None) -> tuple[np.ndarray, float]:
    """(t, quality): fixed at x matches moving at x + t.

    Peaks of the normalised and of the plain cross-power spectrum (and of the masked correlation if anything is outside)
    give shifts whose signs and wraps are open; of all variants the structural similarity picks one, and Spearman's rank
    correlation of the pixels that it aligns is the quality. A variant with less than a tenth of the pixels has quality -1.
    """
    n = fixed.ndim
    low, high = np.nanmin([np.nanmin(fixed), np.nanmin(moving)]), np.nanmax([np.nanmax(fixed), np.nanmax(moving)])
    if not np.isfinite(low) or np.nanmax(fixed) == np.nanmin(fixed) or np.nanmax(moving) == np.nanmin(moving):
        return np.zeros(n), float("nan")
    a, b = (fixed - low) / (high - low), (moving - low) / (high - low)
    outside = np.isnan(a).any() or np.isnan(b).any()
    upsample = upsample or (10 if n == 2 else 2)
    cross = np.fft.fftn(np.nan_to_num(a)) * np.conj(np.fft.fftn(np.nan_to_num(b)))
    peaks = [_peak(cross / np.maximum(np.abs(cross), 1e-12), upsample), _peak(cross, upsample)]
    if outside:
        peaks.append(masked_correlation_shift(a, b))
    variants = []
    for p in peaks:
        ways = [[0.0] if x == 0 else [x, -x, s - x, -x - s] for x, s in zip(p, b.shape, strict=True)]
        variants += [v for v in product(*ways) if max(map(abs, v)) < max(*a.shape, *b.shape)]
    best = (-np.inf, np.zeros(n), None)
    valid_a, least, span = ~np.isnan(a), np.nanmin(b), max(np.nanmax(a), np.nanmax(b)) - min(np.nanmin(a), np.nanmin(b))
    enough, known_a, (box,) = 0.1 * (~np.isnan(b)).sum(), np.nan_to_num(a), _boxes(valid_a[None])
    pick, other = (np.maximum, np.minimum) if outside else (np.minimum, np.maximum)
    tries = np.array(list(dict.fromkeys(variants)), dtype=float).reshape(-1, n)
    step = max(1, SHIFTED_PIXELS // b.size)
    for part in (tries[lo : lo + step] for lo in range(0, len(tries), step)):
        moved = shifted_all(b, part)
        valid = ~np.isnan(moved)
        number = (valid & valid_a).reshape(len(part), -1).sum(axis=1)
        met, boxes, score = (number >= enough) & (number > 0), _boxes(valid), np.full(len(part), -1.0)
        regions: dict[tuple, list[int]] = {}
        for k in np.flatnonzero(met).tolist():
            regions.setdefault((*pick(box[:, 0], boxes[k, :, 0]).tolist(), *other(box[:, 1], boxes[k, :, 1]).tolist()), []).append(k)
        for edge, ks in regions.items():
            region = tuple(slice(lo, hi) for lo, hi in zip(edge[:n], edge[n:], strict=True))
            window = min(7, *(s.stop - s.start for s in region))
            window -= 1 - window % 2
            there = moved[(ks, *region)]
            ok = np.fmax.reduce(there.reshape(len(ks), -1), axis=1) > least
            if window >= 3 and ok.any():
                score[np.array(ks)[ok]] = similarities(known_a[region], np.nan_to_num(there[ok]), span, window)
        for k, s in enumerate(score.tolist()):
            if s > best[0]:
                best = (s, part[k].copy(), moved[k].copy() if met[k] else None)
    if best[2] is None:
        return best[1], -1.0 if best[0] > -np.inf else float("nan")
    both = valid_a & ~np.isnan(best[2])
    return best[1], spearman(a[both], best[2][both])


def local_maxima(image: np.ndarray, reach: int) -> np.ndarray:
    """Whether a pixel is the largest of the window of ``reach`` pixels to each side."""
    top = image
    for d in range(image.ndim):
        padded = np.pad(np.moveaxis(top, d, -1), [(0, 0)] * (image.ndim - 1) + [(reach, reach)], constant_values=-np.inf)
        top = np.moveaxis(np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=-1).max(axis=-1), -1, d)
    return image >= top


def spots(image: np.ndarray, spacing, size: float, threshold_rel: float = 0.2, threshold_abs: float | None = None) -> np.ndarray:
    """(k, n) indices of bright spots of a physical size: maxima of the scaled negative Laplacian of a Gaussian."""
    spacing = np.asarray(spacing, dtype=float)
    sigma = np.maximum(0.5, size / spacing / (2 * np.sqrt(image.ndim)))
    answer = -laplacian_of_gaussian(np.nan_to_num(image), sigma) * np.mean(sigma) ** 2
    reach = int(np.ceil(max(1.0, float((size / spacing).mean()) / 2)))
    limit = threshold_abs if threshold_abs is not None else threshold_rel * max(float(answer.max(initial=0.0)), 0.0)
    found = np.argwhere(local_maxima(answer, reach) & (answer > max(limit, 0.0)))
    return _merged(found)


def _merged(found: np.ndarray) -> np.ndarray:
    """Centroids of groups of touching pixels."""
    left, out = {tuple(p) for p in found.tolist()}, []
    steps = [s for s in product((-1, 0, 1), repeat=found.shape[1]) if any(s)] if len(found) else []
    while left:
        start = min(left)
        left.remove(start)
        group, todo = [start], [start]
        while todo:
            p = todo.pop()
            for s in steps:
                q = tuple(x + y for x, y in zip(p, s, strict=True))
                if q in left:
                    left.remove(q)
                    group.append(q)
                    todo.append(q)
        out.append(np.mean(group, axis=0))
    return np.array(sorted(map(tuple, out))) if out else np.zeros((0, found.shape[1]))


def content_weights(views: np.ndarray, sigma_1: float = 5.0, sigma_2: float = 11.0) -> np.ndarray:
    """Weights of views (first axis) by local contrast: blurred squared difference from the blurred image, summing to 1."""
    w = np.stack([nan_gaussian((v - nan_gaussian(v, sigma_1)) ** 2, sigma_2) for v in views])
    total = np.nansum(w, axis=0)
    return np.where(np.isnan(w), 0.0, w) / np.where(total == 0, 1.0, total)


def dct_entropy(block: np.ndarray, support: float = 0.5) -> float:
    """Shannon entropy of a block's cosine spectrum below a share of the frequencies, normalised by the spectrum's norm."""
    spectrum = block
    for d in range(block.ndim):
        m = block.shape[d]
        basis = np.cos(np.pi * (np.arange(m) + 0.5)[None, :] * np.arange(m)[:, None] / m) * np.sqrt(2 / m)
        basis[0] /= np.sqrt(2)
        spectrum = np.moveaxis(np.tensordot(basis, spectrum, axes=(1, d)), 0, d)
    norm = np.linalg.norm(spectrum)
    if norm == 0:
        return 0.0
    place = np.stack(np.meshgrid(*(np.arange(s) / s for s in block.shape), indexing="ij"))
    low = np.abs(spectrum[np.sqrt((place**2).sum(axis=0)) <= support]) / norm
    low = low[low > 0]
    return float(-2.0 / max(len(low), 1) * (low * np.log2(low)).sum())


def dct_weights(views: np.ndarray, block: int = 8, exponent: float = 1.0) -> np.ndarray:
    """Weights of views by the entropy of blocks, less the least of the views there, spread linearly; summing to 1."""
    shape = views.shape[1:]
    grid = tuple(-(-s // block) for s in shape)
    entropy = np.zeros((len(views), *grid))
    for cell in np.ndindex(grid):
        part = tuple(slice(c * block, min((c + 1) * block, s)) for c, s in zip(cell, shape, strict=True))
        for k, v in enumerate(views):
            own = v[part]
            if (~np.isnan(own)).mean() >= 0.2:
                entropy[(k, *cell)] = dct_entropy(np.nan_to_num(own)) ** exponent
    entropy -= entropy.min(axis=0, keepdims=True) if len(views) > 1 else 0.0
    back = np.diag([1.0 / block] * len(shape))
    offset = np.array([(1.0 / block - 1) / 2] * len(shape))
    w = np.stack([_spread(e, back, offset, shape) for e in entropy])
    w = np.where(np.isnan(views), 0.0, w)
    total = w.sum(axis=0)
    return np.where(total > 0, w / np.where(total == 0, 1.0, total), (~np.isnan(views)) / np.maximum((~np.isnan(views)).sum(axis=0), 1))


def _spread(coarse: np.ndarray, matrix: np.ndarray, offset: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    grid = np.stack(np.meshgrid(*(np.arange(s, dtype=float) for s in shape), indexing="ij"), axis=-1)
    at = np.clip(grid @ matrix.T + offset, 0, np.array(coarse.shape) - 1)
    low = np.minimum(np.floor(at).astype(int), np.maximum(np.array(coarse.shape) - 2, 0))
    out = np.zeros(shape)
    for far in product((0, 1), repeat=len(shape)):
        w = np.prod([at[..., d] - low[..., d] if k else 1 - (at[..., d] - low[..., d]) for d, k in enumerate(far)], axis=0)
        out += w * coarse[tuple(np.minimum(low[..., d] + k, coarse.shape[d] - 1) for d, k in enumerate(far))]
    return out


def gaussian_psf(sigma, n: int) -> np.ndarray:
    """A normalised Gaussian of odd edge ceil(6 sigma)."""
    sigmas = np.broadcast_to(sigma, (n,))
    out = np.ones((1,) * n)
    for d, s in enumerate(sigmas):
        edge = int(np.ceil(6 * s)) | 1
        k = np.exp(-0.5 * ((np.arange(edge) - edge // 2) / s) ** 2)
        out = out * k.reshape([-1 if e == d else 1 for e in range(n)])
    return out / out.sum()


def estimate_psf_sigma(spacing, na: float = 0.8, wavelength: float = 0.5) -> np.ndarray:
    """Standard deviations in pixels: half a wavelength over NA across, twice it over NA^2 along the axis, half a pixel at least."""
    spacing = np.asarray(spacing, dtype=float)
    physical = np.full(len(spacing), 0.5 * wavelength / na)
    if len(spacing) == 3:
        physical[0] = 2 * wavelength / na**2
    return np.maximum(physical / spacing, 0.5)


def _convolve(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    pad = [(k // 2, k // 2) for k in kernel.shape]
    x = np.pad(image, pad, mode="symmetric")
    size = tuple(a + b - 1 for a, b in zip(x.shape, kernel.shape, strict=True))
    full = np.fft.irfftn(np.fft.rfftn(x, size) * np.fft.rfftn(kernel, size), size)
    return full[tuple(slice(k - 1, k - 1 + s) for k, s in zip(kernel.shape, image.shape, strict=True))]


def compound_kernel(psfs: list[np.ndarray], k: int, kind: str = "efficient_bayesian") -> np.ndarray:
    """Back-projection kernel of view k. independent: its own mirrored kernel; the others take account of all views."""
    mirror = lambda p: p[tuple(slice(None, None, -1) for _ in range(p.ndim))]
    own = mirror(psfs[k])
    if kind == "independent" or len(psfs) == 1:
        return own / own.sum()
    out = own.copy()
    for j, p in enumerate(psfs):
        if j != k:
            through = _convolve(own, p)
            if kind in ("efficient_bayesian", "optimization_i"):
                through = _convolve(through, mirror(p)) if kind == "efficient_bayesian" else through
            out = out * np.maximum(through, 0.0)
    if kind == "optimization_ii":
        out = own ** len(psfs)
    return out / out.sum()


def deconvolve(views: np.ndarray, weights: np.ndarray, psfs: list[np.ndarray], iterations: int = 10, kind: str = "efficient_bayesian", least: float = 1e-4) -> np.ndarray:
    """Sequential multi-view Richardson-Lucy from the weighted average of the views; NaN is outside."""
    valid = ~np.isnan(views)
    filled = np.nan_to_num(views)
    w = np.where(valid, weights, 0.0)
    total = w.sum(axis=0)
    psi = np.maximum((filled * w).sum(axis=0) / np.where(total == 0, 1.0, total), least)
    back = [compound_kernel(psfs, k, kind) for k in range(len(psfs))]
    for _ in range(iterations):
        for k in range(len(views)):
            ratio = np.where(valid[k], filled[k] / np.maximum(_convolve(psi, psfs[k]), least), 1.0)
            psi = np.maximum(psi * _convolve(1 + w[k] * (ratio - 1), back[k]), least)
    return psi
