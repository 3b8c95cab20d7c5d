"""Keypoints and their descriptors, in NumPy alone: gradient histograms around scale-space extrema, and
binary comparisons around corners. They follow the published definitions, not another library's bits."""

from __future__ import annotations

import numpy as np

#: Blur of the first level, levels to an octave, octaves, and the least contrast of an extremum (of 0 to 1).
SIGMA, LEVELS, OCTAVES, CONTRAST = 1.6, 3, 4, 0.013
#: Principal curvatures of an extremum differ by this ratio at most, which leaves edges out.
EDGE = 10.0
#: Keypoints of an image, the strongest first.
MOST = 500
#: Half the patch of a binary descriptor, its comparisons, and the pictures it is taken from, each smaller
#: by a factor.
REACH, BITS, SIZES, FACTOR = 15, 256, 8, 1.2


def gaussian(f: np.ndarray, sigma: float) -> np.ndarray:
    n = max(1, int(np.ceil(3 * sigma)))
    w = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        wide = np.pad(f, [(n, n) if a == axis else (0, 0) for a in (0, 1)], "symmetric")
        f = sum(x * np.take(wide, np.arange(k, k + f.shape[axis]), axis) for k, x in enumerate(w))
    return f


def _neighbours(f: np.ndarray) -> list[np.ndarray]:
    """The inner part of a stack or picture moved by -1, 0, 1 along each axis, itself left out."""
    moves = [()]
    for _ in range(f.ndim):
        moves = [(*m, d) for m in moves for d in (0, 1, 2)]
    cut = lambda m: f[tuple(slice(d, f.shape[a] - 2 + d) for a, d in enumerate(m))]
    return [cut(m) for m in moves if m != (1,) * f.ndim]


def _inner(f: np.ndarray) -> np.ndarray:
    return f[(slice(1, -1),) * f.ndim]


def _sampled(f: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between pixels, straight lines between them; the border goes on beyond it."""
    y, x = np.clip(y, 0, f.shape[0] - 1.001), np.clip(x, 0, f.shape[1] - 1.001)
    i, j = y.astype(int), x.astype(int)
    a, b = y - i, x - j
    return (1 - a) * ((1 - b) * f[i, j] + b * f[i, j + 1]) + a * ((1 - b) * f[i + 1, j] + b * f[i + 1, j + 1])


def scale_space_extrema(f: np.ndarray) -> list[tuple[float, np.ndarray, float, float, float]]:
    """(strength, blurred picture, y, x, blur within it) of extrema of differences of blurs, over octaves."""
    out, step = [], 2 ** (1 / LEVELS)
    for _ in range(OCTAVES):
        if min(f.shape) < 16:
            break
        levels = [gaussian(f, SIGMA * step**k) for k in range(LEVELS + 3)]
        d = np.stack([b - a for a, b in zip(levels, levels[1:])])
        here, around = _inner(d), np.stack(_neighbours(d))
        found = (np.abs(here) > CONTRAST) & ((here > around.max(0)) | (here < around.min(0)))
        for k, y, x in zip(*np.nonzero(found)):
            p = d[k + 1]
            y, x = y + 1, x + 1
            yy, xx, xy = p[y + 1, x] + p[y - 1, x] - 2 * p[y, x], p[y, x + 1] + p[y, x - 1] - 2 * p[y, x], (p[y + 1, x + 1] - p[y + 1, x - 1] - p[y - 1, x + 1] + p[y - 1, x - 1]) / 4
            if yy * xx - xy * xy > 0 and (yy + xx) ** 2 * EDGE < (EDGE + 1) ** 2 * (yy * xx - xy * xy):
                out.append((abs(float(p[y, x])), levels[k + 1], float(y), float(x), SIGMA * step ** (k + 1)))
        f = levels[LEVELS][::2, ::2]
    return sorted(out, key=lambda e: (-e[0], e[2], e[3]))[:MOST]


def _gradients(f: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strength, direction) at places between pixels."""
    gy, gx = _sampled(f, y + 1, x) - _sampled(f, y - 1, x), _sampled(f, y, x + 1) - _sampled(f, y, x - 1)
    return np.hypot(gy, gx), np.arctan2(gy, gx)


def keypoint_gradients(mono: np.ndarray) -> np.ndarray:
    """(n, 128): histograms of gradient directions over 4 x 4 cells, turned to each keypoint's main
    direction and sized to its blur; scaled to length 1, cut at 0.2 and scaled again."""
    out = []
    grid = np.arange(16) - 7.5
    v, u = np.meshgrid(grid, grid, indexing="ij")
    ring = np.arange(-8, 9)
    dy, dx = np.meshgrid(ring, ring, indexing="ij")
    for _, f, y, x, blur in scale_space_extrema(mono.astype(np.float64) / 255):
        strength, turn = _gradients(f, y + dy * blur / 2, x + dx * blur / 2)
        votes = np.bincount(((turn + np.pi) / (2 * np.pi) * 36).astype(int).ravel() % 36, (strength * np.exp(-(dy**2 + dx**2) / 32)).ravel(), 36)
        main = (int(votes.argmax()) + 0.5) / 36 * 2 * np.pi - np.pi
        c, s = np.cos(main), np.sin(main)
        unit = blur * 3 / 4  # four samples to a cell three blurs wide
        strength, turn = _gradients(f, y + (s * u + c * v) * unit, x + (c * u - s * v) * unit)
        strength = strength * np.exp(-(u**2 + v**2) / 128)
        bins = (turn - main) / (2 * np.pi) * 8 % 8
        low = bins.astype(int) % 8
        cell = (np.arange(16) // 4)[:, None] * 4 + (np.arange(16) // 4)[None, :]
        part = bins - np.floor(bins)
        h = np.bincount((cell * 8 + low).ravel(), (strength * (1 - part)).ravel(), 128) + np.bincount((cell * 8 + (low + 1) % 8).ravel(), (strength * part).ravel(), 128)
        if (n := np.linalg.norm(h)) > 0:
            h = np.minimum(h / n, 0.2)
            out.append(h / np.linalg.norm(h))
    return np.array(out, np.float32).reshape(-1, 128)


def corners(f: np.ndarray) -> list[tuple[float, int, int]]:
    """(strength, y, x) of the strongest local maxima of det - 0.04 trace^2 of the smoothed gradient products, far
    enough from the border for a patch."""
    if min(f.shape) <= 2 * REACH + 2:
        return []
    gy, gx = np.gradient(f)
    a, b, c = gaussian(gy * gy, 1.5), gaussian(gx * gx, 1.5), gaussian(gy * gx, 1.5)
    r = a * b - c * c - 0.04 * (a + b) ** 2
    top = np.zeros(r.shape, bool)
    top[1:-1, 1:-1] = (_inner(r) > np.stack(_neighbours(r)).max(0)) & (_inner(r) > 1e-6 * max(r.max(), 1e-12))
    top[:REACH] = top[-REACH:] = False
    top[:, :REACH] = top[:, -REACH:] = False
    at = np.argwhere(top)
    order = np.lexsort((at[:, 1], at[:, 0], -r[top]))[:MOST]
    return [(float(r[y, x]), int(y), int(x)) for y, x in at[order]]


def smaller(f: np.ndarray) -> np.ndarray:
    h, w = (int(n / FACTOR) for n in f.shape)
    y, x = np.meshgrid((np.arange(h) + 0.5) * f.shape[0] / h - 0.5, (np.arange(w) + 0.5) * f.shape[1] / w - 0.5, indexing="ij")
    return _sampled(gaussian(f, 0.5), y, x)


def binary_corners(mono: np.ndarray) -> np.ndarray:
    """(n, 32): 256 comparisons of smoothed grays around each corner, over several sizes of the picture,
    turned to its intensity centroid and packed into bytes."""
    found, f = [], mono.astype(np.float64)
    for _ in range(SIZES):
        if min(f.shape) <= 2 * REACH + 2:
            break
        smooth = gaussian(f, 2.0)
        found += [(r, n, smooth, y, x) for n, (r, y, x) in enumerate(corners(smooth))]
        f = smaller(f)
    found = sorted(found, key=lambda c: (-c[0], c[1]))[:MOST]
    pairs = np.clip(np.rint(np.random.default_rng(31).normal(0, REACH * 0.4, (BITS, 4))), -REACH + 2, REACH - 2)
    ring = np.arange(-REACH, REACH + 1)
    dy, dx = np.meshgrid(ring, ring, indexing="ij")
    disc = dy**2 + dx**2 <= REACH**2
    out = []
    for _, _, f, y, x in found:
        patch = f[y - REACH : y + REACH + 1, x - REACH : x + REACH + 1] * disc
        main = np.arctan2((patch * dy).sum(), (patch * dx).sum())
        c, s = np.cos(main), np.sin(main)
        at = lambda v, u, f=f, y=y, x=x: f[np.clip(np.rint(y + s * u + c * v).astype(int), 0, f.shape[0] - 1), np.clip(np.rint(x + c * u - s * v).astype(int), 0, f.shape[1] - 1)]
        out.append(np.packbits(at(pairs[:, 0], pairs[:, 1]) < at(pairs[:, 2], pairs[:, 3])))
    return np.array(out, np.float32).reshape(-1, BITS // 8)
