"""Pixel kernels on (height, width, 3) uint8 RGB arrays, in NumPy alone.

Flips, crops, colour shifts and geometry are exact; resampling, blurs, rotations, perspective, CLAHE
and the JPEG stand-in follow the usual definitions within rounding, not another library's bits.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Sizes, channel statistics of the model input and luma weights.
TARGET = (640, 480)
MEAN, STD = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)
LUMA = np.array([0.299, 0.587, 0.114])
PAD = 128


def clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def gray(rgb: np.ndarray) -> np.ndarray:
    return clipped(rgb @ LUMA)


def _weights(n: int, m: int, reach: float, kernel) -> np.ndarray:
    """(m, n) matrix that resamples n points to m, the kernel widened when shrinking."""
    scale = n / m
    wide = max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale - 0.5
    x = (np.arange(n)[None, :] - centre[:, None]) / wide
    w = np.where(np.abs(x) < reach, kernel(x), 0.0)
    return w / w.sum(1, keepdims=True)


def resize(img: np.ndarray, width: int, height: int, lanczos: bool = True) -> np.ndarray:
    kernel, reach = ((lambda x: np.sinc(x) * np.sinc(x / 4)), 4.0) if lanczos else ((lambda x: 1 - np.abs(x)), 1.0)
    rows, cols = _weights(img.shape[0], height, reach, kernel), _weights(img.shape[1], width, reach, kernel)
    return clipped(np.einsum("ab,bcd,ec->aed", rows, img.astype(np.float64), cols, optimize=True))


def fitted(width: int, height: int, target: tuple[int, int] = TARGET) -> tuple[int, int]:
    """The size that fits into the target with the same proportions, cut to whole pixels."""
    scale = min(target[0] / width, target[1] / height)
    return max(1, int(width * scale)), max(1, int(height * scale))


def resize_and_pad(img: np.ndarray, target: tuple[int, int] = TARGET) -> np.ndarray:
    w, h = fitted(img.shape[1], img.shape[0], target)
    out = np.full((target[1], target[0], 3), PAD, np.uint8)
    top, left = (target[1] - h) // 2, (target[0] - w) // 2
    out[top : top + h, left : left + w] = resize(img, w, h)
    return out


def normalized(img: np.ndarray) -> np.ndarray:
    return (img.astype(np.float32) / 255 - MEAN) / STD


def equalized(img: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of the lightness; colours move along."""
    light = gray(img)
    h, w = light.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.empty((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            part = light[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]
            hist = np.bincount(part.ravel(), minlength=256).astype(np.float64)
            most = max(1.0, clip * part.size / 256)
            hist = np.minimum(hist, most) + np.maximum(hist - most, 0).sum() / 256
            maps[i, j] = hist.cumsum() * 255 / part.size
    place = lambda n: np.clip((np.arange(n) + 0.5) * tiles / n - 0.5, 0, tiles - 1)
    y, x = place(h), place(w)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    at = lambda a, b: maps[a[:, None], b[None, :], light]
    new = (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy
    return clipped(img + (new - light)[..., None])


def blended(img: np.ndarray, other, factor: float) -> np.ndarray:
    """Between ``other`` (factor 0) and the image (factor 1), or beyond it."""
    return np.clip(other + factor * (img.astype(np.float64) - other), 0, 255).astype(np.uint8)


def blurred(img: np.ndarray, radius: float) -> np.ndarray:
    x = np.arange(-int(3 * radius), int(3 * radius) + 1)
    k = np.exp(-(x**2) / (2 * radius**2))
    k /= k.sum()
    out = img.astype(np.float64)
    for axis in (0, 1):
        pads = [(len(x) // 2,) * 2 if a == axis else (0, 0) for a in range(3)]
        wide = np.pad(out, pads, "edge")
        out = sum(w * np.take(wide, np.arange(out.shape[axis]) + i, axis) for i, w in enumerate(k))
    return clipped(out)


def warped(img: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Each pixel of the result from where the 3 x 3 matrix ``back`` sends it; edges reflected."""
    h, w = img.shape[:2]
    y, x = np.mgrid[:h, :w]
    p = back @ np.stack([x.ravel(), y.ravel(), np.ones(h * w)])
    fold = lambda v, n: np.abs((v + (n - 1)) % (2 * (n - 1) or 1) - (n - 1)) if n > 1 else v * 0
    px, py = fold(p[0] / p[2], w), fold(p[1] / p[2], h)
    x0, y0 = np.minimum(px.astype(int), w - 1), np.minimum(py.astype(int), h - 1)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (px - x0)[:, None], (py - y0)[:, None]
    f = img.astype(np.float64)
    out = (f[y0, x0] * (1 - fx) + f[y0, x1] * fx) * (1 - fy) + (f[y1, x0] * (1 - fx) + f[y1, x1] * fx) * fy
    return clipped(out.reshape(img.shape))


def rotated(img: np.ndarray, degrees: float) -> np.ndarray:
    """Counter-clockwise about the centre."""
    a, cx, cy = np.deg2rad(degrees), img.shape[1] / 2, img.shape[0] / 2
    c, s = np.cos(a), np.sin(a)
    return warped(img, np.array([[c, -s, cx - c * cx + s * cy], [s, c, cy - s * cx - c * cy], [0, 0, 1]]))


def projected(img: np.ndarray, corners: list[tuple[float, float]]) -> np.ndarray:
    """The image's corners (top left, top right, bottom right, bottom left) moved to ``corners``."""
    h, w = img.shape[:2]
    rows, known = [], []
    for (u, v), (x, y) in zip(corners, [(0, 0), (w, 0), (w, h), (0, h)]):
        rows += [[u, v, 1, 0, 0, 0, -x * u, -x * v], [0, 0, 0, u, v, 1, -y * u, -y * v]]
        known += [x, y]
    return warped(img, np.append(np.linalg.solve(np.array(rows, float), np.array(known, float)), 1).reshape(3, 3))


def dct_matrix(n: int) -> np.ndarray:
    k, x = np.mgrid[:n, :n]
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * x + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


def compressed(img: np.ndarray, step: float = 40.0) -> np.ndarray:
    """Block-wise quantised cosine transform, as heavy JPEG compression leaves it."""
    h, w = img.shape[:2]
    wide = np.pad(img.astype(np.float64), ((0, -h % 8), (0, -w % 8), (0, 0)), "edge") - 128
    m = dct_matrix(8)
    b = wide.reshape(wide.shape[0] // 8, 8, wide.shape[1] // 8, 8, 3).transpose(0, 2, 4, 1, 3)
    b = m.T @ (np.rint(m @ b @ m.T / step) * step) @ m
    return clipped(b.transpose(0, 3, 1, 4, 2).reshape(wide.shape)[:h, :w] + 128)


def _shifted(img: np.ndarray, red: int, blue: int) -> np.ndarray:
    return np.clip(img.astype(np.int16) + np.array([red, 0, blue], np.int16), 0, 255).astype(np.uint8)


def augmented(img: np.ndarray, kind: str, seed: int = 42) -> np.ndarray:
    """One of the 21 variants by its name in the manifest."""
    h, w = img.shape[:2]
    mono = gray(img)[..., None].astype(np.float64)
    cut, inner = int(min(w, h) * 0.10), (int(h * 0.075), int(w * 0.075))
    back = lambda part: resize(part, w, h)
    if kind in ("aug_bright", "aug_dark", "aug_overexp"):
        return blended(img, 0.0, {"aug_bright": 1.35, "aug_dark": 0.65, "aug_overexp": 1.70}[kind])
    if kind in ("aug_contrast", "aug_lowcontrast"):
        return blended(img, float(int(mono.mean() + 0.5)), {"aug_contrast": 1.40, "aug_lowcontrast": 0.70}[kind])
    if kind in ("aug_desat", "aug_vivid"):
        return blended(img, mono, {"aug_desat": 0.40, "aug_vivid": 1.50}[kind])
    if kind in ("aug_warm", "aug_cool"):
        return _shifted(img, *((20, -20) if kind == "aug_warm" else (-20, 20)))
    if kind in ("aug_blur", "aug_blur_hard"):
        return blurred(img, 2 if kind == "aug_blur" else 4)
    if kind == "aug_noise":
        noise = np.random.default_rng([seed, zlib.crc32(img.tobytes())]).normal(0, 18, img.shape).astype(np.int16)
        return np.clip(img.astype(np.int16) + noise, 0, 255).astype(np.uint8)
    if kind == "aug_jpeg":
        return compressed(img)
    if kind == "aug_flip":
        return img[:, ::-1].copy()
    if kind in ("aug_rot5", "aug_rot355"):
        return rotated(img, 5 if kind == "aug_rot5" else -5)
    if kind == "aug_crop_tl":
        return back(img[: h - cut, : w - cut])
    if kind == "aug_crop_br":
        return back(img[cut:, cut:])
    if kind == "aug_zoom":
        return back(img[inner[0] : h - inner[0], inner[1] : w - inner[1]])
    if kind == "aug_skew_h":
        return projected(img, [(0, int(h * 0.08)), (w, 0), (w, h), (0, int(h * 0.92))])
    if kind == "aug_skew_v":
        return projected(img, [(int(w * 0.08), 0), (int(w * 0.92), 0), (w, h), (0, h)])
    raise ValueError(f"unknown augmentation {kind!r}")


def hash_bits(mono: np.ndarray, side: int = 64, low: int = 16) -> np.ndarray:
    """Perceptual hash: which low frequencies lie above their median."""
    small = resize(np.repeat(mono[..., None], 3, 2), side, side, lanczos=False)[..., 0].astype(np.float64)
    m = dct_matrix(side)
    block = (m @ small @ m.T)[:low, :low]
    return (block > np.median(block)).ravel()


def dense_gradients(mono: np.ndarray, cell: int = 4, step: int = 16) -> np.ndarray:
    """(n, 128) histograms of gradient directions over 4 x 4 cells on a grid, scaled to length 1: the
    default local features. They are not the keypoints of a vision library."""
    f = mono.astype(np.float64)
    gy, gx = np.gradient(f) if min(f.shape) > 1 else (np.zeros_like(f),) * 2
    strength, turn = np.hypot(gx, gy), ((np.arctan2(gy, gx) + np.pi) * 8 / (2 * np.pi)).astype(int) % 8
    out, side = [], 4 * cell
    for y in range(0, f.shape[0] - side + 1, step):
        for x in range(0, f.shape[1] - side + 1, step):
            s, t = strength[y : y + side, x : x + side], turn[y : y + side, x : x + side]
            place = (np.arange(side) // cell)[:, None] * 4 + (np.arange(side) // cell)[None, :]
            d = np.bincount((place * 8 + t).ravel(), s.ravel(), 128)
            if (n := np.linalg.norm(d)) > 0:
                out.append(d / n)
    return np.array(out, np.float32).reshape(-1, 128)


def model_input(img: np.ndarray) -> np.ndarray:
    """Shorter side to 256, the middle 224 x 224, normalised."""
    h, w = img.shape[:2]
    scale = 256 / min(h, w)
    big = resize(img, max(224, round(w * scale)), max(224, round(h * scale)), lanczos=False)
    top, left = (big.shape[0] - 224) // 2, (big.shape[1] - 224) // 2
    return normalized(big[top : top + 224, left : left + 224])
