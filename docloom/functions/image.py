"""Grey images as arrays: thresholds, fill ratios, fingerprints, deskewing and local contrast, for use inside decoders."""

from __future__ import annotations

import numpy as np


def otsu(grey: np.ndarray) -> int:
    """The threshold with the largest variance between the two classes; 127 for an image of one shade."""
    counts = np.bincount(grey.ravel(), minlength=256).astype(float)
    below, shades = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (shades / below - (shades[-1] - shades) / above) ** 2
    return int(np.nanargmax(between)) if np.isfinite(between).any() else 127


def dark_ratio(grey: np.ndarray, threshold: int | None = None) -> float:
    """Share of pixels at or below a threshold (Otsu's by default)."""
    return float((grey <= (otsu(grey) if threshold is None else threshold)).mean()) if grey.size else 0.0


def levels(grey: np.ndarray, columns: int = 20, rows: int = 16) -> np.ndarray:
    """The layout fingerprint: each grid cell's share of dark pixels, as a level of 0 to 3."""
    dark = grey <= otsu(grey)
    y, x = np.linspace(0, grey.shape[0], rows + 1).astype(int), np.linspace(0, grey.shape[1], columns + 1).astype(int)
    share = np.array([[dark[a:b, c:d].mean() if b > a and d > c else 0.0 for c, d in zip(x, x[1:])] for a, b in zip(y, y[1:])])
    return np.digitize(share, [0.05, 0.25, 0.60]).astype(np.uint8)


def adaptive_threshold(grey: np.ndarray, block: int = 11, below: int = 2) -> np.ndarray:
    """White where a pixel is above its neighbourhood's mean less `below`, else black."""
    half = block // 2
    padded = np.pad(grey.astype(np.int64), half + 1, mode="edge").cumsum(0).cumsum(1)
    h, w = grey.shape
    total = padded[block : block + h, block : block + w] - padded[:h, block : block + w] - padded[block : block + h, :w] + padded[:h, :w]
    return np.where(grey > total / block**2 - below, 255, 0).astype(np.uint8)


def rotate(grey: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its middle, nearest pixel, white outside."""
    h, w = grey.shape
    y, x = np.mgrid[0:h, 0:w]
    a = np.deg2rad(degrees)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sy = np.rint(cy + (y - cy) * np.cos(a) - (x - cx) * np.sin(a)).astype(int)
    sx = np.rint(cx + (y - cy) * np.sin(a) + (x - cx) * np.cos(a)).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    return np.where(inside, grey[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 255).astype(np.uint8)


def deskew(grey: np.ndarray, limit: float = 15.0, step: float = 0.5) -> tuple[np.ndarray, float]:
    """The rotation within the limit at which rows differ most in ink, and its angle."""
    dark = (grey <= otsu(grey)).astype(np.uint8) * 255
    angles = np.arange(-limit, limit + step / 2, step)
    scores = [np.var((255 - rotate(255 - dark, a)).sum(axis=1, dtype=float)) for a in angles]
    best = float(angles[int(np.argmax(scores))])
    return rotate(grey, best), best


def local_contrast(grey: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Histogram equalisation by tile with clipped counts."""
    out = grey.copy()
    for rows in np.array_split(np.arange(grey.shape[0]), tiles):
        for cols in np.array_split(np.arange(grey.shape[1]), tiles):
            if len(rows) and len(cols):
                part = grey[np.ix_(rows, cols)]
                counts = np.bincount(part.ravel(), minlength=256).astype(float)
                most = max(1.0, clip * part.size / 256)
                over = np.maximum(counts - most, 0).sum()
                counts = np.minimum(counts, most) + over / 256
                out[np.ix_(rows, cols)] = np.rint(255 * np.cumsum(counts) / part.size).clip(0, 255).astype(np.uint8)[part]
    return out
