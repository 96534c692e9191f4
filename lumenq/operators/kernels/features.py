"""Feature vectors of characters and patches."""

from __future__ import annotations

import math

import numpy as np

from . import imaging as im


def fit(img: np.ndarray, size: int, margin: int = 4, rounded: bool = True) -> np.ndarray:
    """Scaled to ``size - margin`` on the longer side and centred on a white square."""
    canvas = np.full((size, size), im.PAPER, np.uint8)
    if img.size == 0:
        return canvas
    h, w = img.shape[:2]
    scale = (size - margin) / max(h, w)
    whole = round if rounded else int
    nh, nw = max(1, whole(h * scale)), max(1, whole(w * scale))
    small = im.resize(img, nw, nh, "area" if scale < 1 or not rounded else "linear")
    y, x = (size - nh) // 2, (size - nw) // 2
    canvas[y : y + nh, x : x + nw] = small
    return canvas


def cells(values: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of each cell of a grid, row by row."""
    h, w = values.shape[0] // rows, values.shape[1] // columns
    return values[: h * rows, : w * columns].reshape(rows, h, columns, w).mean((1, 3)).ravel()


def hog(img: np.ndarray, cell: int, bins: int = 9, block: int = 2) -> np.ndarray:
    """Histograms of unsigned gradients by cell, blocks of cells normalised, clipped at 0.2 and normalised again."""
    values = img.astype(float)
    dy, dx = np.zeros_like(values), np.zeros_like(values)
    dy[1:-1] = values[2:] - values[:-2]
    dx[:, 1:-1] = values[:, 2:] - values[:, :-2]
    size = np.hypot(dx, dy)
    turn = np.rad2deg(np.arctan2(dy, dx)) % 180
    bin_ = np.minimum((turn / (180 / bins)).astype(int), bins - 1)
    rows, columns = values.shape[0] // cell, values.shape[1] // cell
    out = np.zeros((rows, columns, bins))
    y, x = np.mgrid[0 : rows * cell, 0 : columns * cell]
    np.add.at(out, (y // cell, x // cell, bin_[: rows * cell, : columns * cell]), size[: rows * cell, : columns * cell] / cell**2)
    parts = []
    for r in range(rows - block + 1):
        for c in range(columns - block + 1):
            v = out[r : r + block, c : c + block].ravel()
            v = np.minimum(v / np.sqrt((v**2).sum() + 1e-10), 0.2)
            parts.append(v / np.sqrt((v**2).sum() + 1e-10))
    return np.concatenate(parts).astype(np.float32)


def _resampled(points: np.ndarray, n: int) -> np.ndarray:
    """Numbers of n points at even arc lengths."""
    length = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(points, axis=0).T))])
    return np.clip(np.searchsorted(length, np.linspace(0, length[-1], n, endpoint=False), "right") - 1, 0, len(points) - 1)


def _directions(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    step = points[(at + 1) % len(points)] - points[at]
    return (np.arctan2(step[:, 1], step[:, 0]) + np.pi) / (2 * np.pi)


def contour(norm: np.ndarray, n: int = 64) -> np.ndarray:
    """x, y and direction of n points along the longest outer border."""
    lines = im.contours(norm < 255, inner=False)
    line = max(lines, key=len, default=np.zeros((0, 2))).astype(float)
    if len(line) < 2 or not np.hypot(*np.diff(line, axis=0).T).sum():
        return np.zeros(3 * n, np.float32)
    at = _resampled(line, n)
    return np.stack([line[at, 0] / len(norm), line[at, 1] / len(norm), _directions(line, at)], 1).ravel().astype(np.float32)


_BASIS: dict[tuple[int, int], list[np.ndarray]] = {}


def zernike(mask: np.ndarray, degree: int = 8) -> np.ndarray:
    """Magnitudes of the Zernike moments (n >= m >= 0) about the centre of mass."""
    size = len(mask)
    total = mask.sum()
    if not total:
        return np.zeros(sum(n // 2 + 1 for n in range(degree + 1)), np.float32)
    y, x = np.nonzero(mask)
    x, y = (x - x.mean()) / (size / 2), (y - y.mean()) / (size / 2)
    rho, theta = np.hypot(x, y), np.arctan2(y, x)
    inside = rho <= 1
    rho, theta = rho[inside], theta[inside]
    out = []
    for n in range(degree + 1):
        for m in range(n % 2, n + 1, 2):
            radial = np.zeros_like(rho)
            for s in range((n - m) // 2 + 1):
                c = (-1) ** s * math.comb(n - s, s) * math.comb(n - 2 * s, (n - m) // 2 - s)
                radial += c * rho ** (n - 2 * s)
            out.append(abs((radial * np.exp(-1j * m * theta)).sum()) * (n + 1) / np.pi / total)
    return np.array(out, np.float32)


def dots(marks: list[dict] | None) -> np.ndarray:
    """Dots above and below, any, and the spread of their centres."""
    if not marks:
        return np.zeros(4, np.float32)
    count = lambda where: sum(d["cluster_size"] for d in marks if d["position"] == where)
    return np.array([count("above"), count("below"), 1, np.std([d["cx"] for d in marks])], np.float32)


def arabic_character(img: np.ndarray, marks: list[dict] | None = None) -> np.ndarray:
    """2049 values: grid 64, gradients 1764, contour 192, moments 25, dots 4."""
    norm = fit(img, 32)
    return np.concatenate([cells(norm == 0, 8, 8), hog(norm, 4), contour(norm), zernike(norm < 128), dots(marks)]).astype(np.float32)


def outline(norm: np.ndarray, n: int = 64) -> np.ndarray:
    """x, y and direction of n points of the longest border, then of the longest of smaller area."""
    lines = [c for c in im.contours(norm < 128) if len(c) >= 1]
    if not lines:
        return np.zeros(6 * n, np.float32)
    outer = max(lines, key=len)
    inner = max((c for c in lines if len(c) >= 2 and im.polygon_area(c) < im.polygon_area(outer)), key=len, default=None)

    def sampled(points: np.ndarray | None) -> np.ndarray:
        if points is None:
            return np.zeros(3 * n)
        points = points.astype(float)
        at = np.linspace(0, len(points) - 1, n).astype(int)
        return np.concatenate([points[at, 0] / (len(norm) - 1), points[at, 1] / (len(norm) - 1), _directions(points, at)])

    return np.concatenate([sampled(outer), sampled(inner)]).astype(np.float32)


def directions(img: np.ndarray, bins: int = 16, least: float = 5.0) -> np.ndarray:
    dx, dy = im.sobel(img)
    size = np.hypot(dx, dy)
    strong = size >= least
    counts, _ = np.histogram(np.arctan2(dy, dx)[strong], np.linspace(-np.pi, np.pi, bins + 1), weights=size[strong])
    return (counts / counts.sum() if counts.sum() else counts).astype(np.float32)


def profiles(img: np.ndarray, bins: int = 16) -> np.ndarray:
    """Ink by row and by column, resampled and divided by the largest."""
    ink_ = (img < 128).astype(float)
    out = []
    for axis in (1, 0):
        line = im._taps(ink_.shape[1 - axis], bins, "area") @ ink_.sum(axis)
        out.append(line / (line.max() + 1e-8))
    return np.concatenate(out).astype(np.float32)


def topology(norm: np.ndarray) -> np.ndarray:
    """Borders beyond the first (up to five), and the share of border pixels."""
    mask = (norm < 128).astype(np.uint8)
    edge = im.dilate(mask, im.box_kernel(3, 3)) - im.erode(mask, im.box_kernel(3, 3))
    return np.array([min(max(0, len(im.contours(mask > 0)) - 1), 5) / 5, edge.mean()], np.float32)


def latin_character(img: np.ndarray) -> np.ndarray:
    """498 values: outline 384, skeleton grid 64, directions 16, profiles 32, topology 2."""
    norm = fit(img, 64, rounded=False)
    bones = np.where(im.thin(norm < 128), im.INK, im.PAPER).astype(np.uint8)
    return np.concatenate([outline(norm), cells(bones < 128, 8, 8), directions(bones), profiles(bones), topology(norm)]).astype(np.float32)


def gradient_grid(img: np.ndarray, grid: int = 4, bins: int = 8) -> np.ndarray:
    """Histograms of gradient angles (first quadrant) in a grid of cells, weighted towards each centre."""
    dx, dy = im.sobel(img, 1)
    size, turn = np.hypot(dx, dy), np.rad2deg(np.arctan2(np.abs(dy), np.abs(dx)))
    h, w = img.shape[0] // grid, img.shape[1] // grid
    bell = lambda n: np.exp(-((np.arange(n) - (n - 1) / 2) ** 2) / (2 * (n / 2) ** 2))
    weight = np.outer(bell(h), bell(w))
    weight /= weight.max()
    out = []
    for r in range(grid):
        for c in range(grid):
            part = np.s_[r * h : (r + 1) * h, c * w : (c + 1) * w]
            v, _ = np.histogram(turn[part], bins, (0, 90), weights=size[part] * weight)
            v = np.minimum(v / (np.linalg.norm(v) + 1e-8), 0.2)
            out.append(v / (np.linalg.norm(v) + 1e-8))
    return np.concatenate(out).astype(np.float32)


def edge_density(img: np.ndarray, grid: int = 8) -> np.ndarray:
    return cells(im.canny(img.astype(np.uint8), 50, 150), grid, grid).astype(np.float32)


def patch(img: np.ndarray) -> np.ndarray:
    """4548 values of an object patch: gradients 4356, grid 128, edges 64."""
    small = im.gray(im.resize(img, 96, 96)).astype(np.float32)
    return np.concatenate([hog(np.sqrt(small / 255), 8), gradient_grid(small), edge_density(small)]).astype(np.float32)
