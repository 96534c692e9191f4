"""Gray, size, threshold, morphology, components, rotation, edges."""

from __future__ import annotations

import numpy as np

INK, PAPER = 0, 255


def gray(img: np.ndarray) -> np.ndarray:
    if img.ndim == 2:
        return img.copy()
    # fixed values: weights of blue, green, red in 1/16384
    weights = np.array([1868, 9617, 4899])
    return ((img[..., :3].astype(np.int64) @ weights + 8192) >> 14).astype(np.uint8)


def _taps(size: int, new: int, how: str) -> np.ndarray:
    """Weights (new x size) of a one-dimensional resize."""
    scale = size / new
    out = np.zeros((new, size))
    if how == "nearest":
        out[np.arange(new), np.minimum((np.arange(new) * scale).astype(int), size - 1)] = 1
    elif how == "area" and scale > 1:
        edges = np.arange(new + 1) * scale
        cells = np.arange(size)
        out = np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None) / scale
    else:
        centre = (np.arange(new) + 0.5) * scale - 0.5
        base = np.floor(centre).astype(int)
        reach = 2 if how == "cubic" else 1
        for k in range(1 - reach, reach + 1):
            d = np.abs(centre - (base + k))
            if how == "cubic":
                a = -0.75
                w = np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, np.where(d < 2, ((a * d - 5 * a) * d + 8 * a) * d - 4 * a, 0))
            else:
                w = np.clip(1 - d, 0, None)
            np.add.at(out, (np.arange(new), np.clip(base + k, 0, size - 1)), w)
    return out


def resize(img: np.ndarray, width: int, height: int, how: str = "linear") -> np.ndarray:
    down, across = _taps(img.shape[0], height, how), _taps(img.shape[1], width, how)
    out = np.tensordot(down, img.astype(float), (1, 0))
    out = np.moveaxis(np.tensordot(across, out, (1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8) if img.dtype == np.uint8 else out.astype(img.dtype)


def shrink(img: np.ndarray, most: int, rounded: bool = False) -> np.ndarray:
    """Down to ``most`` on the longer side, dims truncated or rounded."""
    h, w = img.shape[:2]
    if max(h, w) <= most:
        return img
    scale = most / max(h, w)
    fit = (lambda v: max(1, round(v * scale))) if rounded else (lambda v: int(v * scale))
    return resize(img, fit(w), fit(h), "area")


def crop(img: np.ndarray, box: tuple, padding: int = 0) -> np.ndarray:
    x1, y1, x2, y2 = box
    return img[max(0, y1 - padding) : max(0, y2 + padding), max(0, x1 - padding) : max(0, x2 + padding)]


def gaussian_taps(sigma: float, radius: int) -> np.ndarray:
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return taps / taps.sum()


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """One-dimensional Gaussian, edges mirrored with the edge repeated, four sigmas."""
    radius = int(4 * sigma + 0.5)
    if radius == 0:
        return values.astype(float)
    return np.convolve(np.pad(values.astype(float), radius, "symmetric"), gaussian_taps(sigma, radius), "valid")


def blur(img: np.ndarray, sigma: float, radius: int | None = None, mode: str = "reflect") -> np.ndarray:
    radius = int(3 * sigma + 0.5) if radius is None else radius
    taps = gaussian_taps(sigma, radius)
    out = img.astype(float)
    for axis in (0, 1):
        width = [(radius, radius) if a == axis else (0, 0) for a in range(out.ndim)]
        padded = np.pad(out, width, mode if img.shape[axis] > radius else "edge")
        n = img.shape[axis]
        out = sum(t * np.take(padded, np.arange(k, k + n), axis) for k, t in enumerate(taps))
    return out


def otsu(img: np.ndarray) -> int:
    """Level that parts the histogram with the largest variance between."""
    counts = np.bincount(img.ravel(), minlength=256).astype(float)
    below = np.cumsum(counts)
    mass = np.cumsum(counts * np.arange(256))
    n, total = below[-1], mass[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (total * below - n * mass) ** 2 / (below * (n - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def above_otsu(img: np.ndarray) -> np.ndarray:
    return np.where(img > otsu(img), PAPER, INK).astype(np.uint8)


def _window_sums(values: np.ndarray, size: int) -> np.ndarray:
    r = size // 2
    padded = np.pad(values, ((r + 1, r), (r + 1, r)), "reflect" if min(values.shape) > r + 1 else "edge")
    sums = padded.cumsum(0).cumsum(1)
    return sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]


def sauvola(img: np.ndarray, size: int, k: float, spread: float = 127.5) -> np.ndarray:
    """Local threshold: mean * (1 + k (deviation / spread - 1))."""
    values, n = img.astype(float), size * size
    mean = _window_sums(values, size) / n
    deviation = np.sqrt(np.maximum(_window_sums(values * values, size) / n - mean * mean, 0))
    return mean * (1 + k * (deviation / spread - 1))


def adaptive(img: np.ndarray, size: int, less: float) -> np.ndarray:
    """Paper where a pixel is above the Gaussian mean around it minus ``less``."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    return np.where(img > np.rint(blur(img, sigma, size // 2, "edge")) - less, PAPER, INK).astype(np.uint8)


def _sweep(img: np.ndarray, kernel: np.ndarray, pick, fill: int, flip: bool) -> np.ndarray:
    kh, kw = kernel.shape
    ay, ax = kh // 2, kw // 2
    if flip:
        kernel, ay, ax = kernel[::-1, ::-1], kh - 1 - ay, kw - 1 - ax
    padded = np.pad(img, ((ay, kh - 1 - ay), (ax, kw - 1 - ax)), constant_values=fill)
    out = None
    for y, x in zip(*np.nonzero(kernel), strict=True):
        part = padded[y : y + img.shape[0], x : x + img.shape[1]]
        out = part.copy() if out is None else pick(out, part, out=out)
    return out


def box_kernel(height: int, width: int) -> np.ndarray:
    return np.ones((height, width), bool)


def ellipse_kernel(size: int) -> np.ndarray:
    r = size // 2
    if size < 3:
        return np.ones((size, size), bool)
    y = np.arange(size) - r
    reach = np.rint(r * np.sqrt(np.maximum(0, 1 - (y / max(r, 1)) ** 2))).astype(int)
    return np.abs(np.arange(size) - r)[None, :] <= reach[:, None]


def erode(img: np.ndarray, kernel: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        img = _sweep(img, kernel, np.minimum, 255, False)
    return img


def dilate(img: np.ndarray, kernel: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        img = _sweep(img, kernel, np.maximum, 0, True)
    return img


def opened(img: np.ndarray, kernel: np.ndarray, times: int = 1) -> np.ndarray:
    return dilate(erode(img, kernel, times), kernel, times)


def closed(img: np.ndarray, kernel: np.ndarray, times: int = 1) -> np.ndarray:
    return erode(dilate(img, kernel, times), kernel, times)


class Components:
    """8-connected components of ``mask``, numbered from 1 in reading order of
    their first run: ``labels`` and arrays ``x, y, w, h, area, cx, cy``. Runs
    of rows are joined to those they touch in the row above."""

    def __init__(self, mask: np.ndarray):
        height, width = mask.shape
        step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, start = np.nonzero(step == 1)
        end = np.nonzero(step == -1)[1]
        n = len(row)
        # runs of the row above that a run touches, corners included: an interval of run numbers
        key = row * (width + 2)
        low = np.searchsorted(key + end, key - (width + 2) + start, "left")
        high = np.searchsorted(key + start, key - (width + 2) + end, "right")
        many = np.maximum(high - low, 0) * (row > 0)
        a = np.repeat(np.arange(n), many)
        b = np.repeat(low, many) + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
        root = np.arange(n)
        while True:
            least = np.minimum(root[a], root[b])
            after = root.copy()
            np.minimum.at(after, root[a], least)
            np.minimum.at(after, root[b], least)
            after = after[after]
            if (after == root).all():
                break
            root = after
        number = np.unique(root, return_inverse=True)[1] if n else root
        self.n = int(number.max()) + 1 if n else 0
        self.labels = np.zeros(mask.shape, np.int32)
        size = end - start
        flat = np.repeat(row * width + start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        self.labels.ravel()[flat] = np.repeat(number + 1, size)
        first = lambda v, pick, fill: (lambda o: (pick.at(o, number, v), o)[1])(np.full(self.n, fill))
        self.x, self.y = first(start, np.minimum, width), first(row, np.minimum, height)
        self.w, self.h = first(end, np.maximum, 0) - self.x, first(row + 1, np.maximum, 0) - self.y
        self.area = np.bincount(number, weights=size, minlength=self.n).astype(int)
        total = np.maximum(self.area, 1)
        self.cx = np.bincount(number, weights=(start + end - 1) / 2 * size, minlength=self.n) / total
        self.cy = np.bincount(number, weights=row * size, minlength=self.n) / total

    def boxes(self) -> list[tuple[int, int, int, int]]:
        return [(int(x), int(y), int(x + w), int(y + h)) for x, y, w, h in zip(self.x, self.y, self.w, self.h, strict=True)]


def ink(binary: np.ndarray) -> Components:
    return Components(binary < 128)


def rotate(img: np.ndarray, degrees: float, fill: int = PAPER) -> np.ndarray:
    """Counter-clockwise about the centre on the same canvas, nearest pixel."""
    h, w = img.shape
    t = np.deg2rad(degrees)
    cos, sin = np.cos(t), np.sin(t)
    y, x = np.mgrid[0:h, 0:w]
    x, y = x - w / 2, y - h / 2
    sx = np.rint(cos * x - sin * y + w / 2).astype(int)
    sy = np.rint(sin * x + cos * y + h / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    return np.where(inside, img[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], fill).astype(img.dtype)


def row_variance(binary: np.ndarray) -> float:
    return float(np.var((binary < 128).sum(1)))


def rotated_variance(binary: np.ndarray, degrees: float) -> float:
    """Row variance after a rotation; only ink pixels are moved."""
    h, w = binary.shape
    y, x = np.nonzero(binary < 128)
    t = np.deg2rad(degrees)
    # the inverse of ``rotate``, applied to where ink stands
    dx, dy = x - w / 2, y - h / 2
    ny = np.rint(-np.sin(t) * dx + np.cos(t) * dy + h / 2).astype(int)
    nx = np.rint(np.cos(t) * dx + np.sin(t) * dy + w / 2).astype(int)
    ok = (ny >= 0) & (ny < h) & (nx >= 0) & (nx < w)
    return float(np.var(np.bincount(ny[ok], minlength=h)))


def sobel(img: np.ndarray, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Gradients along x and y."""
    padded = np.pad(img.astype(float), 1, "reflect" if min(img.shape) > 1 else "edge")
    dx, dy = padded[:, 2:] - padded[:, :-2], padded[2:] - padded[:-2]
    if size == 1:
        return dx[1:-1], dy[:, 1:-1]
    return dx[:-2] + 2 * dx[1:-1] + dx[2:], dy[:, :-2] + 2 * dy[:, 1:-1] + dy[:, 2:]


def canny(img: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: gradient above its two neighbours across, weak ones if connected to a strong one."""
    dx, dy = sobel(img)
    size = np.abs(dx) + np.abs(dy)
    padded = np.pad(size, 1)
    h, w = size.shape
    near = lambda a, b: padded[1 + a : 1 + a + h, 1 + b : 1 + b + w]
    flat, steep = np.abs(dy) < np.tan(np.pi / 8) * np.abs(dx), np.abs(dy) > np.tan(3 * np.pi / 8) * np.abs(dx)
    same = dx * dy > 0
    before = np.where(flat, near(0, -1), np.where(steep, near(-1, 0), np.where(same, near(-1, -1), near(-1, 1))))
    after = np.where(flat, near(0, 1), np.where(steep, near(1, 0), np.where(same, near(1, 1), near(1, -1))))
    ridge = (size > low) & (size > before) & (size >= after)
    parts = Components(ridge)
    strong = np.zeros(parts.n + 1, bool)
    strong[parts.labels[ridge & (size > high)]] = True
    strong[0] = False
    return strong[parts.labels]


def distance(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance to the nearest pixel outside: 0.955 straight, 1.3693 across."""
    straight, across = 0.955, 1.3693
    far = float(sum(mask.shape)) * 2
    out = np.where(mask, far, 0.0)
    w = mask.shape[1]
    ramp = straight * np.arange(w)

    def along(row: np.ndarray) -> np.ndarray:
        right = np.minimum.accumulate(row - ramp) + ramp
        left = (np.minimum.accumulate((row + ramp)[::-1])[::-1]) - ramp
        return np.minimum(right, left)

    for rows in (range(len(out)), range(len(out) - 1, -1, -1)):
        before = None
        for y in rows:
            row = out[y]
            if before is not None:
                wide = np.pad(before, 1, constant_values=far)
                row = np.minimum.reduce([row, before + straight, wide[:-2] + across, wide[2:] + across])
            out[y] = before = along(row)
    return out


def contours(mask: np.ndarray, inner: bool = True) -> list[np.ndarray]:
    """Outer border of each component, and the border of each hole if ``inner``, as points
    (x, y) in order; found by walking round with the background at one hand."""
    around = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    padded = np.pad(mask, 1)

    def walk(y: int, x: int, back: int, inside: np.ndarray) -> np.ndarray:
        points, first = [], None
        cy, cx, d = y, x, back
        for _ in range(4 * inside.size):
            for k in range(1, 9):
                e = (d + k) % 8
                ny, nx = cy + around[e][0], cx + around[e][1]
                if inside[ny, nx]:
                    break
            else:
                return np.array([(x - 1, y - 1)])
            if (cy, cx, e) == first:
                break
            first = first or (cy, cx, e)
            points.append((cx - 1, cy - 1))
            cy, cx, d = ny, nx, (e + 4) % 8
        return np.array(points)

    out = []
    parts = Components(padded)
    for k in range(1, parts.n + 1):
        y = int(parts.y[k - 1])
        x = int(np.flatnonzero(parts.labels[y] == k)[0])
        out.append(walk(y, x, 4, parts.labels == k))
    if not inner:
        return out
    holes = _holes(padded)
    for k in range(1, holes.max() + 1):
        y, x = (int(v[0]) for v in np.nonzero(holes == k))
        ring = padded & _grown(holes == k)
        out.append(walk(y, x - 1, 0, ring) if ring[y, x - 1] else np.argwhere(ring)[:, ::-1] - 1)
    return out


def _grown(mask: np.ndarray) -> np.ndarray:
    return dilate(mask.astype(np.uint8), box_kernel(3, 3)) > 0


def _holes(padded: np.ndarray) -> np.ndarray:
    """Labels of 4-connected background parts that do not reach the frame."""
    # 4-connected: background grown apart on a doubled grid, where corners do not touch
    h, w = padded.shape
    double = np.zeros((2 * h - 1, 2 * w - 1), bool)
    free = ~padded
    double[::2, ::2] = free
    double[1::2, ::2] = free[1:] & free[:-1]
    double[::2, 1::2] = free[:, 1:] & free[:, :-1]
    double[1::2, 1::2] = free[1:, 1:] & free[:-1, :-1] & free[1:, :-1] & free[:-1, 1:]
    parts = Components(double)
    labels = np.where(parts.labels[::2, ::2] == parts.labels[0, 0], 0, parts.labels[::2, ::2])
    return np.unique(labels, return_inverse=True)[1].reshape(labels.shape)


def polygon_area(points: np.ndarray) -> float:
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def thin(mask: np.ndarray) -> np.ndarray:
    """Skeleton by alternating removal of south-east and north-west border pixels."""
    img = np.pad(mask, 1).astype(np.uint8)
    while True:
        removed = False
        for side in (0, 1):
            n = [img[:-2, 1:-1], img[:-2, 2:], img[1:-1, 2:], img[2:, 2:], img[2:, 1:-1], img[2:, :-2], img[1:-1, :-2], img[:-2, :-2]]
            count = sum(x.astype(int) for x in n)
            turns = sum(((n[k] == 0) & (n[(k + 1) % 8] == 1)).astype(int) for k in range(8))
            east, south, north, west = n[2], n[4], n[0], n[6]
            rule = (north & east & south) | (east & south & west) if side == 0 else (north & east & west) | (north & south & west)
            gone = (img[1:-1, 1:-1] == 1) & (count >= 2) & (count <= 6) & (turns == 1) & (rule == 0)
            img[1:-1, 1:-1][gone] = 0
            removed |= bool(gone.any())
        if not removed:
            return img[1:-1, 1:-1] > 0


def lab(bgr: np.ndarray) -> np.ndarray:
    """8-bit L*a*b* (L of 0..255, a and b about 128) as floats, D65."""
    rgb = bgr[..., 2::-1].astype(float) / 255
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    # fixed values: sRGB to XYZ, white point
    matrix = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
    xyz = linear @ matrix.T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * np.cbrt(xyz[..., 1]) - 16, 903.3 * xyz[..., 1])
    out = np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)
    return np.clip(np.rint(out), 0, 255)


def kmeans(points: np.ndarray, k: int, rounds: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels; first centres drawn far apart."""
    rng = np.random.default_rng(seed)
    centres = points[rng.integers(len(points))][None]
    for _ in range(1, k):
        gap = ((points[:, None] - centres[None]) ** 2).sum(-1).min(1)
        centres = np.vstack([centres, points[rng.choice(len(points), p=gap / gap.sum())] if gap.sum() else points[0]])
    labels = np.zeros(len(points), int)
    for _ in range(rounds):
        labels = ((points[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        after = np.array([points[labels == j].mean(0) if (labels == j).any() else centres[j] for j in range(k)])
        if np.allclose(after, centres):
            break
        centres = after
    return centres, labels


def dominant_lab(bgr: np.ndarray, stride: int = 3, least_chroma: float = 10.0, k: int = 3) -> np.ndarray:
    """Centre of the largest of three clusters of coloured pixels (all, if fewer than ten are coloured)."""
    pixels = lab(bgr[::stride, ::stride]).reshape(-1, 3)
    coloured = pixels[np.hypot(pixels[:, 1] - 128, pixels[:, 2] - 128) >= least_chroma]
    if len(coloured) < 10:
        coloured = pixels
    centres, labels = kmeans(coloured, min(k, len(coloured)))
    return centres[np.bincount(labels).argmax()]


def colour_features(bgr: np.ndarray) -> np.ndarray:
    light, a, b = dominant_lab(bgr)
    return np.array([light, a, b, np.hypot(a - 128, b - 128), np.arctan2(b - 128, a - 128)], np.float32)


def gray_world(bgr: np.ndarray, low: float = 0.75, high: float = 1.5) -> np.ndarray:
    """Channels scaled towards a common mean, within limits."""
    means = bgr.reshape(-1, 3).astype(float).mean(0)
    return np.clip(bgr * np.clip(means.mean() / (means + 1e-6), low, high), 0, 255).astype(np.uint8)


def bilateral(img: np.ndarray, size: int = 9, colour: float = 75, space: float = 75) -> np.ndarray:
    """Mean of the neighbours within a disc, weighted by distance and by likeness."""
    r = size // 2
    padded = np.pad(img.astype(np.int16), r, "reflect" if min(img.shape) > r else "edge")
    values = img.astype(np.int16)
    likeness = np.exp(-(np.arange(256) ** 2) / (2 * colour**2)).astype(np.float32)
    total, weight = np.zeros(img.shape, np.float32), np.zeros(img.shape, np.float32)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx > r * r:
                continue
            part = padded[r + dy : r + dy + img.shape[0], r + dx : r + dx + img.shape[1]]
            w = likeness[np.abs(part - values)] * np.float32(np.exp(-(dy * dy + dx * dx) / (2 * space**2)))
            total += w * part
            weight += w
    return np.rint(total / weight).astype(np.uint8)


def peaks(values: np.ndarray, apart: int, least: float) -> np.ndarray:
    """Local maxima (the middle of plateaus) of at least ``least``; of those nearer than ``apart`` the highest stays."""
    change = np.flatnonzero(np.diff(values)) + 1
    start, end = np.concatenate([[0], change]), np.concatenate([change, [len(values)]])
    level = values[start]
    top = np.zeros(len(level), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    found = ((start + end - 1) // 2)[top]
    found = found[values[found] >= least]
    keep = np.ones(len(found), bool)
    for k in np.argsort(values[found], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(found - found[k]) < apart
            near[k] = False
            keep[near] = False
    return found[keep]


def runs(on: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs where ``on`` holds."""
    step = np.diff(np.concatenate([[0], np.asarray(on, np.int8), [0]]))
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))
