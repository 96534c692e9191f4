"""Page layout by other means: blocks between gaps, rhythm of edges, lines by baseline."""

from __future__ import annotations

import numpy as np

from . import imaging as im

# fixed values, as shares of the longer side unless named otherwise
GAP, MERGE, BLOCK, PAD, LEVEL, FILL = 0.008, 0.015, 0.01, 0.003, 0.02, 0.001
WINDOW, LEAST_EDGES, MOST_SPREAD, LEAST_GAP, MEAN_GAP, EDGE_LEVEL = 0.1, 6, 0.70, 1.0, 0.08, 125
SCORE, CLOSE, CLUSTER, OVERLAP, EXPAND, COVERAGE = 0.15, 0.015, 0.003, 0.40, 0.025, 0.70
BLUR, BLUR_CLUSTER, BLUR_MERGE = 0.04, 0.005, 0.05
BLOB_HEIGHTS, BLOB_AREA, ASSIGN, LINE_PAD = (0.3, 2.5), 0.05, 0.6, 0.25


def merged_spans(spans: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a - out[-1][1] <= gap:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def filled_spans(profile: np.ndarray, longer: int) -> list[tuple[int, int]]:
    """What lies between wide gaps of a projection, close spans joined, short ones gone; all of it without any."""
    n = len(profile)
    empty = np.zeros(n, bool)
    for a, b in im.runs(profile <= profile.max() * LEVEL):
        empty[a:b] = b - a >= max(2, int(longer * GAP))
    spans = merged_spans(im.runs(~empty), max(2, int(longer * MERGE)))
    return [s for s in spans if s[1] - s[0] >= max(4, int(longer * BLOCK))] or [(0, n)]


def blocks(img: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Cells of the grid of filled rows and columns that hold ink, left first; the whole page without any."""
    gray = im.gray(img)
    ink = 255 - (im.above_otsu(gray) if gray.max() > 1 else gray * 255).astype(int)
    h, w = ink.shape
    longer, pad = max(h, w), max(1, int(max(h, w) * PAD))
    out = []
    for y1, y2 in filled_spans(ink.sum(1), longer):
        for x1, x2 in filled_spans(ink.sum(0), longer):
            if ink[y1:y2, x1:x2].mean() >= FILL * 255:
                out.append((max(0, x1 - pad), max(0, y1 - pad), min(w, x2 + pad), min(h, y2 + pad)))
    return sorted(out, key=lambda b: b[:2]) or [(0, 0, w, h)]


def rhythm(edges: np.ndarray) -> float:
    """How much a row's edges look like words: short gaps within, longer regular
    ones between; half for how far the two are apart, half for regularity."""
    if len(edges) < LEAST_EDGES:
        return 0.0
    gaps = np.diff(edges).astype(float)
    middle = np.median(gaps)
    within, between = gaps[gaps <= middle], gaps[gaps > middle]
    if middle <= 0 or not len(between) or min(within.mean(), between.mean()) < LEAST_GAP:
        return 0.0
    spread = between.std() / (between.mean() + 1e-5)
    if spread > MOST_SPREAD:
        return 0.0
    return float(0.5 * (1 - (within.mean() + 1e-5) / between.mean()) + 0.5 * (1 - spread / MOST_SPREAD))


def row_scores(row: np.ndarray, window: int, mean_gap: float) -> np.ndarray:
    """Best rhythm of the windows over each pixel, stepping by a quarter."""
    out = np.zeros(len(row), np.float32)
    edges, half = np.flatnonzero(row), window // 2
    if len(edges) < LEAST_EDGES:
        return out
    for centre in range(half, len(row) - half, max(1, window // 4)):
        mine = edges[np.searchsorted(edges, centre - half) : np.searchsorted(edges, centre + half)]
        if LEAST_EDGES <= len(mine) <= max(LEAST_EDGES + 1, window // 3) and np.diff(mine).mean() <= mean_gap:
            part = out[max(0, centre - half) : centre + half]
            np.maximum(part, rhythm(mine), out=part)
    return out


def edge_map(gray: np.ndarray) -> np.ndarray:
    return np.abs(im.sobel(gray)[0]) > EDGE_LEVEL


def score_map(edges: np.ndarray, blurred: bool = False) -> np.ndarray:
    h, w = edges.shape
    out = np.stack([row_scores(r, max(40, int(w * WINDOW)), w * MEAN_GAP) for r in edges])
    if blurred:
        sigma = max(3, int(h * BLUR))
        out = np.stack([im.smooth(c, sigma) for c in out.T], 1)
    return out / out.max() if out.max() > 0 else out


def joined_overlaps(boxes: list[tuple], least: float = OVERLAP) -> list[tuple]:
    """Boxes grown together while one covers ``least`` of the smaller of two."""
    boxes = list(boxes)
    while True:
        for i, a in enumerate(boxes):
            for j in range(i + 1, len(boxes)):
                b = boxes[j]
                both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
                small = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
                if small and both / small >= least:
                    break
            else:
                continue
            boxes[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
            del boxes[j]
            break
        else:
            return boxes


def joined_neighbours(boxes: list[tuple], gap: float) -> list[tuple]:
    """In reading order, a box near the last one joins it."""
    out: list[tuple] = []
    for b in sorted(boxes, key=lambda b: (b[1], b[0])):
        if out:
            a = out[-1]
            if max(0, b[0] - a[2], a[0] - b[2]) <= gap and max(0, b[1] - a[3], a[1] - b[3]) <= gap:
                out[-1] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                continue
        out.append(b)
    return out


def rhythmic_frames(img: np.ndarray, blurred: bool = False) -> list[tuple[int, int, int, int]]:
    """Boxes of rhythmic edges, padded; the whole picture without any, or if one covers most of it."""
    gray = im.gray(img)
    h, w = gray.shape
    scores = score_map(edge_map(gray), blurred)
    if blurred:
        levels = (scores * 255).astype(np.uint8)
        parts = im.Components(levels > im.otsu(levels)) if levels.max() else im.Components(levels > 0)
        boxes = [b for b, n in zip(parts.boxes(), parts.area, strict=True) if n >= h * w * BLUR_CLUSTER]
        boxes = joined_neighbours(boxes, max(h, w) * BLUR_MERGE)
    else:
        size = max(3, int(max(h, w) * CLOSE))
        parts = im.Components(im.closed(np.where(scores >= SCORE, 255, 0).astype(np.uint8), im.box_kernel(size // 2, size)) > 0)
        boxes = joined_overlaps([b for b, n in zip(parts.boxes(), parts.area, strict=True) if n >= h * w * CLUSTER])
    whole = [(0, 0, w, h)]
    if not boxes or any((b[2] - b[0]) * (b[3] - b[1]) >= COVERAGE * h * w for b in boxes):
        return whole
    px, py = max(1, int(w * EXPAND // 2)), max(1, int(h * EXPAND))
    return [(max(0, b[0] - px), max(0, b[1] - py), min(w, b[2] + px), min(h, b[3] + py)) for b in boxes]


def baseline_lines(page: np.ndarray, height: float) -> list[tuple[int, int]]:
    """Components from left to right to the first line they overlap or whose
    median baseline is near; padded row ranges, top first."""
    parts = im.ink(page)
    good = np.flatnonzero((parts.h > BLOB_HEIGHTS[0] * height) & (parts.h < BLOB_HEIGHTS[1] * height) & (parts.area > BLOB_AREA * height**2))
    lines: list[list[int]] = []
    foot = parts.y + parts.h
    for k in good[np.argsort(parts.x[good] + parts.w[good] / 2, kind="stable")]:
        for line in lines:
            level = np.median(foot[line])
            overlap = min(foot[k], level + 0.3 * height) - max(parts.y[k], parts.y[line].min())
            if overlap >= ASSIGN * parts.h[k] or abs(foot[k] - level) < ASSIGN * height:
                line.append(int(k))
                break
        else:
            lines.append([int(k)])
    pad, rows = max(1, int(LINE_PAD * height)), page.shape[0]
    lines.sort(key=lambda line: np.median(foot[line]))
    return [(max(0, int(parts.y[x].min()) - pad), min(rows, int(foot[x].max()) + pad)) for x in lines]


def usual_shapes(page: np.ndarray) -> np.ndarray:
    """Components of a tenth of the median area at least, and not ten times longer than wide."""
    parts = im.ink(page)
    if not parts.n:
        return page.copy()
    ratio = parts.w / (parts.h + 1e-5)
    good = (parts.area >= 0.1 * np.median(parts.area)) & (ratio > 0.1) & (ratio < 10)
    return np.where(np.concatenate([[False], good])[parts.labels], im.INK, im.PAPER).astype(np.uint8)


def equalised(gray: np.ndarray, tiles: int = 8, clip: float = 2.0) -> np.ndarray:
    """Levels spread out tile by tile, with a limit on contrast, blended between tiles."""
    h, w = gray.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for r in range(tiles):
        for c in range(tiles):
            part = gray[ys[r] : max(ys[r + 1], ys[r] + 1), xs[c] : max(xs[c + 1], xs[c] + 1)]
            counts = np.bincount(part.ravel(), minlength=256).astype(float)
            top = max(1.0, clip * part.size / 256)
            over = np.maximum(counts - top, 0).sum()
            maps[r, c] = np.cumsum(np.minimum(counts, top) + over / 256) * 255 / part.size
    at = lambda n: np.clip((np.arange(n) + 0.5) * tiles / n - 0.5, 0, tiles - 1)
    y, x = at(h)[:, None], at(w)[None]
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    fy, fx = y - y0, x - x0
    out = (1 - fy) * ((1 - fx) * maps[y0, x0, gray] + fx * maps[y0, x1, gray]) + fy * ((1 - fx) * maps[y1, x0, gray] + fx * maps[y1, x1, gray])
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def enhanced(img: np.ndarray) -> np.ndarray:
    """Equalised gray with dark ink on light paper."""
    gray = equalised(im.gray(img))
    return (255 - gray).astype(np.uint8) if im.above_otsu(gray).mean() < 127 else gray


def beside(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two glyphs at one height, side by side, to be classified as one."""
    h = max(len(a), len(b))
    return np.hstack([im.resize(a, a.shape[1], h), im.resize(b, b.shape[1], h)])
