"""Lines, words, sub-words, dots and characters of binary pages."""

from __future__ import annotations

import numpy as np

from . import imaging as im

# fixed values of the right-to-left segmentation
LINE_LEVEL, LINE_HEIGHT, LINE_GAP, PAW_DILATE, PAW_WIDTH = 0.10, 0.3, 0.25, 0.25, 0.3
VALLEY, VALLEY_WIDTH, SLIVER, TINY_SHARE = 0.70, 0.06, 0.25, 0.25
CHAR_HEIGHT, CHAR_WIDTH, CHAR_AREA = (0.3, 2.0), (0.1, 3.0), 0.05
SCALES = (1.0, 0.85, 1.15, 0.7, 1.3)
# fixed values of the left-to-right segmentation
HEIGHTS, AREA, BANDWIDTH, PROMINENCE, REACH, ORPHANS, LINE_PAD = (0.3, 4.5), 0.05, 0.6, 0.15, 1.2, 3, 0.15
WIDTHS, CUT_LEVEL, CUT_RADIUS = (0.1, 1.8), 0.35, 4


def character_height(page: np.ndarray, share: float = 70, least_area: int = 0) -> float:
    parts = im.ink(page)
    heights = parts.h[parts.area > least_area] if parts.n else []
    return float(np.percentile(heights, share)) if len(heights) else 20.0


# ------------------------------------------------------------ right to left


def lines(page: np.ndarray) -> list[tuple[int, int]]:
    """Row ranges of text lines: runs of smoothed ink, close ones joined."""
    height = character_height(page)
    density = im.smooth((page == im.INK).sum(1), 2)
    found = [(a, b) for a, b in im.runs(density > density.max() * LINE_LEVEL) if b - a >= LINE_HEIGHT * height]
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a - out[-1][1] <= max(1, int(LINE_GAP * height)):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def paws(line: np.ndarray, height: float) -> list[tuple[int, int]]:
    """Column ranges of sub-words, the rightmost first; the whole line without any."""
    grown = im.dilate((255 - line).astype(np.uint8), im.box_kernel(1, max(1, round(PAW_DILATE * height))))
    found = [(a, b) for a, b in im.runs((grown > 0).any(0)) if b - a >= max(1, round(PAW_WIDTH * height))]
    return sorted(found, reverse=True) or [(0, line.shape[1])]


def baseline(parts: im.Components, rows: int, height: float) -> float:
    """Most frequent bottom of what is no dot, the highest of equal ones; else three quarters down."""
    aspect = parts.h / (parts.w + 1e-5)
    dot = (parts.h < 0.4 * height) & (parts.w < 0.4 * height) & (parts.area < 0.15 * height**2) & (aspect >= 0.25) & (aspect <= 4)
    bottoms = (parts.y + parts.h)[~dot]
    if not len(bottoms):
        return rows * 0.75
    values, counts = np.unique(bottoms, return_counts=True)
    return float(values[counts.argmax()])


def clusters(points: np.ndarray, reach: float) -> np.ndarray:
    """Smallest member of each point's cluster."""
    near = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1)) <= reach
    root = np.arange(len(points))
    while True:
        after = np.where(near, root[None], len(points)).min(1)
        if (after == root).all():
            return root
        root = after


def without_dots(paw: np.ndarray, height: float) -> tuple[np.ndarray, list[dict]]:
    """The sub-word without its dots, and the dots by cluster, above or below the baseline."""
    parts = im.ink(paw)
    if not parts.n:
        return paw.copy(), []
    small = np.maximum(parts.h, parts.w) <= max(2.0, 0.6 * height)
    light = parts.area <= max(1.0, min(0.2 * height**2, np.percentile(parts.area, 25) * 1.5))
    aspect = parts.h / (parts.w + 1e-5)
    body, found = paw.copy(), []
    for k in np.flatnonzero((small | light) & (aspect >= 0.2) & (aspect <= 6)):
        inside = parts.labels[parts.y[k] : parts.y[k] + parts.h[k], parts.x[k] : parts.x[k] + parts.w[k]]
        if not ((inside != 0) & (inside != k + 1)).any():  # nothing else in its box
            body[parts.labels == k + 1] = im.PAPER
            found.append((parts.cx[k], parts.cy[k]))
    if not found:
        return body, []
    at, level = np.array(found), baseline(parts, paw.shape[0], height)
    root = clusters(at, 0.5 * height)
    out = []
    for r in np.unique(root):
        cx, cy = at[root == r].mean(0)
        out.append({"cx": float(cx), "cy": float(cy), "cluster_size": int((root == r).sum()), "position": "above" if cy < level else "below"})
    return body, out


def looks_like_char(crop: np.ndarray, height: float) -> bool:
    dark = crop == im.INK
    rows = int(dark.any(1).sum())
    return bool(
        dark.any() and CHAR_HEIGHT[0] * height <= rows <= CHAR_HEIGHT[1] * height
        and CHAR_WIDTH[0] * height <= crop.shape[1] <= CHAR_WIDTH[1] * height and dark.sum() >= CHAR_AREA * height**2
    )


def best_cuts(paw: np.ndarray, cuts: list[int], height: float) -> list[int]:
    """Cuts that give most good characters for fewest segments: 100 for a good one, 12 for a segment."""
    best: list[tuple[int, int, int] | None] = [(0, 0, -1)] + [None] * (len(cuts) - 1)
    for i in range(1, len(cuts)):
        for j in range(i):
            if best[j] is None:
                continue
            good, n = best[j][0] + looks_like_char(paw[:, cuts[j] : cuts[i]], height), best[j][1] + 1
            if best[i] is None or 100 * good - 12 * n > 100 * best[i][0] - 12 * best[i][1]:
                best[i] = (good, n, j)
    if best[-1] is None or not best[-1][0]:
        return [cuts[0], cuts[-1]]
    path, i = [], len(cuts) - 1
    while i >= 0:
        path.append(cuts[i])
        i = best[i][2]
    return path[::-1]


def _join_at(cuts: list[int], k: int) -> list[int]:
    """Segment k joined with its narrower neighbour."""
    left = cuts[k] - cuts[k - 1] if k else np.inf
    right = cuts[k + 2] - cuts[k + 1] if k + 2 < len(cuts) else np.inf
    gone = k if left <= right else k + 1
    return cuts[:gone] + cuts[gone + 1 :]


def character_cuts(paw: np.ndarray, height: float) -> list[int]:
    """Cuts of a sub-word: valleys of its ink, chosen by ``best_cuts``; slivers
    and bad segments join a neighbour; one segment if that leaves a bad one."""
    h, w = paw.shape
    ink_ = (paw == im.INK).sum(0)
    whole = [0, w]
    if w < 2 or not ink_.max():
        return whole
    level = VALLEY * np.percentile(ink_[ink_ > 0], 90)
    wide = max(1, round(VALLEY_WIDTH * height))
    valleys = [(a + b - 1) // 2 for a, b in im.runs(ink_ < level) if b - a >= wide]
    if not valleys:
        return whole
    cuts = best_cuts(paw, sorted({0, w, *valleys}), height)
    sliver = max(2, round(SLIVER * height))
    most = max(2, round(w / max(1.0, 0.9 * height)))
    while len(cuts) > 2:
        size = np.diff(cuts)
        bad = [k for k in range(len(size)) if size[k] <= sliver or not looks_like_char(paw[:, cuts[k] : cuts[k + 1]], height)]
        if bad:
            cuts = _join_at(cuts, min(bad, key=lambda k: size[k]))
        elif len(size) > most:
            cuts = _join_at(cuts, int(size.argmin()))
        else:
            break
    good = all(looks_like_char(paw[:, a:b], height) for a, b in zip(cuts, cuts[1:], strict=False))
    return cuts if good else whole


def characters(paw: np.ndarray, height: float) -> list[tuple[int, int]]:
    """Column ranges of the characters, rightmost first: the best of five scales
    of the height, judged by good and tiny segments and the number expected."""
    w = paw.shape[1]
    expected = max(1, round(w / max(1.0, 0.9 * height)))

    def worth(cuts: list[int]) -> float:
        size = np.diff(cuts)
        good = sum(looks_like_char(paw[:, a:b], height) for a, b in zip(cuts, cuts[1:], strict=False))
        return good - 0.5 * (size <= max(1, round(SLIVER * height))).mean() - 0.3 * abs(len(size) - expected) / expected

    tried = {round(max(1.0, height * s)): max(1.0, height * s) for s in reversed(SCALES)}
    options = [character_cuts(paw, s) for s in sorted(tried.values(), key=lambda s: SCALES.index(min(SCALES, key=lambda x: abs(x * height - s))))]
    cuts = max(options, key=worth)
    return [(a, b) for a, b in zip(cuts, cuts[1:], strict=False)][::-1]


def position(index: int, count: int) -> str:
    return "isolated" if count == 1 else "initial" if index == 0 else "final" if index == count - 1 else "medial"


def arabic_characters(page: np.ndarray) -> list[dict]:
    """All characters of a page in reading order, with their dots: each dot goes
    to the nearest character of its sub-word, if near enough."""
    out = []
    for line_idx, (y1, y2) in enumerate(lines(page)):
        line = page[y1:y2]
        height = character_height(line)
        for paw_idx, (x1, x2) in enumerate(paws(line, height)):
            paw = line[:, x1:x2]
            body, marks = without_dots(paw, height)
            boxes = characters(body, height)
            centres = np.array([(a + b) / 2 for a, b in boxes])
            reach = max(4, int(0.7 * int(np.mean([b - a for a, b in boxes]))))
            mine: list[list[dict]] = [[] for _ in boxes]
            for d in marks:
                gap = np.abs(centres - d["cx"])
                if gap.min() <= reach:
                    mine[int(gap.argmin())].append(d)
            for char_idx, (a, b) in enumerate(boxes):
                out.append({"line_idx": line_idx, "paw_idx": paw_idx, "char_idx": char_idx, "x": x1 + a, "y": y1, "position": position(char_idx, len(boxes)), "dots": mine[char_idx], "img": paw[:, a:b]})
    return out


# ------------------------------------------------------------ left to right


def _middling(parts: im.Components, height: float) -> np.ndarray:
    return np.flatnonzero((parts.h > HEIGHTS[0] * height) & (parts.h < HEIGHTS[1] * height) & (parts.area > AREA * height**2))


def text_lines(page: np.ndarray, height: float | None = None) -> tuple[list[tuple[int, int]], float]:
    """Row ranges of lines: peaks of the density of component centres; what is
    far from every peak makes lines of its own if three hang together."""
    height = character_height(page, 50, 5) if height is None else height
    parts = im.ink(page)
    some = _middling(parts, height)
    if not len(some):
        return [], height
    rows = page.shape[0]
    top, bottom = parts.y[some], parts.y[some] + parts.h[some]
    centre = parts.y[some] + parts.h[some] / 2
    votes = np.bincount(np.clip(centre, 0, rows - 1).astype(int), minlength=rows)
    density = im.smooth(votes, BANDWIDTH * height)
    spots = im.peaks(density, max(1, int(0.8 * height)), density.max() * PROMINENCE)
    if not len(spots):
        return [], height
    gap = np.abs(centre[:, None] - spots[None])
    owner = np.where(gap.min(1) <= REACH * height, gap.argmin(1), -1)
    groups = [np.flatnonzero(owner == k) for k in range(len(spots))]
    left = np.flatnonzero(owner == -1)
    left = left[np.argsort(centre[left], kind="stable")]
    if len(left):
        ends = np.maximum.accumulate(bottom[left])
        cut = np.flatnonzero(top[left][1:] > ends[:-1] + 0.5 * height) + 1
        groups += [g for g in np.split(left, cut) if len(g) >= ORPHANS]
    pad = max(1, int(LINE_PAD * height))
    return sorted((max(0, int(top[g].min()) - pad), min(rows, int(bottom[g].max()) + pad)) for g in groups if len(g)), height


def gap_threshold(gaps: np.ndarray, height: float, scale: float = 0.75) -> float:
    gaps = np.sort(gaps[gaps > 0])
    if not len(gaps):
        return height * scale
    if len(gaps) < 4:
        return float(gaps[-1]) * 0.75
    middle = float(np.median(gaps))
    large = gaps[gaps > middle]
    return max((float(gaps[gaps <= middle].mean()) + float(large.mean())) / 2, 0.3 * height) if len(large) else 2 * middle


def text_words(page: np.ndarray, top: int, bottom: int, height: float) -> list[tuple[int, int, int, int]]:
    parts = im.ink(page[top:bottom])
    boxes = np.array(parts.boxes()).reshape(-1, 4)[_middling(parts, height)]
    if not len(boxes):
        return []
    boxes = boxes[np.argsort(boxes[:, 0], kind="stable")]
    gaps = boxes[1:, 0] - boxes[:-1, 2]
    groups = np.split(boxes, np.flatnonzero(gaps > gap_threshold(gaps, height)) + 1)
    return [(int(g[:, 0].min()), top + int(g[:, 1].min()), int(g[:, 2].max()), top + int(g[:, 3].max())) for g in groups]


def cut_candidates(blob: np.ndarray) -> list[int]:
    """Thin columns, and those about the quarters."""
    thick = im.distance(blob).max(0)
    w = len(thick)
    spots = {x for m in (w // 2, w // 4, 3 * w // 4) for x in range(m - CUT_RADIUS, m + CUT_RADIUS + 1) if 1 <= x <= w - 1}
    if thick.max() > 0 and w > 2:
        n = thick / thick.max()
        low = (n[1:-1] < CUT_LEVEL) & (n[1:-1] <= n[:-2]) & (n[1:-1] <= n[2:])
        spots |= set((np.flatnonzero(low) + 1).tolist())
    return sorted(spots)


def best_cut(cuts: list[int], start: int, width: int, least: int, height: float, relaxed: bool = False) -> int | None:
    """The cut after ``start`` that leaves a piece nearest to ``height``, with no piece under ``least`` unless relaxed."""
    fits = lambda e: relaxed or (e - start >= least and not 0 < width - e < least)
    return min((e for e in cuts if start < e <= width and fits(e)), key=lambda e: abs(e - start - height), default=None)


def chopped(blob: np.ndarray, height: float) -> list[tuple[int, int]]:
    """Column ranges of a blob that is too wide for one character."""
    w = blob.shape[1]
    cuts = [] if w <= WIDTHS[1] * height else cut_candidates(blob)
    if not cuts:
        return [(0, w)]
    least, out, start = int(WIDTHS[0] * height * 5), [], 0
    while start < w:
        end = best_cut([*cuts, w], start, w, least, height) or best_cut([*cuts, w], start, w, least, height, True) or w
        pieces = chopped(blob[:, start:end], height) if end - start < w else [(0, w)]
        out += [(start + a, start + b) for a, b in pieces]
        start = end
    return out


def text_characters(word: np.ndarray, x: int, y: int, height: float) -> list[tuple[int, int, int, int]]:
    """Boxes of a word's characters, left first: wide blobs are cut, and parts
    wholly above a character (dots, accents) join it, each one once."""
    parts = im.ink(word)
    boxes = parts.boxes()
    found = []
    for k, (x1, y1, x2, y2) in enumerate(boxes):
        if y2 - y1 < HEIGHTS[0] * height or parts.area[k] < AREA * height**2:
            continue
        found += [(x1 + a, y1, x1 + b, y2) for a, b in chopped(parts.labels[y1:y2, x1:x2] == k + 1, height)]
    found.sort(key=lambda b: b[0])
    good = [b for b in found if HEIGHTS[0] * height < b[3] - b[1] < HEIGHTS[1] * height and (b[2] - b[0]) * (b[3] - b[1]) > AREA * height**2 and WIDTHS[0] * height < b[2] - b[0] < WIDTHS[1] * height]
    taken, out = set(), []
    for own in good:
        box = own
        for part in boxes:
            if part != own and part not in taken and part[2] > box[0] and part[0] < box[2] and part[3] <= box[1]:
                taken.add(part)
                box = (min(box[0], part[0]), part[1], max(box[2], part[2]), box[3])
        out.append((own, box))
    return [(x + b[0], y + b[1], x + b[2], y + b[3]) for own, b in out if own not in taken]


def latin_characters(page: np.ndarray) -> list[dict]:
    """All characters of a page: line, word, place and padded crop."""
    out, word_idx, char_idx = [], 0, 0
    rows, height = text_lines(page)
    for line_idx, (top, bottom) in enumerate(rows):
        words = text_words(page, top, bottom, height)
        middle = float(np.median([b[3] - b[1] for b in words])) if words else height
        for x1, y1, x2, y2 in words:
            w, h = x2 - x1, y2 - y1
            if not (w * h > 100 and h > 8 and 0.1 < w / (h + 1e-5) < 20 and 0.4 < h / (middle + 1e-5) < 1.6):
                continue
            for a, b, c, d in text_characters(page[y1:y2, x1:x2], x1, y1, height):
                crop = page[b:d, a:c]
                out.append({"line_idx": line_idx, "word_idx": word_idx, "word_x": x1, "char_idx": char_idx, "x": a, "y": b, "img": np.pad(crop, (d - b) // 4, constant_values=im.PAPER)})
                char_idx += 1
            word_idx += 1
    return out
