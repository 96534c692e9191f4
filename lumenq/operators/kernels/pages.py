"""From pictures to clean binary pages, and to the frames that hold text."""

from __future__ import annotations

import numpy as np

from . import imaging as im

# fixed values of the two preprocessing chains
LEAST_HEIGHT, PAD_SHARE, SKEW_RANGE, SKEW_STEP, SKEW_GAIN, LEAST_INK = 300, 0.05, 15.0, 0.5, 1.05, 50
SAUVOLA_WINDOW, SAUVOLA_KS = 25, (0.24, 0.32, 0.40, 0.48)
SCALE_HEIGHT, BACKGROUND_SHARE, ADAPTIVE_LESS = 1000, 0.7, 15
EDGE_LEVEL, CLOSE_WIDTH, PAD_FRAME = 125, 30, 0.2


def upscaled(img: np.ndarray) -> np.ndarray:
    h, w = img.shape[:2]
    return img if h >= LEAST_HEIGHT else im.resize(img, int(w * LEAST_HEIGHT / h), LEAST_HEIGHT, "cubic")


def binarized(gray: np.ndarray, local: bool = False) -> np.ndarray:
    """Ink 0 on paper 255, by the global level (or the local one), specks
    removed and strokes thickened. The local variant takes the first of four
    strengths that leaves at most a tenth of ink."""
    soft = np.rint(im.blur(gray, 0.8, 1)).astype(np.uint8)
    if local:
        size = max(11, min(SAUVOLA_WINDOW, min(gray.shape) // 8)) | 1
        for k in SAUVOLA_KS:
            page = np.where(soft < im.sauvola(soft, size, k), im.INK, im.PAPER).astype(np.uint8)
            if (page == im.INK).mean() <= 0.10:
                break
    else:
        page = im.above_otsu(soft)
    if (page == im.INK).mean() > 0.5:
        page = (255 - page).astype(np.uint8)
    out = thicken(im.opened(page, im.box_kernel(2, 2)))
    parts = im.ink(page)
    if parts.n:
        tiny = np.flatnonzero(parts.area <= max(1, int(0.02 * np.median(parts.area)))) + 1
        out[np.isin(parts.labels, tiny)] = im.INK
    return out


def thicken(page: np.ndarray) -> np.ndarray:
    """Ink grown by two pixels: an erosion of the paper."""
    return im.erode(page, im.box_kernel(2, 2))


def without_noise(page: np.ndarray) -> np.ndarray:
    """Components of under a hundredth of the median area (three pixels at least) or longer than 25 times their width go."""
    parts = im.ink(page)
    if not parts.n:
        return page.copy()
    long = np.maximum(parts.w, parts.h) / np.maximum(np.minimum(parts.w, parts.h), 1)
    good = (parts.area >= max(3.0, 0.01 * np.median(parts.area))) & (long <= 25)
    return np.where(np.concatenate([[False], good])[parts.labels], im.INK, im.PAPER).astype(np.uint8)


def projection_skew(page: np.ndarray) -> float | None:
    """Angle with the largest row variance; 0 unless it gains 5 %; None with hardly any ink."""
    if (page == im.INK).sum() < LEAST_INK:
        return None
    angles = np.arange(-SKEW_RANGE, SKEW_RANGE + SKEW_STEP / 2, SKEW_STEP)
    angles = angles[angles != 0]
    level = im.row_variance(page)
    scores = [im.rotated_variance(page, a) for a in angles]
    best = int(np.argmax(scores))
    return float(angles[best]) if scores[best] >= level * SKEW_GAIN and scores[best] > level else 0.0


def box_skew(page: np.ndarray) -> float | None:
    """Angle of the smallest rectangle around the ink, in -45..45; None with under ten pixels."""
    y, x = np.nonzero(page == im.INK)
    if len(x) < 10:
        return None
    best = min(np.arange(-45, 45.25, 0.5), key=lambda a: _extent(x, y, a))
    return float(best)


def _extent(x: np.ndarray, y: np.ndarray, degrees: float) -> float:
    t = np.deg2rad(degrees)
    u, v = np.cos(t) * x + np.sin(t) * y, np.cos(t) * y - np.sin(t) * x
    return float(np.ptp(u) * np.ptp(v)) + abs(degrees) * 1e-6


def deskewed(page: np.ndarray) -> tuple[np.ndarray, float]:
    h, w = page.shape
    my, mx = max(1, int(h * 0.02)), max(1, int(w * 0.02))
    inner = page[my : h - my, mx : w - mx]
    angle = projection_skew(inner)
    angle = box_skew(inner) if angle is None else angle
    return (im.rotate(page, angle), angle) if angle else (page.copy(), 0.0)


def arabic_page(img: np.ndarray) -> np.ndarray:
    """Up to size, gray, binary, clean, straight, with a white frame."""
    page, _ = deskewed(without_noise(binarized(im.gray(upscaled(img)))))
    h, w = page.shape
    return np.pad(page, ((int(h * PAD_SHARE),) * 2, (int(w * PAD_SHARE),) * 2), constant_values=im.PAPER)


def to_scale(gray: np.ndarray, height: int = SCALE_HEIGHT) -> np.ndarray:
    h, w = gray.shape
    return gray if h == height else im.resize(gray, max(1, round(w * height / h)), height, "cubic" if height > h else "area")


def flat_background(gray: np.ndarray, strength: float = BACKGROUND_SHARE) -> np.ndarray:
    """Divided by a blurred copy, mixed with the original."""
    h, w = gray.shape
    small = im.resize(gray, max(1, w // 8), max(1, h // 8), "area")
    sigma = max(1, (small.shape[0] // 7) | 1)
    ground = im.resize(np.rint(im.blur(small, sigma)).astype(np.uint8), w, h)
    even = np.clip(gray * 255.0 / np.clip(ground, 1, 255), 0, 255)
    return np.clip(strength * even + (1 - strength) * gray, 0, 255).astype(np.uint8)


def both_thresholds(gray: np.ndarray) -> np.ndarray:
    """Paper where both the local and the global threshold say so."""
    size = max(11, (gray.shape[0] // 100) | 1)
    return np.minimum(im.adaptive(gray, size, ADAPTIVE_LESS), im.above_otsu(gray))


def dark_ink(page: np.ndarray) -> np.ndarray:
    return (255 - page).astype(np.uint8) if (page == 255).mean() < 0.5 else page


def cleaned(ink_white: np.ndarray) -> np.ndarray:
    """Opened by a thousandth of the height, closed by a fortieth (ink is 255 here)."""
    h = ink_white.shape[0]
    out = im.opened(ink_white, im.ellipse_kernel(max(1, h // 1000)))
    size = max(1, h // 40)
    return im.closed(out, im.box_kernel(size, size))


def apart(ink_white: np.ndarray) -> np.ndarray:
    """Characters parted by a horizontal erosion of a five-hundredth of the height."""
    return im.erode(ink_white, im.box_kernel(1, max(1, ink_white.shape[0] // 500)))


def orientation(page: np.ndarray) -> float:
    """Angle of -90..90 with the largest row variance: by fives, then by ones about the best."""
    h, w = page.shape
    small = im.resize(page, 800, max(1, int(h * 800 / w)), "nearest") if w > 800 else page
    score = lambda a: im.rotated_variance(small, float(a))
    coarse = max(range(-90, 91, 5), key=score)
    best = float(max(range(coarse - 5, coarse + 6), key=score))
    return best if abs(best) >= 0.5 else 0.0


def oriented(page: np.ndarray) -> np.ndarray:
    angle = orientation(page)
    return im.rotate(page, angle) if angle else page


def latin_page(img: np.ndarray, height: int = SCALE_HEIGHT) -> np.ndarray:
    """Scaled to ``height`` rows, smooth, evenly lit, binary, clean and upright."""
    gray = flat_background(im.bilateral(to_scale(im.gray(img), height)))
    white = 255 - dark_ink(both_thresholds(gray))
    return oriented((255 - apart(cleaned(white.astype(np.uint8)))).astype(np.uint8))


def text_frames(img: np.ndarray) -> list[tuple[tuple[int, int, int, int], np.ndarray]]:
    """Boxes with strong vertical edges, joined along lines and padded; with their crops, top first."""
    gray = im.gray(img)
    h, w = gray.shape
    edges = np.where(np.abs(im.sobel(gray)[0]) > EDGE_LEVEL, 255, 0).astype(np.uint8)
    joined = im.closed(im.opened(edges, im.box_kernel(2, 2)), im.box_kernel(1, CLOSE_WIDTH), 2)
    out = []
    for x1, y1, x2, y2 in sorted(im.Components(joined > 0).boxes(), key=lambda b: (b[1], b[0])):
        px, py = max(1, int((x2 - x1) * PAD_FRAME // 2)), max(1, int((y2 - y1) * PAD_FRAME))
        box = (max(0, x1 - px), max(0, y1 - py), min(w, x2 + px), min(h, y2 + py))
        out.append((box, im.crop(img, box)))
    return out
