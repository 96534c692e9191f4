"""Pixel kernels: behaviour and invariants on small drawn arrays."""

import numpy as np
import pytest

from lumenq.operators.kernels import features as ft
from lumenq.operators.kernels import imaging as im
from lumenq.operators.kernels import pages, segment


def white(h, w, *bands, channels=0):
    img = np.full((h, w, channels) if channels else (h, w), 255, np.uint8)
    for y1, y2, x1, x2 in bands:
        img[y1:y2, x1:x2] = 0
    return img


def flood(mask):
    labels, k = np.zeros(mask.shape, int), 0
    for y, x in np.argwhere(mask):
        if labels[y, x]:
            continue
        k += 1
        stack = [(y, x)]
        labels[y, x] = k
        while stack:
            a, b = stack.pop()
            for u in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                for v in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                    if mask[u, v] and not labels[u, v]:
                        labels[u, v] = k
                        stack.append((u, v))
    return labels


@pytest.mark.parametrize("seed", range(6))
def test_components_match_flood_fill(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((30, 40)) < (0.2 + 0.1 * seed)
    parts, labels = im.Components(mask), flood(mask)
    assert (parts.labels == labels).all()
    for k in range(1, parts.n + 1):
        y, x = np.nonzero(labels == k)
        assert (parts.x[k - 1], parts.y[k - 1], parts.w[k - 1], parts.h[k - 1], parts.area[k - 1]) == (x.min(), y.min(), np.ptp(x) + 1, np.ptp(y) + 1, len(x))
        assert parts.cx[k - 1] == pytest.approx(x.mean()) and parts.cy[k - 1] == pytest.approx(y.mean())
    assert im.Components(np.zeros((4, 5), bool)).n == 0


def test_lengths_of_feature_vectors():
    block = white(20, 15, (3, 17, 2, 13))
    vector = ft.arabic_character(block, [{"cx": 10.0, "cluster_size": 2, "position": "above"}, {"cx": 15.0, "cluster_size": 1, "position": "below"}])
    assert vector.shape == (2049,) and vector.dtype == np.float32
    assert vector[-4:].tolist() == [2, 1, 1, 2.5] and ft.dots(None).tolist() == [0, 0, 0, 0]
    assert ft.fit(block, 32).shape == (32, 32) and ft.contour(ft.fit(block, 32)).shape == (192,)
    assert (0 <= vector[:64]).all() and (vector[:64] <= 1).all()
    assert ft.latin_character(block).shape == (498,)
    assert ft.patch(white(120, 80, (30, 60, 20, 50), channels=3)).shape == (4548,)
    square = white(96, 96, (32, 64, 32, 64))
    assert ft.hog(square, 8).shape == (4356,) and ft.hog(square, 8).max() > 0
    assert ft.gradient_grid(square).shape == (128,) and 0 <= ft.gradient_grid(square).min() <= ft.gradient_grid(square).max() <= 1
    diagonal = np.zeros((96, 96), np.uint8)
    for k in range(95):
        diagonal[k : k + 2, k] = 255
    assert ft.edge_density(diagonal).shape == (64,) and 0 < ft.edge_density(diagonal).max() <= 1
    assert (ft.fit(np.zeros((0, 0), np.uint8), 32) == 255).all()


def test_zernike_does_not_turn():
    rng = np.random.default_rng(0)
    mask = np.zeros((32, 32), bool)
    mask[8:24, 10:20] = rng.random((16, 10)) < 0.6
    assert np.allclose(ft.zernike(mask), ft.zernike(np.rot90(mask)), atol=1e-5)
    assert len(ft.zernike(mask)) == 25


def test_borders_go_round():
    ring = np.zeros((20, 20), bool)
    ring[4:16, 4:16] = True
    ring[8:12, 8:12] = False
    lines = im.contours(ring)
    assert [len(c) for c in lines] == [44, 16]
    for line in lines:
        assert all(ring[y, x] for x, y in line)
        assert np.abs(np.diff(np.vstack([line, line[:1]]), axis=0)).max() <= 1
    assert im.polygon_area(lines[0]) == 121 and len(im.contours(ring, inner=False)) == 1
    assert ft.topology(np.where(ring, 0, 255).astype(np.uint8))[0] == pytest.approx(0.2)


def test_thinning_keeps_pieces_and_thins():
    mask = white(40, 60, (5, 12, 5, 50), (20, 34, 30, 36)) == 0
    bones = im.thin(mask)
    assert im.Components(bones).n == 2 and bones.sum() < mask.sum() / 3 and not (bones & ~mask).any()


def test_distance_is_between_the_true_ones():
    rng = np.random.default_rng(2)
    mask = rng.random((20, 30)) < 0.9
    y, x = np.nonzero(~mask)
    at = np.argwhere(mask)
    true = np.sqrt(((at[:, None] - np.stack([y, x], 1)[None]) ** 2).sum(-1)).min(1)
    got = im.distance(mask)[mask]
    assert (np.abs(got - true) <= 0.1 * true + 0.05).all()


def test_thresholds_and_morphology():
    rng = np.random.default_rng(1)
    img = np.concatenate([rng.normal(60, 10, 500), rng.normal(200, 10, 500)]).clip(0, 255).astype(np.uint8).reshape(20, 50)
    assert 80 < im.otsu(img) < 180
    assert set(np.unique(pages.binarized(np.full((100, 100), 255, np.uint8)))) <= {0, 255}
    mask = (rng.random((30, 30)) < 0.5).astype(np.uint8) * 255
    kernel = im.box_kernel(3, 2)
    assert (im.erode(mask, kernel) <= im.dilate(mask, kernel)).all()
    assert (im.opened(mask, kernel) <= mask).all() and (im.closed(mask, kernel) >= mask).all()
    assert (im.opened(im.opened(mask, kernel), kernel) == im.opened(mask, kernel)).all()
    window = im.sauvola(np.full((40, 40), 100, np.uint8), 11, 0.2)
    assert np.allclose(window, 80)


def test_resizing():
    ramp = np.tile(np.arange(100, dtype=np.uint8), (40, 1))
    assert im.resize(ramp, 50, 20, "area").shape == (20, 50)
    assert np.allclose(im.resize(ramp, 50, 20, "area")[0], np.arange(0, 100, 2) + 0.5, atol=0.5)
    assert (im.resize(ramp, 100, 40, "cubic") == ramp).all() and (im.resize(ramp, 100, 40, "linear") == ramp).all()
    assert im.shrink(np.zeros((1001, 4000), np.uint8), 2000).shape == (500, 2000)
    assert im.shrink(np.zeros((1002, 4000), np.uint8), 2000, True).shape == (501, 2000) and im.shrink(ramp, 100) is ramp


def test_rotation_and_skew():
    ruled = white(100, 200, *[(y, y + 1, 0, 200) for y in range(10, 90, 15)])
    assert pages.orientation(ruled) == 0.0 and pages.oriented(ruled) is ruled
    page = white(240, 400, *[(y, y + 8, 60, 340) for y in range(60, 190, 30)])
    turned = im.rotate(page, 6)
    assert pages.projection_skew(turned) == pytest.approx(-6, abs=0.6)
    assert pages.deskewed(np.full((100, 100), 255, np.uint8))[1] == 0.0
    assert im.rotated_variance(page, 6) == pytest.approx(im.row_variance(turned), rel=0.1)


def test_colours():
    for bgr in ((0, 0, 200), (200, 0, 0), (255, 255, 255), (0, 0, 0), (128, 128, 128)):
        light, a, b, chroma, hue = im.colour_features(np.full((64, 64, 3), bgr, np.uint8))
        assert 0 <= light <= 255 and chroma == pytest.approx(np.hypot(a - 128, b - 128), abs=1e-4) and -np.pi <= hue <= np.pi
    assert im.colour_features(np.array([[[0, 128, 255]]], np.uint8)).shape == (5,)
    assert im.lab(np.full((1, 1, 3), 255, np.uint8)).tolist() == [[[255, 128, 128]]]
    assert im.gray_world(np.full((4, 4, 3), (10, 20, 30), np.uint8)).shape == (4, 4, 3)


def test_lines_subwords_and_dots():
    two = white(200, 400, (30, 60, 50, 350), (110, 140, 50, 350))
    found = segment.lines(two)
    assert len(found) == 2 and found[0][0] < found[1][0]
    assert segment.paws(white(50, 120, (10, 40, 0, 120)), 20) == [(0, 120)]
    three = segment.paws(white(50, 300, (10, 40, 20, 80), (10, 40, 120, 180), (10, 40, 230, 280)), 20)
    assert len(three) == 3 and three == sorted(three, reverse=True)
    paw = white(60, 120, (20, 50, 10, 110), (10, 13, 30, 33), (8, 16, 70, 78))
    body, dots = segment.without_dots(paw, 20)
    assert len(dots) == 2 and all(d["position"] == "above" for d in dots) and body.shape == paw.shape
    assert (body[20:50, 10:110] == 0).all() and (body[:20] == 255).all()


def test_characters_are_apart_and_within():
    rng = np.random.default_rng(4)
    for _ in range(20):
        paw = np.where(rng.random((40, 90)) < 0.3, 0, 255).astype(np.uint8)
        paw[15:30, 5:85] = 0
        boxes = segment.characters(paw, 20)
        assert boxes == sorted(boxes, reverse=True) and boxes[0][1] == 90 and boxes[-1][0] == 0
        assert all(a == d for (a, _), (_, d) in zip(boxes, boxes[1:], strict=False)) and all(b - a > 1 for a, b in boxes)
    page = pages.arabic_page(white(400, 600, (60, 100, 50, 550), (180, 220, 50, 550), channels=3))
    chars = segment.arabic_characters(page)
    assert chars and {c["line_idx"] for c in chars} == {0, 1}
    assert segment.arabic_characters(pages.arabic_page(np.full((200, 300, 3), 255, np.uint8))) == []


def test_best_cuts_is_the_best_of_all():
    from itertools import combinations

    rng = np.random.default_rng(7)
    for _ in range(20):
        paw = np.where(rng.random((30, 60)) < 0.25, 0, 255).astype(np.uint8)
        inner = sorted(rng.choice(np.arange(2, 58), 5, replace=False).tolist())
        worth = lambda cuts: sum(100 * segment.looks_like_char(paw[:, a:b], 18) - 12 for a, b in zip(cuts, cuts[1:], strict=False))  # noqa: E731, B023
        options = [[0, *c, 60] for n in range(6) for c in combinations(inner, n)]
        got = segment.best_cuts(paw, [0, *inner, 60], 18)
        assert worth(got) == max(map(worth, options)) or not any(segment.looks_like_char(paw[:, a:b], 18) for o in options for a, b in zip(o, o[1:], strict=False))


def test_words_and_characters_left_to_right():
    page = white(120, 400, *[(30, 52, x, x + 11) for word in (30, 150, 270) for x in range(word, word + 60, 15)])
    rows, height = segment.text_lines(page)
    assert len(rows) == 1 and height == 22
    assert len(segment.text_words(page, *rows[0], height)) == 3
    chars = segment.latin_characters(page)
    assert len(chars) == 12 and {c["word_idx"] for c in chars} == {0, 1, 2}
    dotted = white(80, 60, (40, 62, 20, 24), (30, 33, 20, 24))
    assert segment.text_characters(dotted, 0, 0, 12.0) == [(20, 30, 24, 62)]
    assert segment.text_lines(np.full((50, 50), 255, np.uint8))[0] == []


def test_wide_blobs_are_cut_everywhere():
    blob = np.ones((20, 100), bool)
    pieces = segment.chopped(blob, 20)
    assert pieces[0][0] == 0 and pieces[-1][1] == 100 and all(b == c for (_, b), (c, _) in zip(pieces, pieces[1:], strict=False))
    assert all(b - a <= 36 for a, b in pieces)


def test_frames_hold_the_text():
    img = white(300, 500, *[(y, y + 22, x, x + 8) for y in (40, 160) for x in range(60, 400, 14)], channels=3)
    frames = pages.text_frames(img)
    assert len(frames) == 2
    for (x1, y1, x2, y2), cropped in frames:
        assert cropped.shape[:2] == (y2 - y1, x2 - x1) and x1 <= 60 and x2 >= 395


def test_peaks_are_apart_and_highest():
    rng = np.random.default_rng(3)
    for _ in range(30):
        v = rng.integers(0, 9, 60).astype(float)
        found = im.peaks(v, 6, 2)
        assert (np.diff(found) >= 6).all() and (v[found] >= 2).all()


def test_clusters_match_a_plain_walk():
    rng = np.random.default_rng(5)
    for _ in range(20):
        points = rng.random((12, 2)) * 10
        root = segment.clusters(points, 2.0)
        near = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1)) <= 2.0
        reach = np.linalg.matrix_power(near.astype(np.int64), 12) > 0
        assert ((root[:, None] == root[None]) == reach).all()
