import numpy as np

from lumenq.operators.kernels import imaging as im
from lumenq.operators.kernels import layout

from .test_kernels import white


def test_blocks_between_gaps():
    img = white(400, 600, (40, 180, 40, 280), (40, 180, 340, 560), (240, 360, 40, 280))
    found = layout.blocks(img)
    assert len(found) == 3 and found == sorted(found, key=lambda b: b[:2])
    assert layout.blocks(np.full((50, 60), 255, np.uint8)) == [(0, 0, 60, 50)]
    assert layout.merged_spans([(0, 5), (7, 9), (20, 30)], 2) == [(0, 9), (20, 30)]


def test_rhythm_of_words():
    words = np.cumsum([2, 2, 2, 9] * 6)
    assert layout.rhythm(words) > 0.7 and layout.rhythm(np.arange(0, 60, 5)) == 0 and layout.rhythm(words[:4]) == 0
    row = np.zeros(400, bool)
    row[words + 100] = True
    scores = layout.row_scores(row, 80, 30)
    assert scores[100:190].max() > 0.5 and scores[300:].max() == 0


def test_frames_by_rhythm():
    img = np.full((240, 400), 255, np.uint8)
    x = 60
    while x < 300:
        for k in range(4):
            img[100:120, x + 6 * k : x + 6 * k + 3] = 0
        x += 40
    for blurred in (False, True):
        frames = layout.rhythmic_frames(img, blurred)
        assert any(b[1] <= 105 and b[3] >= 115 for b in frames)
    assert layout.rhythmic_frames(np.full((60, 80), 255, np.uint8)) == [(0, 0, 80, 60)]


def test_joining_is_a_fixpoint():
    rng = np.random.default_rng(2)
    for _ in range(20):
        boxes = [(x, y, x + w, y + h) for x, y, w, h in rng.integers(1, 40, (10, 4)).tolist()]
        once = layout.joined_overlaps(boxes)
        assert sorted(layout.joined_overlaps(once)) == sorted(once) and len(once) <= len(boxes)
        assert min(b[0] for b in once) == min(b[0] for b in boxes)
    assert layout.joined_neighbours([(0, 0, 5, 5), (7, 0, 9, 5), (40, 40, 50, 50)], 3) == [(0, 0, 9, 5), (40, 40, 50, 50)]


def test_lines_by_baseline_and_shapes():
    page = white(160, 300, *[(y, y + 20, x, x + 12) for y in (20, 90) for x in range(20, 260, 18)])
    assert len(layout.baseline_lines(page, 20)) == 2
    speck = page.copy()
    speck[150, 150] = 0
    assert (layout.usual_shapes(speck) == page).all() and (layout.usual_shapes(np.full((5, 5), 255, np.uint8)) == 255).all()


def test_equalising_and_joining_glyphs():
    rng = np.random.default_rng(1)
    img = rng.integers(100, 140, (64, 80)).astype(np.uint8)
    out = layout.equalised(img)
    assert out.shape == img.shape and out.std() > img.std()
    assert layout.enhanced(np.where(im.thin(np.ones((40, 40), bool)), 255, 0).astype(np.uint8)).shape == (40, 40)
    assert layout.beside(np.zeros((10, 4), np.uint8), np.zeros((20, 6), np.uint8)).shape == (20, 10)
