import numpy as np
import pytest

from inkgrid.operators import kernels as K


def page(h, w, *ink):
    g = np.full((h, w), 255, np.uint8)
    for l, t, r, b in ink:  # noqa: E741
        g[t : b + 1, l : r + 1] = 0
    return g


@pytest.mark.parametrize(
    "size,ink,parts",
    [
        ((200, 200), [(10, 10, 24, 24), (140, 140, 154, 154)], 2),
        ((200, 200), [(10, 10, 24, 24), (40, 10, 54, 24)], 1),
        ((200, 200), [(10, 10, 24, 24), (120, 10, 134, 24)], 2),
        ((300, 200), [(x, y, x + 14, y + 14) for x in (10, 28) for y in (10, 100, 200)], 3),
        ((300, 300), [(200, 10, 280, 50), (10, 150, 90, 190)], 2),
    ],
)
def test_split(size, ink, parts):
    assert len(K.split_by_ink(page(*size, *ink))) == parts


def test_rectangle():
    m = np.zeros((200, 200), bool)
    m[40:160, 50:150] = True
    assert K.largest_rectangle(m) == (50, 40, 100, 120)
    assert K.largest_rectangle(np.zeros((5, 5), bool)) is None


def test_rectangle_against_brute_force():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        m = rnd.random((7, 8)) < 0.7
        best = max((w * h for y in range(7) for x in range(8) for h in range(1, 8 - y) for w in range(1, 9 - x) if m[y : y + h, x : x + w].all()), default=0)
        got = K.largest_rectangle(m)
        assert (got[2] * got[3] if got else 0) == best and (not got or m[got[1] : got[1] + got[3], got[0] : got[0] + got[2]].all())


def test_components_against_flood_fill():
    rnd = np.random.default_rng(5)
    for _ in range(20):
        m = rnd.random((12, 15)) < 0.4
        left, want = m.copy(), []
        while left.any():
            todo, cells = [tuple(np.argwhere(left)[0])], []
            left[todo[0]] = False
            while todo:
                y, x = todo.pop()
                cells.append((y, x))
                for b in range(max(0, y - 1), min(12, y + 2)):
                    for a in range(max(0, x - 1), min(15, x + 2)):
                        if left[b, a]:
                            left[b, a] = False
                            todo.append((b, a))
            ys, xs = zip(*cells, strict=True)
            want.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(cells)))
        assert sorted(K.components(m)) == sorted(want)


def disc(n, r):
    y, x = np.ogrid[:n, :n]
    return (y - n // 2) ** 2 + (x - n // 2) ** 2 <= r * r


def test_has_text():
    g = np.full((120, 120), 200, np.uint8)
    d = disc(120, 40)
    g[d] = 255
    g[d & ~disc(120, 38)] = 0
    assert not K.has_text(g, d)
    g[50:60, 50:54] = 0
    assert K.has_text(g, d)
    assert not K.has_text(g[:5, :5])


def test_plain_white():
    assert not K.plain_white(np.full((40, 40), 255, np.uint8), np.ones((40, 40), bool))
    g = np.full((60, 60), 250, np.uint8)
    g[28:32, 20:40] = 10
    assert K.plain_white(g, disc(60, 20))


def test_fill_on_an_even_ground():
    rgb = np.full((60, 60, 3), (210, 200, 190), np.uint8)
    rgb[25:35, 25:35] = 20
    out = K.erase(rgb, np.ones((60, 60), bool), (25, 25, 35, 35))
    assert np.abs(out.astype(int) - (210, 200, 190)).max() <= 2


def test_erosion_keeps_the_text_box_and_does_not_empty():
    m = np.zeros((40, 40), bool)
    m[5:35, 5:35] = True
    out = K.thinned_mask(m, (0, 0), (18, 18, 22, 22))
    assert out[14:26, 14:26].all() and not out[5, 5:35].any()
    thin = np.zeros((9, 9), bool)
    thin[4] = True
    assert (K.thinned_mask(thin, (0, 0), (0, 0, 1, 1)) == thin).all()


def test_flat_background_and_ink():
    rgb = np.full((20, 20, 3), 255, np.uint8)
    text = np.zeros((20, 20), bool)
    text[8:12, 8:12] = True
    rgb[text] = 0
    assert K.flat_background(rgb, text) == (255, 255, 255)
    assert K.ink_color(rgb, (6, 6, 14, 14)) == (0, 0, 0)
    rgb[::2] = 90
    assert K.flat_background(rgb, text) is None


def test_lobes():
    m = np.zeros((60, 120), bool)
    m[:, :60] |= disc(60, 25)
    m[:, 60:] |= disc(60, 25)
    m[27:33, 50:70] = True
    assert len(K.lobes(m)) == 2 and len(K.lobes(disc(60, 25))) == 1


def test_restore_and_holes():
    a, b = np.zeros((20, 20, 3), np.uint8), np.full((20, 20, 3), 200, np.uint8)
    assert (K.paste_back(a, b, (2, 2, 8, 8), False)[2:8, 2:8] == 200).all()
    ring = disc(31, 12) & ~disc(31, 9)
    assert (K.fill_holes(ring) == disc(31, 12)).all()
    assert K.diffuse(b, disc(20, 5))[10, 10].tolist() == [200, 200, 200]
