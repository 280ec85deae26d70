"""Image kernels in numpy, for one region of interest at a time.

They run inside Arrow maps, one row a region. Arrays are uint8 [h, w] or
[h, w, 3]; masks are bool. Grey values are the rounded luma.
"""

from __future__ import annotations

import math

import numpy as np

LEAST_BACKGROUND = 16
LEAST_CONTRAST = 20.0


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.floor(rgb @ np.array([0.299, 0.587, 0.114]) + 0.5).astype(np.uint8)


def shift(mask: np.ndarray, dy: int, dx: int, fill: bool = False) -> np.ndarray:
    """The mask moved by (dy, dx); what comes in from outside is ``fill``."""
    h, w = mask.shape
    out = np.full_like(mask, fill)
    ys, yd = (slice(0, h - dy), slice(dy, h)) if dy >= 0 else (slice(-dy, h), slice(0, h + dy))
    xs, xd = (slice(0, w - dx), slice(dx, w)) if dx >= 0 else (slice(-dx, w), slice(0, w + dx))
    if abs(dy) < h and abs(dx) < w:
        out[yd, xd] = mask[ys, xs]
    return out


def cross(size: int) -> list[tuple[int, int]]:
    r = size // 2
    return [(d, 0) for d in range(-r, r + 1)] + [(0, d) for d in range(-r, r + 1) if d]


def ellipse(size: int) -> list[tuple[int, int]]:
    """Offsets of an elliptic structuring element: per row the half width of the circle, rounded."""
    r = size // 2
    out = []
    for dy in range(-r, r + 1):
        dx = round(r * math.sqrt(max(0.0, (r * r - dy * dy) / (r * r)))) if r else 0
        out += [(dy, d) for d in range(-dx, dx + 1)]
    return out


def erode(mask: np.ndarray, element: list[tuple[int, int]], times: int = 1) -> np.ndarray:
    """Pixels all of whose neighbours are set; the outside counts as set."""
    for _ in range(times):
        mask = np.logical_and.reduce([shift(mask, -dy, -dx, True) for dy, dx in element])
    return mask


def dilate(mask: np.ndarray, element: list[tuple[int, int]], times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = np.logical_or.reduce([shift(mask, dy, dx) for dy, dx in element])
    return mask


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """8-connected components as (l, t, r, b, area), by their first pixel; runs are united line by line."""
    up: list[int] = []
    box: list[list[int]] = []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    before: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            k = len(up)
            up.append(k)
            box.append([a, y, b, y + 1, b - a])
            for c, d, j in before:
                if c <= b and a <= d:
                    p, q = find(j), find(k)
                    if p != q:
                        p, q = min(p, q), max(p, q)
                        up[q] = p
                        m, n = box[p], box[q]
                        box[p] = [min(m[0], n[0]), min(m[1], n[1]), max(m[2], n[2]), max(m[3], n[3]), m[4] + n[4]]
            here.append((a, b, k))
        before = here
    return [tuple(box[i]) for i in range(len(up)) if find(i) == i]


def distance(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance of each set pixel to the nearest unset one (0.955 straight, 1.3693 diagonal)."""
    a, b = 0.955, 1.3693
    h, w = mask.shape
    d = np.where(mask, 1e6, 0.0)
    for y in range(h):
        if y:
            up = d[y - 1]
            left, right = np.concatenate([[1e6], up[:-1]]) + b, np.concatenate([up[1:], [1e6]]) + b
            d[y] = np.minimum(d[y], np.minimum(up + a, np.minimum(left, right)))
        for x in range(1, w):
            d[y, x] = min(d[y, x], d[y, x - 1] + a)
    for y in range(h - 1, -1, -1):
        if y < h - 1:
            dn = d[y + 1]
            left, right = np.concatenate([[1e6], dn[:-1]]) + b, np.concatenate([dn[1:], [1e6]]) + b
            d[y] = np.minimum(d[y], np.minimum(dn + a, np.minimum(left, right)))
        for x in range(w - 2, -1, -1):
            d[y, x] = min(d[y, x], d[y, x + 1] + a)
    return d


def otsu(values: np.ndarray) -> int:
    """Threshold with the largest variance between the two classes."""
    n = np.bincount(values.ravel(), minlength=256).astype(float)
    w = np.cumsum(n)
    m = np.cumsum(n * np.arange(256))
    total, mean = w[-1], m[-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mean * w - m * total) ** 2 / (w * (total - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def largest_rectangle(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """(x, y, w, h) of the largest rectangle of set pixels; the first found on ties, lines from the top.

    Per line the histogram of set pixels above is searched by nearest lower
    neighbours on either side. Of equal lines one below another only the last
    is searched, since every rectangle grows down to it; equal columns beside
    each other are one bar.
    """
    if mask.ndim != 2 or not mask.any():
        return None
    best, heights, above = (0, None), np.zeros(mask.shape[1], np.int64), -1
    for y in [*np.flatnonzero((mask[1:] != mask[:-1]).any(axis=1)).tolist(), len(mask) - 1]:
        heights = np.where(mask[y], heights + (y - above), 0)
        above = y
        if heights.max() * mask.shape[1] <= best[0]:
            continue
        at = [0, *(np.flatnonzero(heights[1:] != heights[:-1]) + 1).tolist()]
        starts: list[tuple[int, int]] = []  # (first column, height) of open bars, rising
        for x, h in zip([*at, mask.shape[1]], [*heights[at].tolist(), 0], strict=True):
            a = x
            while starts and starts[-1][1] >= h:
                a, tall = starts.pop()
                if tall * (x - a) > best[0]:
                    best = (tall * (x - a), (a, y - tall + 1, x - a, tall))
            starts.append((a, h))
    return best[1]


# --- colours ---------------------------------------------------------------------------------------


def flat_background(rgb: np.ndarray, text: np.ndarray, region: np.ndarray | None = None) -> tuple[int, int, int] | None:
    """Median colour of the pixels beside the text if they are plain white or of one tone, else None."""
    bg = ~text if region is None else region & ~text
    px = rgb[bg]
    if len(px) < LEAST_BACKGROUND:
        return None
    g = grey(px[:, None, :])
    white = g.mean() >= 235 and g.std() <= 10.0
    return tuple(int(c) for c in np.median(px, axis=0)) if white or g.std() <= 3.5 else None


def background_samples(rgb: np.ndarray, allowed: np.ndarray, box: tuple[int, int, int, int], corner: int = 12) -> np.ndarray:
    """Background pixels: those in the corners, else those outside the text box, else all allowed."""
    h, w = allowed.shape
    c = max(4, min(corner, h // 4, w // 4))
    y, x = np.ogrid[:h, :w]
    corners = ((y < c) | (y >= h - c)) & ((x < c) | (x >= w - c))
    l, t, r, b = box  # noqa: E741
    outside = ~((y >= t) & (y < b) & (x >= l) & (x < r))
    for m in (allowed & corners, allowed & outside):
        if m.sum() >= LEAST_BACKGROUND:
            return rgb[m]
    return rgb[allowed] if allowed.any() else rgb.reshape(-1, 3)


def background_color(rgb: np.ndarray, allowed: np.ndarray, samples: np.ndarray, white: int = 235, share: float = 0.5) -> np.ndarray:
    """Median of the white pixels where they are the greater part, of the samples otherwise."""
    s = samples if len(samples) else rgb[allowed] if allowed.any() else rgb.reshape(-1, 3)
    for px, n in ((rgb[allowed & (grey(rgb) >= white)], max(1, int(allowed.sum()))), (s[grey(s[:, None, :])[:, 0] >= white], len(s))):
        if len(px) >= LEAST_BACKGROUND and len(px) / n >= share:
            return np.median(px, axis=0)
    return np.median(s, axis=0)


def snap(ink: np.ndarray, limit: float, neutral: tuple[int, int, int]) -> tuple[int, int, int]:
    """Ink of nearly one grey becomes the neutral colour."""
    if ink.max() - ink.min() < limit:
        return neutral
    return tuple(int(c) for c in np.clip(np.rint(ink), 0, 255))


def ink_color(rgb: np.ndarray, box: tuple[int, int, int, int], margin: int = 6) -> tuple[int, int, int]:
    """Colour of the text in a box of a page, by the polarity of the box and of the ring around it."""
    h, w = rgb.shape[:2]
    l, t, r, b = max(0, box[0]), max(0, box[1]), min(w, box[2]), min(h, box[3])  # noqa: E741
    if r <= l or b <= t:
        return 0, 0, 0
    patch = rgb[t:b, l:r]
    g = grey(patch)
    bright = float(np.percentile(g, 80))
    L, T, R, B = max(0, l - margin), max(0, t - margin), min(w, r + margin), min(h, b + margin)
    ring = np.ones((B - T, R - L), bool)
    ring[t - T : b - T, l - L : r - L] = False
    around = rgb[T:B, L:R][ring]
    ground = float(np.median(around @ np.array([0.299, 0.587, 0.114]))) if len(around) else bright
    light = bright >= 140 or ground >= 130
    px = patch[g <= 130] if light else patch[g >= 150]
    plain = (0, 0, 0) if light else (255, 255, 255)
    return snap(np.median(px, axis=0), 30, plain) if len(px) >= 4 else plain


def strong_ink(rgb: np.ndarray, allowed: np.ndarray, ground: np.ndarray, dark: int = 128, bright: int = 200) -> tuple[int, int, int]:
    """Ink by its distance from the background colour: the median of the strongest three tenths; by polarity where nothing stands out."""
    luma = float(ground @ np.array([0.299, 0.587, 0.114]))
    plain = (255, 255, 255) if luma < dark else (0, 0, 0)
    if not allowed.any():
        return plain
    far = np.linalg.norm(rgb.astype(float) - ground, axis=2)
    m = allowed & (far >= LEAST_CONTRAST)
    if m.sum() >= 4:
        top = m & (far >= np.percentile(far[m], 70))
        ink = np.median(rgb[top if top.sum() >= 4 else m], axis=0)
        y = float(ink @ np.array([0.299, 0.587, 0.114]))
        return snap(ink, 25, plain) if (y > luma) == (luma < dark) and y != luma else tuple(int(c) for c in np.clip(np.rint(ink), 0, 255))
    g = grey(rgb)
    m = allowed & ((g >= bright) if luma < dark else (g <= dark))
    return tuple(int(c) for c in np.median(rgb[m], axis=0)) if m.sum() >= 4 else plain


# --- masks -----------------------------------------------------------------------------------------


def has_text(g: np.ndarray, mask: np.ndarray | None = None, least: int = 14) -> bool:
    """Whether a grey region holds strokes: enough ink, and one component that is large enough."""
    h, w = g.shape
    if h < 6 or w < 6:
        return False
    if mask is None:
        inner = np.zeros((h, w), bool)
        py, px = min(4, h // 4), min(4, w // 4)
        inner[py : h - py, px : w - px] = True
    else:
        inner = erode(mask, ellipse(9))
        inner = inner if inner.any() else mask
    px = g[inner]
    if px.size < 16:
        return False
    hi = float(np.percentile(px, 80))
    ink = inner & (g <= min(180, hi - 32) if hi >= 128 else g >= max(100, float(np.percentile(px, 20)) + 32))
    return int(ink.sum()) >= least and any(a >= least and (r - l >= 4 or b - t >= 4) for l, t, r, b, a in components(ink))


def plain_white(g: np.ndarray, mask: np.ndarray, dark: int = 128, white: int = 235, share: float = 0.9, dev: float = 5.0) -> bool:
    """Whether a closed shape is clean white beside its text."""
    if not mask.any() or not closed_shape(mask):
        return False
    bg = g[mask & (g >= dark)]
    return len(bg) >= LEAST_BACKGROUND and (bg >= white).mean() >= max(0.90, share) and float(bg.astype(float).std()) < min(10.0, dev)


def closed_shape(mask: np.ndarray) -> bool:
    """Whether a mask looks like a shape within its frame, not like the frame itself."""
    h, w = mask.shape
    if not mask.any() or mask.mean() > 0.92:
        return False
    e = min(6, max(1, min(h, w) // 24))
    if sum(float(x.mean()) > 0.35 for x in (mask[:e], mask[-e:], mask[:, :e], mask[:, -e:])) >= 3:
        return False
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return not (xs[-1] + 1 - xs[0] >= 0.96 * w and ys[-1] + 1 - ys[0] >= 0.96 * h)


def thinned_mask(mask: np.ndarray, frame: tuple[int, int], box: tuple[int, int, int, int], size: int = 3, times: int = 1, keep: int = 4) -> np.ndarray:
    """The mask (its top left at ``frame``) eroded outside the text box and a margin; unchanged if nothing would be left."""
    if not mask.any() or size <= 1 or times <= 0:
        return mask
    thin = erode(mask, cross(size), times)
    thin = thin.copy() if thin.any() else mask.copy()
    h, w = mask.shape
    l, t, r, b = box[0] - keep - frame[0], box[1] - keep - frame[1], box[2] + keep - frame[0], box[3] + keep - frame[1]  # noqa: E741
    l, t, r, b = max(0, l), max(0, t), min(w, r), min(h, b)  # noqa: E741
    if r > l and b > t:
        thin[t:b, l:r] = mask[t:b, l:r]
    return thin


def glyph_dilation(glyphs: np.ndarray, page: tuple[int, int], base: int = 1) -> int | None:
    """Pixels to widen a glyph mask by, from its glyph sizes and stroke widths; None if it has no glyph."""
    sizes = [max(r - l, b - t) for l, t, r, b, a in components(glyphs) if a >= 8 and (r - l >= 4 or b - t >= 4)]
    if not sizes:
        return None
    size = float(np.median([s for s in sizes if s >= 0.40 * max(sizes)]))
    d = distance(glyphs)
    d = d[(d >= 0.8) & (d < 500)]
    radius = float(np.median(d)) if d.size else 1.5
    scale = max(0.6, min(2.5, max(page) / 1600.0))
    return int(max(2, min(24, round((0.08 * size + 0.6 * radius) * scale) + max(0, base - 1))))


def fill_holes(mask: np.ndarray) -> np.ndarray:
    """Holes that no path of unset pixels joins to the border are set."""
    out = ~mask
    seen = np.zeros_like(mask)
    seen[0], seen[-1], seen[:, 0], seen[:, -1] = out[0], out[-1], out[:, 0], out[:, -1]
    step = cross(3)
    while True:
        grown = dilate(seen, step) & out
        if (grown == seen).all():
            return mask | ~seen
        seen = grown


def diffuse(rgb: np.ndarray, hole: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Fill a hole from its rim inwards by averages of known neighbours, then smooth it."""
    img = rgb.astype(float).copy()
    known = ~hole
    if not known.any():
        return rgb
    near = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    while not known.all():
        n = sum(shift(known, dy, dx).astype(float) for dy, dx in near)
        s = sum(np.where(shift(known, dy, dx)[..., None], np.roll(img, (dy, dx), (0, 1)), 0.0) for dy, dx in near)
        new = ~known & (n > 0)
        img[new] = s[new] / n[new][:, None]
        known = known | new
    pad = lambda a: np.pad(a, ((1, 1), (1, 1), (0, 0)), mode="edge")
    for _ in range(rounds if hole.any() else 0):
        p = pad(img)
        mean = (p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]) / 4
        if np.abs(mean[hole] - img[hole]).max() < 0.25:
            break
        img[hole] = mean[hole]
    return np.clip(np.rint(img), 0, 255).astype(np.uint8)


def crop(rgb: np.ndarray, box: tuple[int, int, int, int], mask: np.ndarray | None = None) -> np.ndarray:
    """The box of an image; white outside the mask if that has the crop's shape."""
    out = rgb[box[1] : box[3], box[0] : box[2]]
    return np.where(mask[..., None], out, 255).astype(np.uint8) if mask is not None and mask.shape == out.shape[:2] else out


def inner_bubble(g: np.ndarray, center: tuple[int, int], white: int = 235, close: int = 13) -> np.ndarray | None:
    """Mask of the smallest closed white component that covers the centre."""
    m = erode(dilate(g >= white, ellipse(close)), ellipse(close))
    best = None
    for l, t, r, b, _a in components(m):
        if l <= center[0] < r and t <= center[1] < b:
            part = _component_at(m, center)
            if part is not None and (best is None or part.sum() < best.sum()):
                best = part
    return best


def _component_at(mask: np.ndarray, point: tuple[int, int]) -> np.ndarray | None:
    x, y = point
    if not mask[y, x]:
        return None
    seen = np.zeros_like(mask)
    seen[y, x] = True
    ring = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    while True:
        grown = dilate(seen, ring) & mask
        if (grown == seen).all():
            return seen
        seen = grown


def glyph_mask(g: np.ndarray, allowed: np.ndarray, box: tuple[int, int, int, int], ground: float, dev: float, dark: int = 128) -> np.ndarray:
    """Pixels that differ from the ground by max(20, 3 deviations) in the direction of the ink, in components that touch the text box."""
    limit = max(20.0, 3.0 * dev)
    m = allowed & ((g.astype(float) - ground >= limit) if ground < dark else (ground - g.astype(float) >= limit))
    out = np.zeros_like(m)
    l, t, r, b = box  # noqa: E741
    for cl, ct, cr, cb, _a in components(m):
        if cl < r and l < cr and ct < b and t < cb:
            sub = m[ct:cb, cl:cr]
            out[ct:cb, cl:cr] |= sub
    return out


def erase(rgb: np.ndarray, allowed: np.ndarray, box: tuple[int, int, int, int], uniform: float = 2.0) -> np.ndarray:
    """Erase the text of a region: a solid fill on an even ground, diffusion otherwise."""
    samples = background_samples(rgb, allowed, box)
    ground = background_color(rgb, allowed, samples)
    g = grey(rgb)
    dev = float(samples.astype(float).std(axis=0).max()) if len(samples) else 0.0
    m = glyph_mask(g, allowed, box, float(ground @ np.array([0.299, 0.587, 0.114])), dev)
    if not m.any():
        return rgb
    px = glyph_dilation(m, (rgb.shape[1], rgb.shape[0])) or 2
    m = dilate(m, cross(3), px) & allowed
    if dev < uniform:
        out = rgb.copy()
        out[m] = np.rint(ground)
        return out
    return diffuse(rgb, m)


def lobes(mask: np.ndarray, neck: float = 0.72, near: float = 0.70) -> list[tuple[int, int, float]]:
    """Centres (x, y, radius) of the chambers of a mask: peaks of the distance map, by radius; a peak goes if it is near a kept one or no neck lies between."""
    d = distance(mask)
    if d.max() <= 0:
        return []
    peak = (d > 0) & (d >= np.maximum.reduce([np.pad(d, 1)[1 + dy : 1 + dy + d.shape[0], 1 + dx : 1 + dx + d.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    pts = sorted(((-float(d[y, x]), int(y), int(x)) for y, x in zip(*np.nonzero(peak), strict=True)))
    kept: list[tuple[int, int, float]] = []
    for nr, y, x in pts:
        r = -nr
        if kept and r < 0.3 * kept[0][2]:
            break
        ok = True
        for kx, ky, kr in kept:
            lim = min(r, kr)
            dist = math.hypot(x - kx, y - ky)
            n = max(2, int(dist))
            path = min(float(d[round(y + (ky - y) * i / n), round(x + (kx - x) * i / n)]) for i in range(n + 1))
            if dist < near * lim or path >= neck * lim:
                ok = False
                break
        if ok:
            kept.append((x, y, r))
    return kept


def split_by_ink(g: np.ndarray, gap_factor: float = 1.5) -> list[tuple[int, int, int, int]]:
    """Boxes of the parts of a region whose ink lies far apart: Otsu ink, components, clusters by gaps, joined over small distances."""
    if min(g.shape) < 6:
        return [(0, 0, g.shape[1], g.shape[0])]
    k = otsu(g)
    ink = g <= k if (g <= k).mean() <= 0.5 else g > k
    comp = [c for c in components(ink) if c[4] >= 6]
    if not comp:
        return [(0, 0, g.shape[1], g.shape[0])]
    big = [(r - l, b - t) for l, t, r, b, _a in comp if r - l >= 6 and b - t >= 6]
    mw = float(np.median([x for x, _ in big])) if big else 30.0
    mh = float(np.median([y for _, y in big])) if big else 30.0
    gx, gy = max(20.0, gap_factor * mw), max(20.0, gap_factor * mh)
    from inkgrid.operators.spatial import Sets, sweep

    s = Sets(len(comp))
    for i, j in sweep([c[1] for c in comp], [c[3] for c in comp], math.floor(gy)):
        a, b = comp[i], comp[j]
        if max(a[0], b[0]) - min(a[2], b[2]) <= gx and max(a[1], b[1]) - min(a[3], b[3]) <= gy:
            s.join(i, j)
    out = [(min(comp[i][0] for i in q), min(comp[i][1] for i in q), max(comp[i][2] for i in q), max(comp[i][3] for i in q)) for q in s.groups()]
    band = max(25.0, 1.5 * mh)
    return sorted(out, key=lambda c: (round((c[1] + c[3]) / 2 / band), -(c[0] + c[2]) / 2))


def paste_back(page: np.ndarray, original: np.ndarray, box: tuple[int, int, int, int], touched: bool, mask: np.ndarray | None = None) -> np.ndarray:
    """Restore a skipped region from the original: the whole box, or only its ink where a translated region overlaps it."""
    l, t, r, b = box  # noqa: E741
    out = page.copy()
    src = original[t:b, l:r]
    if not touched:
        out[t:b, l:r] = src
        return out
    if mask is None:
        g = grey(src)
        hi, lo = float(np.percentile(g, 75)), float(np.percentile(g, 25))
        mask = g <= hi - 25 if hi >= 128 else g >= lo + 25
    sub = out[t:b, l:r]
    sub[mask] = src[mask]
    return out


def draw_boxes(rgb: np.ndarray, masks: list[tuple[np.ndarray, tuple[int, int], tuple[int, int, int], int]], boxes: list[tuple[tuple[int, int, int, int], tuple[int, int, int]]]) -> np.ndarray:
    """Debug view: masks (with their top left, colour and alpha) blended in, then boxes with a line of two pixels."""
    out = rgb.astype(float).copy()
    for m, (x, y), color, alpha in masks:
        h, w = m.shape
        part = out[y : y + h, x : x + w]
        mm = m[: part.shape[0], : part.shape[1]]
        part[mm] = part[mm] * (1 - alpha / 255) + np.array(color) * alpha / 255
    for (l, t, r, b), color in boxes:
        for k in range(2):
            out[t + k, l:r] = out[b - 1 - k, l:r] = color
            out[t:b, l + k] = out[t:b, r - 1 - k] = color
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
