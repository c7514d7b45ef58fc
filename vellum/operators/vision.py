"""Finding pages in pictures and flattening them, in numpy.

Masks are boolean, pictures grey (height by width) or red, green, blue; points are (x, y).
"""

from __future__ import annotations

import numpy as np

from vellum.operators.images import gaussian, half_up, luminance

# fixed values: the linear transform of the CIE color space, and its white
TO_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
WHITE = np.array([0.950456, 1.0, 1.088754])
STRIP = 192


def lab(image: np.ndarray) -> np.ndarray:
    """Lightness and two color axes, each scaled to 0 to 255, grey at 128."""
    rgb = image.astype(float) / 255
    linear = np.where(rgb > 0.04045, ((rgb + 0.055) / 1.055) ** 2.4, rgb / 12.92)
    xyz = linear @ TO_XYZ.T / WHITE
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    return np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=-1)


def plain_paper(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole lightness, and what is hardly colored; greys that are whole numbers are looked up among the 256."""
    if image.ndim == 2 and image.dtype == np.uint8:
        return tuple(of.take(image) for of in plain_paper(np.arange(256)))
    colors = lab(image if image.ndim == 3 else np.repeat(image[..., None], 3, axis=-1))
    return np.round(colors[..., 0]), (colors[..., 1] >= 72) & (colors[..., 1] <= 194) & (colors[..., 2] >= 68) & (colors[..., 2] <= 207)


def otsu(grey: np.ndarray) -> int:
    """The level that parts the histogram into the two classes furthest apart."""
    h = np.bincount(np.clip(grey, 0, 255).astype(np.uint8).ravel(), minlength=256).astype(float)
    below, mass = np.cumsum(h), np.cumsum(h * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where((below > 0) & (above > 0), between, -1)))


def adaptive(grey: np.ndarray, size: int, offset: float) -> np.ndarray:
    """Brighter than the blurred neighbourhood less an offset."""
    size = min(size, min(grey.shape) // 2 * 2 - 1)
    return grey > gaussian(grey.astype(float), size) - offset


def spread(mask: np.ndarray, width: int, height: int, of=np.logical_or) -> np.ndarray:
    """Dilation by a rectangle of odd sides, by doubling shifts; with logical_and, erosion."""
    fill = of is np.logical_and
    for axis, size in ((1, width), (0, height)):
        radius = size // 2
        padded = np.pad(mask, [(radius, radius) if a == axis else (0, 0) for a in (0, 1)], constant_values=fill)
        have, out = 1, padded
        while have < size:
            step = min(have, size - have)
            out = of(out[:-step], out[step:]) if axis == 0 else of(out[:, :-step], out[:, step:])
            have += step
        mask = out
    return mask


def closed(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    return spread(spread(mask, width, height), width, height, np.logical_and)


def opened(mask: np.ndarray, width: int, height: int) -> np.ndarray:
    return spread(spread(mask, width, height, np.logical_and), width, height)


def paper_mask(image: np.ndarray) -> np.ndarray:
    """Brighter than the level that parts the picture, and hardly colored; small gaps closed, specks removed."""
    light, plain = plain_paper(image)
    shortest = max(3, min(image.shape[:2]))
    bright = light > otsu(light)
    size = min(max(half_up(shortest * 0.025), 9), 31) | 1
    return opened(closed(bright & plain, size, size), 5, 5)


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Labels from 1 on of connected areas (sides touching), by runs of each row and union-find."""
    parent = [0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    height, width = mask.shape
    framed = np.zeros((height, width + 2), np.int8)
    framed[:, 1:-1] = mask
    ys, xs = np.divmod(np.flatnonzero(np.diff(framed, axis=1)), width + 1)
    before: list[tuple[int, int, int]] = []
    now: list[tuple[int, int, int]] = []
    names: list[int] = []
    row = k = 0
    for y, start, end in zip(ys[::2].tolist(), xs[::2].tolist(), xs[1::2].tolist(), strict=True):
        if y != row:
            before, now, row, k = now if y == row + 1 else [], [], y, 0
        label = 0
        while k < len(before) and before[k][1] <= start:
            k += 1
        at = k
        while at < len(before) and before[at][0] < end:
            other = root(before[at][2])
            if label and other != label:
                parent[max(label, other)] = min(label, other)
                label = min(label, other)
            else:
                label = other
            at += 1
        if not label:
            label = len(parent)
            parent.append(label)
        now.append((start, end, label))
        names.append(label)
    labels = np.zeros(mask.shape, np.int64)
    if not names:
        return labels, 0
    kept, places = np.unique([root(i) for i in names], return_inverse=True)
    labels[mask] = np.repeat(places.ravel() + 1, xs[1::2] - xs[::2])
    return labels, len(kept)


def main_component(mask: np.ndarray, least: float = 0.02, most: float = 0.995) -> np.ndarray | None:
    """The best component of plausible size: large, over the middle, not drawn out; None if there is none."""
    labels, n = components(mask)
    height, width = mask.shape
    shares = np.bincount(labels.ravel(), minlength=n + 1) / mask.size
    best = None
    for k in range(1, n + 1):
        share = shares[k]
        if not least <= share <= most:
            continue
        w, h = (np.ptp(np.flatnonzero((labels == k).any(axis=a))) + 1 for a in (0, 1))
        aspect = max(w / h, h / w)
        if aspect <= 8:
            middle = labels[height * 3 // 8 : height * 5 // 8, width * 3 // 8 : width * 5 // 8] == k
            score = (share * 0.70 + middle.mean() * 0.20 + min(1.0, max(0.0, 1 - (aspect - 1) / 7)) * 0.10, share)
            if best is None or score > best[0]:
                best = (score, k)
    return None if best is None else labels == best[1]


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Clockwise on a screen, from the leftmost point."""
    found = np.unique(points, axis=0)
    if len(found) < 3:
        return found
    ordered = found.tolist()

    def half(ps):
        out: list[list] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(ordered) + half(ordered[::-1]))


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed outline without the points nearer than ``tolerance`` to the chords that are left."""

    def keep(part: np.ndarray) -> list[np.ndarray]:
        a, d = part[0], part[-1] - part[0]
        away = np.abs(d[0] * (part[:, 1] - a[1]) - d[1] * (part[:, 0] - a[0])) / np.hypot(*d) if np.hypot(*d) else np.hypot(*(part - a).T)
        k = int(np.argmax(away))
        return [part[0]] if len(part) < 3 or away[k] <= tolerance else keep(part[: k + 1]) + keep(part[k:])

    if len(points) < 4:
        return points
    far = int(np.argmax(((points - points[0]) ** 2).sum(axis=1)))
    return np.array(keep(points[: far + 1]) + keep(np.concatenate((points[far:], points[:1]))))


def smallest_rectangle(points: np.ndarray) -> np.ndarray:
    """The rectangle of least area around points: one of its sides lies along an edge of their hull."""
    hull = convex_hull(points).astype(float)
    best = None
    for e in np.roll(hull, -1, axis=0) - hull:
        u = e / np.hypot(*e)
        basis = np.stack([u, [-u[1], u[0]]])
        low, high = (hull @ basis.T).min(axis=0), (hull @ basis.T).max(axis=0)
        area = float(np.prod(high - low))
        if best is None or area < best[0]:
            best = (area, np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]]) @ basis)
    return best[1]


def representative_corners(points: np.ndarray) -> np.ndarray:
    """The extremes of x + y and x - y, clockwise from the top left; the smallest rectangle's if two coincide."""
    s, d = points[:, 0] + points[:, 1], points[:, 0] - points[:, 1]
    chosen = points[[int(np.argmin(s)), int(np.argmax(d)), int(np.argmax(s)), int(np.argmin(d))]].astype(float)
    return chosen if len(np.unique(np.round(chosen), axis=0)) == 4 else smallest_rectangle(points)


def detect_document(image: np.ndarray) -> dict | None:
    """Corners, outline and share of the page in a picture, or None."""
    page = main_component(paper_mask(image))
    if page is None:
        return None
    rows = np.flatnonzero(page.any(axis=1))
    left, right = page[rows].argmax(axis=1), page.shape[1] - 1 - page[rows, ::-1].argmax(axis=1)
    hull = convex_hull(np.concatenate((np.stack([left, rows], 1), np.stack([right, rows], 1))))
    outline = simplified(hull, 0.02 * float(np.hypot(*np.ptp(hull, axis=0))))
    return {"corners": representative_corners(hull), "outline": outline, "share": float(page.mean())}


def canny(grey: np.ndarray, low: float = 60, high: float = 180) -> np.ndarray:
    """Thin edges: strong ones, and weaker ones that touch them."""
    p = np.pad(gaussian(grey.astype(float), 5), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    size = np.abs(gx) + np.abs(gy)
    places, high = np.flatnonzero(size > low), max(low, high)
    way = np.round(np.degrees(np.arctan2(gy.ravel()[places], gx.ravel()[places])) / 45).astype(int) % 4
    width = size.shape[1] + 2
    q = np.pad(size, 1).ravel()
    places += width + 1 + places // size.shape[1] * 2
    step = np.array([1, width + 1, width, width - 1])[way]
    places = places[(q[places] >= q[places + step]) & (q[places] > q[places - step])]
    weak, strong = np.zeros(q.shape, bool), np.zeros(q.shape, bool)
    weak[places] = True
    grown = places[q[places] > high]
    around = np.array([dy * width + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    while len(grown):
        strong[grown], weak[grown] = True, False
        near = (grown[:, None] + around).ravel()
        grown = np.unique(near[weak[near]])
    return strong.reshape(-1, width)[1:-1, 1:-1]


def hough_lines(edges: np.ndarray, votes: int = 45, most: int = 80) -> list[tuple[float, float, int]]:
    """(angle in degrees, distance, votes) of straight lines, the strongest first; lines near a stronger one go."""
    ys, xs = (v.astype(float) for v in np.nonzero(edges))
    size = int(np.ceil(np.hypot(*edges.shape)))
    row = 2 * size + 1
    counts = np.empty((180, row), np.int64)
    away, more, places = np.empty(len(xs)), np.empty(len(xs)), np.empty(len(xs), np.int64)
    for a, t in enumerate(np.radians(np.arange(180)).tolist()):
        np.add(np.multiply(xs, np.cos(t), out=away), np.multiply(ys, np.sin(t), out=more), out=away)
        np.copyto(places, np.add(np.rint(away, out=away), size, out=away), casting="unsafe")
        counts[a] = np.bincount(places, minlength=row)
    votes_of = counts.ravel()
    enough = np.flatnonzero(votes_of >= max(votes, 1))
    gone = bytearray(counts.size)
    found: list[tuple[float, float, int]] = []
    # the most votes first, of equals the first place
    for place in enough[np.argsort(-votes_of[enough], kind="stable")].tolist():
        if len(found) == most:
            break
        if gone[place]:
            continue
        a, r = divmod(place, row)
        found.append((float(a), float(r - size), int(votes_of[place])))
        for da in range(-3, 4):
            # past the ends of the half circle a line comes back with the sign of its distance turned
            b, mirrored = (a + da) % 180, not 0 <= a + da < 180
            at = 2 * size - r if mirrored else r
            first, last = max(0, at - 4), min(row, at + 5)
            gone[b * row + first : b * row + last] = b"\1" * (last - first)
    return found


def flatten_curve(image: np.ndarray, curve: np.ndarray, analysis_height: int) -> np.ndarray:
    """Rows moved along a curve of vertical offsets, most in the middle of the page; in strips, so memory stays bounded."""
    height, width = image.shape[:2]
    offsets = curve[np.floor(np.arange(width) / max(1, width - 1) * (len(curve) - 1) + 0.5).astype(int)] * (height / analysis_height)
    out = np.empty_like(image)
    for start in range(0, height, STRIP):
        y = np.arange(start, min(start + STRIP, height))[:, None]
        mapped = y + offsets * np.sin(np.pi * y / max(1, height - 1))
        if (mapped < 0).any() or (mapped > height - 1).any():
            raise ValueError("the curve leaves the picture")
        low = np.minimum(mapped.astype(int), height - 2)
        part = mapped - low
        columns = np.arange(width)
        a, b = image[low, columns].astype(float), image[low + 1, columns].astype(float)
        if image.ndim == 3:
            part = part[..., None]
        out[start : start + STRIP] = np.floor(a * (1 - part) + b * part + 0.5)
    return out


def edge_taper(curve: np.ndarray, start: int, width: int) -> np.ndarray:
    """Offsets fade out linearly over 8 % of the region at either end, and are nothing outside it."""
    x = np.arange(len(curve))
    away = np.minimum(x - start, start + width - 1 - x)
    return np.where(away < 0, 0.0, curve * np.minimum(1.0, np.maximum(away, 0) / max(2, half_up(width * 0.08))))


def straightness(image: np.ndarray) -> float:
    """The share of ink that lies in horizontal strokes."""
    ink = ~adaptive(luminance(image), 31, 15)
    return float(opened(ink, max(9, image.shape[1] // 40) | 1, 1).sum() / ink.sum()) if ink.any() else 0.0


def black_white(grey: np.ndarray) -> np.ndarray:
    """Ink black, paper white, by the neighbourhood's brightness."""
    block = min(max(half_up(min(grey.shape) * 0.025), 31), 101) | 1
    return np.where(adaptive(grey.astype(float), block, 12), 255, 0).astype(np.uint8)


def neutral_paper(image: np.ndarray, amount: float = 0.7) -> np.ndarray:
    """Paper moves towards grey; colored ink and pictures keep their color."""
    mask = paper_mask(image)[..., None]
    grey = luminance(image)[..., None]
    return np.floor(np.where(mask, image * (1 - amount) + grey * amount, image) + 0.5).astype(np.uint8)
