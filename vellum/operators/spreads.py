"""Does a picture show one page or two?  Evidence comes from one pass over its pixels, the decision from Columns.

The pass adds up columns of pixels once; every band, shoulder and field is then a difference of prefix sums, for all
places of a cut at the same time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import policies as P
from vellum.functions.numbers import cascade
from vellum.operators.images import half_up, luminance, per_picture

# fixed values: grey levels below which a pixel is ink, and above which it is paper
INK, PAPER = 205, 225
# fixed values: the part of a picture, in shares of its width and height, where a cut may lie and rows are read
MIDDLE, ROWS = (0.35, 0.65), (0.05, 0.95)
# fixed values: most rows that are read for the spine, for bands of columns and for fields of text
SPINE_ROWS, BAND_ROWS, FIELD_ROWS, FIELD_COLUMNS = 512, 256, 160, 128
# fixed values: where fields of text begin and end, and how far they stay from the cut
OUTER, INNER = 0.04, 0.025
# fixed values: rows and columns of the grid that shows how a field is filled, and the ink that fills a part of it
GRID, FILLED = (10, 8), 0.008
EVIDENCE = "width int, height int, cut int, fallback boolean, spine double, shadow double, low double, calm double, gradient double, continuity double, left double, left_structure double, right double, right_structure double"
FIELDS = [c.split()[0] for c in EVIDENCE.split(", ")]


def ramp(x, low: float, span: float):
    """0 up to low, 1 from low + span on, a line between."""
    return np.clip((x - low) / span, 0.0, 1.0)


class Strips:
    """Prefix sums along x of rows that are read: brightness, its square, and ink."""

    def __init__(self, grey: np.ndarray, most: int):
        height = grey.shape[0]
        top = half_up(height * ROWS[0])
        bottom = max(top + 1, half_up(height * ROWS[1]))
        self.part = grey[top : bottom : max(1, (bottom - top) // most)]
        layers = np.stack([self.part, self.part**2, self.part < INK]).mean(axis=1)
        self.sums = np.concatenate((np.zeros((3, 1)), np.cumsum(layers, axis=1)), axis=1)

    def around(self, xs: np.ndarray, radius: int, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean brightness, mean square and share of ink of the columns up to ``radius`` from each x; columns beyond the ends do not count."""
        last = self.part.shape[1] - 1 if last is None else last
        low = np.clip(xs - radius, first, last)
        high = np.maximum(low, np.clip(xs + radius, first, last))
        return tuple((self.sums[:, high + 1] - self.sums[:, low]) / (high + 1 - low))


def spine_of(grey: np.ndarray) -> tuple[int, float, bool]:
    """(x, confidence, whether the middle had to do) of the darkest, calmest, most central valley."""
    height, width = grey.shape
    center = width // 2
    if width < 20 or height < 10:
        return center, 0.0, True
    start, end = (half_up(width * m) for m in MIDDLE)
    shoulder, smooth = max(2, half_up(width * 0.04)), max(1, half_up(width * 0.004))
    first, last = max(0, start - shoulder), min(width - 1, end + shoulder)
    strips = Strips(grey, SPINE_ROWS)
    each = np.arange(first, last + 1)
    column_mean, column_square, _ = strips.around(each, 0)
    sums = np.concatenate((np.zeros((2, 1)), np.cumsum([column_mean, np.maximum(0, column_square - column_mean**2)], axis=1)), axis=1)
    low, high = np.maximum(each - smooth, first) - first, np.minimum(each + smooth, last) - first
    mean, variance = (sums[:, high + 1] - sums[:, low]) / (high + 1 - low)
    xs = np.arange(start, end + 1)
    at = xs - first
    darkness = (mean[at].max() - mean[at]) / max(1.0, np.ptp(mean[at]))
    calmness = (variance[at].max() - variance[at]) / max(1.0, np.ptp(variance[at]))
    valley = ramp((mean[at - shoulder] + mean[at + shoulder]) / 2 - mean[at], 0, 30)
    central = 1 - np.abs(xs - center) / max(1, end - center)
    k = int(np.argmax(np.clip([darkness, valley, calmness, central], 0, 1).T @ [0.38, 0.32, 0.18, 0.12]))
    confidence = float(np.clip(np.clip([valley[k], darkness[k], central[k]], 0, 1) @ [0.55, 0.30, 0.15], 0, 1))
    weak = confidence < 0.28 or valley[k] < 0.08
    return (center if weak else int(xs[k])), confidence, bool(weak)


def gutters(strips: Strips, width: int, preferred: int) -> dict[str, float]:
    """The place most like a gutter: emptier or darker than its shoulders."""
    start, end = (half_up(width * m) for m in MIDDLE)
    shoulder, radius = max(3, half_up(width * 0.035)), max(2, half_up(width * 0.009))
    xs = np.arange(start, end + 1)
    (mean, square, ink), left, right = (strips.around(xs + d, radius) for d in (0, -shoulder, shoulder))
    told = {
        "low": ramp((left[2] + right[2]) / 2 - ink, 0, 0.10), "shadow": ramp((left[0] + right[0]) / 2 - mean, 0, 30), "gradient": ramp(np.abs(mean - np.minimum(left[0], right[0])), 0, 34),
        "calm": np.clip(1 - np.sqrt(np.maximum(0, square - mean**2)) / 70, 0, 1),
    }
    central = np.clip(1 - np.abs(xs - width / 2) / max(1, (end - start) / 2), 0, 1)
    score = np.maximum(told["low"], told["shadow"]) * 0.48 + told["calm"] * 0.18 + told["gradient"] * 0.22 + central * 0.12
    k = int(np.argmax(score))
    if score[k] <= 0:
        return {"x": min(max(preferred, start), end), **dict.fromkeys(told, 0.0)}
    return {"x": int(xs[k]), **{name: float(v[k]) for name, v in told.items()}}


def field(grey: np.ndarray, begin: float, finish: float) -> tuple[float, float]:
    """(content, structure) of the upright part between two shares of the width: ink as on a page of text, on paper, all over a grid."""
    width = grey.shape[1]
    start, end = (half_up(width * min(1.0, max(0.0, s))) for s in (begin, finish))
    if end - start < 4:
        return 0.0, 0.0
    part = Strips(grey[:, start:end], FIELD_ROWS).part[:, :: max(1, (end - start) // FIELD_COLUMNS)]
    height = grey.shape[0]
    top, bottom = half_up(height * ROWS[0]), max(half_up(height * ROWS[0]) + 1, half_up(height * ROWS[1]))
    ink = part < INK
    filled = []
    for axis, parts, size, step in ((1, GRID[0], bottom - top, max(1, (bottom - top) // FIELD_ROWS)), (0, GRID[1], end - start, max(1, (end - start) // FIELD_COLUMNS))):
        shares = ink.mean(axis=axis)
        label = np.minimum(np.arange(len(shares)) * step * parts // max(1, size), parts - 1)
        n = np.bincount(label, minlength=parts)
        filled.append(((n > 0) & (np.bincount(label, shares, parts) >= FILLED * n)).mean())
    share = ink.mean()
    paper = ramp((part > PAPER).mean(), 0.28, 0.48)
    content = ramp(share, 0.008, 0.07) * (0.58 + paper * 0.42) * (1 - ramp(share, 0.48, 0.24) * 0.75)
    structure = np.array([content, paper, *filled]) @ [0.38, 0.24, 0.22, 0.16]
    return float(np.clip(content, 0, 1)), float(np.clip(structure, 0, 1))


def evidence(image: np.ndarray) -> dict:
    """What speaks for one page or two, by the names in EVIDENCE; zeros for pictures that are too small."""
    height, width = image.shape[:2]
    if width < 20 or height < 10:
        return dict.fromkeys(FIELDS, 0.0) | {"width": width, "height": height, "cut": width // 2, "fallback": True}
    grey = luminance(image)
    spine, confidence, weak = spine_of(grey)
    strips = Strips(grey, BAND_ROWS)
    g = gutters(strips, width, spine)
    cut = int(g.pop("x")) if weak else spine
    reach = max(2, half_up(width * 0.035))
    beside = (strips.part[:, max(cut - reach, 0)] + strips.part[:, min(cut + reach, width - 1)]) / 2
    (lc, ls), (rc, rs) = field(grey, OUTER, cut / width - INNER), field(grey, cut / width + INNER, 1 - OUTER)
    return {
        "width": width, "height": height, "cut": cut, "fallback": weak, "spine": confidence, **{n: g[n] for n in ("shadow", "low", "calm", "gradient")}, "continuity": float((np.abs(beside - strips.part[:, cut]) >= 10).mean()),
        "left": lc, "left_structure": ls, "right": rc, "right_structure": rs,
    }


def classified(found: DataFrame, *keys: Column | str) -> DataFrame:
    """layout, x, confidence and reason of rows of EVIDENCE."""
    aspect = F.col("width") / F.greatest(F.lit(1), F.col("height"))
    shadow, calm = F.greatest("spine", "shadow") * 0.70 + F.col("continuity") * 0.30, F.col("low") * 0.55 + F.col("calm") * 0.20 + F.col("gradient") * 0.25
    told = found.withColumns({"aspect": aspect, "balance": P.balance(F.col("left"), F.col("right")), "structure": F.sqrt(F.col("left_structure") * F.col("right_structure")), "gutter": F.greatest(shadow, calm)})
    told = told.withColumn("confidence", P.spread_confidence())
    layout, reason = P.spread_class(F.col("confidence"))
    small = (F.col("width") < 20) | (F.col("height") < 10)
    told = told.withColumns({"layout": F.when(small, "single").otherwise(layout), "reason": cascade((small, "image_too_small"), otherwise=reason), "confidence": F.when(small, 0.0).otherwise(F.col("confidence"))})
    x = F.when(F.col("layout") == "spread", F.col("cut")).otherwise(F.floor(F.col("width") / 2)).cast("long")
    return told.select(*keys, "layout", x.alias("x"), "confidence", "reason")


def analyzed(pictures: DataFrame, decode, key: str) -> DataFrame:
    """layout, x (where to cut), confidence and reason of each picture."""
    return classified(per_picture(pictures, decode, evidence, key, EVIDENCE), key)
