"""Queries over frames and pictures, which SQL cannot express: rows only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import images as I
from vellum.operators import spreads
from vellum.operators import vision as V
from vellum.sources.tables import table, view
from vellum.streaming.stabilizer import CORNER_RULES, stabilize_batch


def frames_with_corners(spark, d):
    """Frames with a boundary that wanders with the frame's value."""
    f = view(spark, d, "frames")
    off = (F.col("event_id") % 7 - 3) / 200.0 + F.when(F.col("event_id") % 31 == 0, 0.3).otherwise(0.0)
    box = ((0.1, 0.1), (0.9, 0.1), (0.9, 0.92), (0.1, 0.92))
    shrink = F.when(F.col("event_id") % 53 < 6, 0.6).otherwise(1.0)
    return f.select("stream_id", "t_ms", "event_id", "detected", F.least("confidence", F.lit(1.0)).alias("confidence"), *[((v * shrink) + off).alias(f"{a}{k}") for k, p in enumerate(box) for a, v in zip(("x", "y"), p, strict=True)])


def boundary_stabilizer(spark, d):
    return stabilize_batch(frames_with_corners(spark, d))


def corner_stabilizer(spark, d):
    """The older rules, by corners alone."""
    return stabilize_batch(frames_with_corners(spark, d), CORNER_RULES)


def shutter_boundaries(spark, d):
    """What each shutter finds: the boundary shown, unless it was last seen more than 750 ms ago.  Shutters come 300 ms after some frames, whether or not a frame does."""
    f = frames_with_corners(spark, d)
    blank = {c: F.lit(None).cast(t) for c, t in f.dtypes if c not in ("stream_id", "t_ms", "event_id")}
    shutters = f.filter("event_id % 6 = 0").withColumns({"t_ms": F.col("t_ms") + 300, "event_id": -F.col("event_id"), **blank})
    return stabilize_batch(f.unionByName(shutters), strict=True).filter("event_id < 0 OR event_id IS NULL")


def picture(row: tuple) -> np.ndarray:
    """A grey picture of an open book, drawn from a row's vector: its values shade the columns, lines of text follow."""
    profile = np.interp(np.linspace(0, 63, 240), np.arange(64), np.asarray(row[1], float))
    grey = np.tile(238 + profile * 40, (120, 1))
    grey[12:108:6, 16:104] = 70
    if row[0] % 3:
        grey[12:108:6, 136:224] = 70
    grey[:, 117:124] -= 60 * (row[0] % 2)
    return np.clip(grey, 0, 255).astype(np.uint8)


def spread_raster(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return spreads.analyzed(rows, picture, "vec_id")


def image_quality(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return I.per_picture(rows, picture, I.quality, "vec_id", "sharpness double, ink_sharpness double, ink long, speckle double, noise double")


def enhanced_quality(spark, d):
    """Quality before and after whitening."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")

    def both(grey):
        a, b = I.quality(grey), I.quality(I.whiten(grey))
        return {"before": a["sharpness"], "after": b["sharpness"], "white": float((I.whiten(grey) > 250).mean())}

    return I.per_picture(rows, picture, both, "vec_id", "before double, after double, white double")


def rectified_pages(spark, d):
    """Pages cut out by their corners and made rectangular: how much of each is ink."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")

    def ink(grey):
        page = I.warp_perspective(grey, np.array([[6, 4], [116, 2], [118, 116], [4, 118]], float), 110, 114)
        return {"ink": float((page < I.DARK).mean()), "edges": float((I.sobel_magnitude(page.astype(float)) > 200).mean())}

    return I.per_picture(rows, picture, ink, "vec_id", "ink double, edges double")


def detected_pages(spark, d):
    """Where the page lies in a picture, how much of it it takes, and what its edges are like."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")

    def scene(row):
        page = picture(row)
        desk = np.full((150, 280), 60 + row[0] % 30, np.uint8)
        desk[15:135, 20:260] = page
        return desk

    def find(grey):
        found = V.detect_document(grey)
        corners = found["corners"].ravel().round(3).tolist() if found else None
        lines = V.hough_lines(V.canny(grey), 60)
        return {"share": found["share"] if found else 0.0, "corners": corners, "lines": len(lines), "straight": V.straightness(grey)}

    return I.per_picture(rows, scene, find, "vec_id", "share double, corners array<double>, lines long, straight double")


def flattened_pages(spark, d):
    """Pages bent by a known curve and flattened again: how far the result is from the page."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")

    def difference(grey):
        curve = V.edge_taper(np.sin(np.linspace(0, np.pi, grey.shape[1])) * 1.5, 0, grey.shape[1])
        bent = V.flatten_curve(grey, -curve * 0.5, grey.shape[0])
        back = V.flatten_curve(bent, curve * 0.5, grey.shape[0])
        return {"difference": float(np.abs(back.astype(float) - grey).mean()), "ink": float((V.black_white(back) == 0).mean())}

    return I.per_picture(rows, picture, difference, "vec_id", "difference double, ink double")


QUERIES = {f.__name__: f for f in (boundary_stabilizer, corner_stabilizer, shutter_boundaries, spread_raster, image_quality, enhanced_quality, rectified_pages, detected_pages, flattened_pages)}
ORACLE: dict[str, str] = {}
