"""Scores of page candidates, as Columns over a candidate's features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.numbers import cascade, clamp, weighted

# fixed values: the weights, thresholds and names in this module's expressions have to be these for results to be right
INELIGIBLE = -1.0


def is_eligible() -> Column:
    """The limits that depend on kind are wider for pages of a book in width and area, and narrower in continuation."""
    book = F.col("kind") == "bookPage"
    return (
        ~F.col("self_intersects")
        & (F.col("width_ratio") >= F.when(book, 0.42).otherwise(0.46))
        & (F.col("height_ratio") >= 0.48)
        & (F.col("containment") >= 0.72)
        & (F.col("envelope") >= 0.80)
        & (F.col("area_ratio") >= F.when(book, 0.24).otherwise(0.14))
        & (F.col("continuation") < F.when(book, 0.42).otherwise(0.58))
        & (F.col("line_penalty") < 0.82)
    )


def evidence_score() -> Column:
    return clamp(weighted((0.23, "occupancy"), (0.15, "border"), (0.17, "contrast"), (0.16, "paper"), (0.10, "rect"), (0.19, "edge"), (-0.24, "line_penalty"), (-0.18, "small_penalty")))


def confidence() -> Column:
    return F.when(is_eligible(), evidence_score()).otherwise(0.0)


def document_score() -> Column:
    return weighted(
        (0.08, "base_score"), (0.24, "occupancy"), (0.16, "border"), (0.14, "contrast"), (0.14, "paper"), (0.08, "rect"), (0.08, "edge"), (0.08, "envelope"),
        (-0.28, "line_penalty"), (-0.22, "small_penalty"), (-0.10, "continuation"),
    )


def spread_score() -> Column:
    """A page that looks like two is marked down, so that its halves win."""
    spine = (F.col("spine_strength") >= 0.35) & (F.col("spine_proximity") >= 0.7)
    wide = (F.col("aspect_ratio") >= 1.15) & (F.col("area_ratio") >= 0.45) & (F.col("two_page") >= 0.35)
    return F.col("base_score") - F.when(spine & wide, 0.24).otherwise(0.0)


def book_score() -> Column:
    structure = (F.col("spine_strength") + F.col("spine_proximity") + F.col("text_density")) / 3.0
    unowned = F.when(F.col("side") == "single", (1.0 - structure) * 0.15).otherwise(0.0)
    return (
        weighted(
            (0.05, "base_score"), (0.22, "occupancy"), (0.16, "border"), (0.11, "contrast"), (0.13, "paper"), (0.06, "rect"), (0.10, "edge"), (0.11, "outer_anchor"), (0.06, "envelope"),
            (0.05, "spine_strength"), (0.04, "spine_proximity"), (0.04, "text_density"), (0.02, "curvature"),
            (-0.28, "line_penalty"), (-0.22, "small_penalty"), (-0.10, "continuation"), (-0.20, "overlap"),
        )
        - unowned
    )


def score() -> Column:
    return cascade((~is_eligible(), F.lit(INELIGIBLE)), (F.col("kind") == "document", document_score()), (F.col("kind") == "openBookSpread", spread_score()), otherwise=book_score())


def score_native() -> Column:
    """The device's own weights: no text density, less spine, and spreads always marked down."""
    book = weighted(
        (0.05, "base_score"), (0.22, "occupancy"), (0.16, "border"), (0.11, "contrast"), (0.13, "paper"), (0.06, "rect"), (0.10, "edge"), (0.11, "outer_anchor"), (0.06, "envelope"),
        (0.02, "spine_proximity"), (0.02, "curvature"), (-0.28, "line_penalty"), (-0.22, "small_penalty"), (-0.10, "continuation"), (-0.20, "overlap"),
    )
    return cascade((F.col("kind") == "document", document_score()), (F.col("kind") == "openBookSpread", F.col("base_score") - 0.24), otherwise=book)


def component_score(area: Column, center: Column, aspect: Column) -> Column:
    """Mask component without a guide: large, central, not drawn out."""
    return area * 0.70 + clamp(center) * 0.20 + clamp(F.lit(1.0) - (aspect - 1.0) / 7.0) * 0.10
