"""Decisions on boundaries, as Columns: the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.geometry import Quad, distance
from vellum.functions.numbers import cascade, clamp, col, ratio, weighted

# fixed values: the weights, thresholds and names in this module's expressions have to be these for results to be right
SPINE_LIMIT, OUTWARD_LIMIT = 0.055, 0.10


def edge_visibility() -> Column:
    """Of transition, support, border, occlusion, reliable."""
    return cascade(
        (F.col("occlusion") >= 0.48, "occluded"),
        ((F.col("border") <= 0.025) & (F.col("transition") < 0.30), "outOfFrame"),
        (F.col("reliable") & (F.col("transition") >= 0.30) & (F.col("support") >= 0.46), "confirmed"),
        ((F.col("transition") >= 0.16) | (F.col("support") >= 0.28), "weak"),
        otherwise="unknown",
    )


def outward_margin(edge: Column, visibility: Column) -> Column:
    bottom = edge == "bottom"
    return cascade(
        (visibility == "confirmed", F.lit(0.0)),
        ((visibility == "weak") & bottom, F.lit(0.035)),
        (visibility == "weak", F.lit(0.012)),
        (bottom, F.lit(0.070)),
        (visibility == "occluded", F.lit(0.030)),
        otherwise=F.lit(0.040),
    )


def is_spine_edge(side: Column, edge: Column) -> Column:
    return F.coalesce(((side == "left") & (edge == "right")) | ((side == "right") & (edge == "left")), F.lit(False))


def paper_candidate_score(owns_center: Column) -> Column:
    fits = owns_center & (F.col("containment") >= 0.82) & F.col("expansion").between(0.90, 1.85)
    near = clamp(F.lit(1.0) - F.abs(F.col("expansion") - 1.16) / 0.75)
    return F.when(fits, clamp("containment") * 0.52 + near * 0.20 + clamp("transition") * 0.28)


def refinement_verdict() -> Column:
    """Why a refined boundary is rejected; ``accepted`` if nothing speaks against it."""
    paper = F.coalesce(F.col("paper_score") >= 0.56, F.lit(False))
    return cascade(
        (F.col("partial_raw"), "partial_ai_raw"),
        (~F.col("has_corners"), "refined_corners_unavailable"),
        (~F.col("in_bounds"), "refined_corners_out_of_bounds"),
        (~F.col("convex"), "refined_boundary_not_convex"),
        (F.col("expansion") < 0.96, "excessive_inward_refinement"),
        (F.col("expansion") > 1.55, "excessive_refinement_expansion"),
        (F.col("containment") < 0.94, "ai_foreground_clipped"),
        (F.col("ownership") < 0.66, "main_page_ownership_lost"),
        (F.col("adjacent") >= 0.66, "adjacent_page_merge"),
        ((F.col("reliable_edges") < 2) & ~paper, "paper_transition_unreliable"),
        ((F.col("transition") < 0.18) & ~paper, "paper_transition_weak"),
        otherwise="accepted",
    )


def refined_confidence(sane: Column) -> Column:
    near = clamp(F.lit(1.0) - F.abs(F.col("expansion") - 1.16) / 0.55)
    return clamp(
        clamp("containment") * 0.24 + near * 0.13 + clamp("transition") * 0.14 + clamp("envelope") * 0.14 + clamp("continuity") * 0.13
        + F.when(sane, 0.12).otherwise(0.0) - clamp("adjacent") * 0.18 - clamp("occlusion") * 0.12
    )


def refinement_status(verdict: Column, confidence: Column, conservative: Column) -> Column:
    """What becomes of a refined boundary, as the page's record names it."""
    return cascade(
        ((verdict == "accepted") & (conservative | (confidence < 0.58)), "acceptedConservative"),
        ((verdict == "accepted") & (F.col("occlusion") >= 0.16), "acceptedOcclusionRecovered"),
        (verdict == "accepted", "accepted"),
        (verdict == "partial_ai_raw", "rejectedPartialRaw"),
        (verdict.isin("adjacent_page_merge", "main_page_ownership_lost"), "rejectedAdjacentPage"),
        (verdict == "occlusion_unresolved", "rejectedOcclusion"),
        (verdict == "excessive_refinement_expansion", "rejectedExpansion"),
        (verdict == "excessive_inward_refinement", "rejectedShrink"),
        (verdict == "ai_foreground_clipped", "rejectedForegroundClipped"),
        (verdict.isin("refined_boundary_not_convex", "refined_corners_out_of_bounds"), "rejectedGeometry"),
        otherwise="rawFallback",
    )


def edge_expansion() -> tuple[Column, Column, Column]:
    """(applied share, held back, reliable) of a requested outward move."""
    limit = F.when(is_spine_edge(F.col("side"), F.col("edge")), SPINE_LIMIT).otherwise(OUTWARD_LIMIT)
    safety = (
        clamp((F.col("transition") - 0.18) / 0.34) * 0.42 + clamp("continuity") * 0.18 + clamp((F.col("ownership") - 0.66) / (1 - 0.66)) * 0.20
        + (F.lit(1.0) - clamp("adjacent")) * 0.14 + (F.lit(1.0) - clamp("occlusion")) * 0.06
    )
    applied = clamp("requested", 0.0, limit * clamp(safety))
    reliable = (F.col("transition") >= 0.18) & (F.col("ownership") >= 0.66) & (F.col("adjacent") < 0.66) & (F.col("occlusion") <= 0.48)
    return applied, applied + 1e-9 < F.col("requested"), reliable


def ownership(containment: Column, centroid: Column, intersection: Column) -> Column:
    return clamp(containment) * 0.55 + clamp(centroid) * 0.25 + clamp(intersection) * 0.20


def adjacent_penalty(expansion: Column, overshoot: Column, narrow: Column) -> Column:
    return clamp(clamp((expansion - 1.24) / 0.34) * 0.42 + clamp(overshoot / 0.12) * 0.38 + clamp(narrow) * 0.20)


def is_partial_raw(area: Column, horizontal: Column, vertical: Column, covers_center: Column, bottom: Column, internal: Column, side: Column) -> Column:
    severe = (horizontal < 0.28) | (vertical < 0.34)
    detached = internal & (horizontal < F.when(side.isNull(), 0.72).otherwise(0.64)) & (vertical < 0.70) & (bottom < 0.78)
    tiny = (area < 0.045) & ~covers_center & (vertical < 0.52)
    return severe | detached | tiny


def curvature_class() -> Column:
    mild = F.col("magnitude") < 0.008
    by_confidence = mild & (F.col("confidence") >= 0.56) & (F.col("coverage") >= 0.52) & (F.col("consistency") >= 0.72)
    witnesses = (F.col("n_geometry") >= 2) | ((F.col("n_geometry") >= 1) & (F.col("n_internal") >= 1) & F.col("agree"))
    by_geometry = mild & (F.col("contour") >= 0.0015) & (F.col("direction") >= 0.67) & (F.col("confidence") >= 0.50) & (F.col("consistency") >= 0.60) & witnesses
    return cascade(
        ((F.col("evidence") < 2) | (F.col("coverage") < 0.48) | F.col("conflict"), "unreliable"),
        ((F.col("magnitude") < 0.0015) & (F.col("contour") < 0.0015) & (F.col("internal") < 0.0015), "flat"),
        (by_confidence | by_geometry, "mildCurve"),
        ((F.col("magnitude") >= 0.008) & (F.col("confidence") >= 0.68), "strongCurve"),
        otherwise="unreliable",
    )


def deformation(state: Column) -> Column:
    """The magnitude that is applied: of internal lines if there are any, else of the contour up to a cap, weakened for mild curves."""
    profile = F.when(F.col("n_internal") > 0, F.abs("internal")).otherwise(F.least(F.abs("contour"), F.lit(0.006)))
    return profile * cascade((state == "mildCurve", F.lit(0.55)), (state == "strongCurve", F.lit(1.0)), otherwise=F.lit(0.0))


def adopts_curve(state: Column) -> Column:
    straighter = (F.col("straight_before") > 0) & (F.col("straight_after") >= F.col("straight_before") * F.when(state == "mildCurve", 1.0005).otherwise(1.005))
    flatter = (state == "mildCurve") & (F.col("contour") >= 0.0015) & (F.col("internal") <= F.col("contour") * 0.995)
    return (F.col("stretch") <= 0.025) & (straighter | flatter)


def keeps_canvas() -> Column:
    """Width, height and aspect of before and after differ by 2 % at most."""
    b, a = F.col("before_w") / F.col("before_h"), F.col("after_w") / F.col("after_h")
    return (
        (F.abs(F.col("after_w") - F.col("before_w")) / F.col("before_w") <= 0.02)
        & (F.abs(F.col("after_h") - F.col("before_h")) / F.col("before_h") <= 0.02)
        & (F.abs(a - b) / b <= 0.02)
    )


def guidance(unit: Quad, confidence: Column, stability: Column, clipping: Column) -> Column:
    """What to tell the person who holds the camera."""
    stable = stability >= 0.99
    close = (unit.left < 0.008) | (unit.top < 0.008) | (unit.right > 0.992) | (unit.bottom > 0.992)
    return cascade(
        (~unit.is_valid(), "notDetected"),
        (stable & (clipping >= 0.45), "clipped"),
        (stable & (unit.area >= 0.88) & ((clipping >= 0.2) | close), "tooClose"),
        ((unit.area <= 0.12) | ((unit.area <= 0.20) & (confidence < 0.70)), "tooFar"),
        ((confidence < 0.45) | ~stable, "unstable"),
        otherwise="ready",
    )


def refinement_rejection(capture: Quad, refined: Quad) -> Column:
    """Why a finer boundary does not replace the captured one; ``none`` if it does."""
    d = capture.distances(refined)
    return cascade(
        ((F.greatest(*d) > 0.05) | ((d[0] + d[1] + d[2] + d[3]) / 4.0 > 0.035), "excessive_corner_delta"),
        (refined.area < capture.area * 0.96, "area_shrunk"),
        ((refined.width < capture.width * 0.96) | (refined.height < capture.height * 0.96), "extent_shrunk"),
        (F.greatest(refined.left - capture.left, capture.right - refined.right, refined.top - capture.top, capture.bottom - refined.bottom) > 0.025, "inward_edge_move"),
        otherwise="none",
    )


def guide_overlap(quad: Quad, guide: Quad, width: Column, height: Column) -> Column:
    """The share of quad's bounds within the guide's bounds, these widened by 16 % of the image; 1 for an empty quad."""
    left, right = clamp(guide.left - width * 0.16, 0.0, width), clamp(guide.right + width * 0.16, 0.0, width)
    top, bottom = clamp(guide.top - height * 0.16, 0.0, height), clamp(guide.bottom + height * 0.16, 0.0, height)
    shared = F.greatest(F.least(quad.right, right) - F.greatest(quad.left, left), F.lit(0.0)) * F.greatest(F.least(quad.bottom, bottom) - F.greatest(quad.top, top), F.lit(0.0))
    return ratio(shared, quad.width * quad.height, 1.0)


def output_size(quad: Quad) -> tuple[Column, Column]:
    def longer(a: int, b: int, c: int, d: int) -> Column:
        size = F.greatest(distance(*quad.point(a), *quad.point(b)), distance(*quad.point(c), *quad.point(d)))
        return clamp(F.floor(size + 0.5).cast("double"), 1, 1_000_000).cast("int")

    return longer(0, 1, 3, 2), longer(0, 3, 1, 2)


def guide_level(available: Column, sane: Column, stable: Column, confidence: Column) -> Column:
    return cascade((~available, "none"), (~sane, "low"), (stable & (confidence >= 0.45), "stable"), (confidence >= 0.30, "medium"), otherwise="low")


def spread_class(confidence: Column) -> tuple[Column, Column]:
    """(layout, reason) of aspect, left, right, balance, structure, gutter and confidence."""
    low = confidence < 0.45
    rules = (
        (F.col("aspect") < 1.10, "single", "not_landscape"),
        (F.least("left", "right") < 0.34, "single", "one_sided_content"),
        (F.col("balance") < 0.48, "single", "content_unbalanced"),
        (F.col("structure") < 0.38, "single", "not_page_like"),
        ((F.col("gutter") < 0.32) & low, "single", "no_central_gutter"),
        (F.col("gutter") < 0.32, "uncertain", "weak_central_gutter"),
        (confidence >= 0.72, "spread", "none"),
        (low, "single", "low_confidence"),
    )
    return (
        cascade(*[(c, layout) for c, layout, _ in rules], otherwise="uncertain"),
        cascade(*[(c, reason) for c, _, reason in rules], otherwise="below_spread_threshold"),
    )


def spread_confidence() -> Column:
    """Raised where two page-like fields stand beside a real gap."""
    dual = F.sqrt(F.col("left") * F.col("right")) * F.col("balance")
    plain = weighted((0.30, "gutter"), (0.34, dual), (0.24, "structure")) + clamp((F.col("aspect") - 1.10) / 0.38) * 0.12
    clear = (F.col("aspect") >= 1.28) & (F.col("left") >= 0.52) & (F.col("right") >= 0.52) & (F.col("balance") >= 0.68) & (F.col("structure") >= 0.50) & (F.col("gutter") >= 0.44)
    return clamp(F.when(clear, F.greatest(plain, F.lit(0.72 + 0.03))).otherwise(plain))


def balance(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) <= 0.001, 0.0).otherwise(clamp(F.least(a, b) / F.greatest(a, b)))
