"""What becomes of a page or a session: states after an event, fallbacks, and checks of values that come from outside.

Every rule is an expression over one row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.numbers import cascade, clamp

# fixed values: allowed ranges of the parameters of curve policies
POLICY_RANGES = {
    "inset": (0.0, 0.2), "confidence": (0.0, 1.0), "least_deformation": (0.0, 0.1), "most_deformation": (0.0, 0.1), "adjacent": (0.0, 0.1), "coverage": (0.0, 1.0),
    "consistency": (0.0, 1.0), "mild_magnitude": (0.0, 0.1), "mild_confidence": (0.0, 1.0), "mild_coverage": (0.0, 1.0), "mild_consistency": (0.0, 1.0), "mild_strength": (0.0, 1.0),
}
# fixed values: names of enhancement modes, and the file type of images between two steps
MODES = ("scanColor", "originalColor", "grayscale", "blackWhite")
LOSSLESS = ".png"

EVENTS = ("detection", "corners", "correction", "curvature", "enhancement", "spread_fallback")
STATE = (
    "corners", "crop_source", "adjusted", "correction", "correction_type", "outcome", "failure", "corrected_path", "perspective_applied", "curvature", "curved_applied", "spread_fallback",
    "enhancement", "enhancement_applied", "enhanced_path",
)


def after_event(event: Column, new) -> dict[str, Column]:
    """The state of a page after an event; ``new`` gives the event's own value of a name.  Values that an event leaves null stay as they were."""
    detection, corners, correction, curvature, enhancement, spread = (event == e for e in EVENTS)
    done, perspective = new("status") == "completed", new("type") == "perspective"
    flat = ~new("applied") & (new("curvature") == "flat")

    def kept(name: str, *rules: tuple[Column, Column | str]) -> Column:
        """The first rule that holds, or what was; rules may give null to say the same."""
        return F.coalesce(cascade(*rules), F.col(name))

    def off(name: str, when: Column) -> Column:
        return F.when(when, F.lit("none")).otherwise(F.col(name))

    told = F.coalesce(new("outcome"), F.when(done, "completed").otherwise("none"))
    return {
        "corners": kept("corners", (detection | corners, new("corners"))),
        "crop_source": kept("crop_source", (detection, new("crop_source")), (corners, "manualCorners")),
        "adjusted": F.when(detection, False).when(corners, True).otherwise(F.col("adjusted")),
        "correction": kept("correction", (corners, "none"), (correction, new("status")), (curvature | spread, "completed")),
        "correction_type": kept("correction_type", (correction, new("type")), (curvature & new("applied"), "curved"), (curvature | spread, "perspective")),
        "outcome": kept("outcome", (correction, told), (curvature & flat, "nearlyFlat"), (curvature | spread, "completed")),
        "failure": F.when(curvature | (correction & (new("status") != "failed")), F.lit(None)).when(correction, F.coalesce(new("failure"), F.col("failure"))).otherwise(F.col("failure")),
        "corrected_path": kept("corrected_path", (correction | curvature | spread, new("path"))),
        "perspective_applied": F.col("perspective_applied") | curvature | spread | (correction & perspective & done),
        "curvature": kept("curvature", ((correction & perspective) | spread, "none"), (curvature, new("curvature"))),
        "curved_applied": F.when(correction & perspective, False).when(correction, done).when(curvature, new("applied")).otherwise(F.col("curved_applied")),
        "spread_fallback": (F.col("spread_fallback") & ~correction) | spread,
        "enhancement": kept("enhancement", (corners | correction | curvature, "none"), (enhancement, new("status"))),
        "enhancement_applied": F.when(correction | curvature, False).when(enhancement, done).otherwise(F.col("enhancement_applied")),
        "enhanced_path": kept("enhanced_path", (enhancement, new("path"))),
    }


def curve_adoption(state: Column, error: Column, error_state: Column, nearly_flat: Column) -> dict[str, Column]:
    """Whether a page takes its flattened picture: (state, applied, reject_reason, correction_type).  An error keeps the perspective picture."""
    applies = error.isNull() & F.coalesce(state.isin("mildCurve", "strongCurve"), F.lit(False))
    known = error_state.isin("none", "flat", "mildCurve", "strongCurve", "unreliable")
    of_error = F.when(F.coalesce(known, F.lit(False)), error_state).when(nearly_flat, "flat").otherwise("unreliable")
    of_result = F.when(applies | (state == "flat"), state).otherwise("unreliable")
    return {
        "state": F.when(error.isNull(), of_result).otherwise(of_error),
        "applied": applies,
        "reject_reason": cascade((applies, F.lit(None)), (error.isNull(), "missing_or_non_applicable_state"), otherwise=error),
        "correction_type": F.when(applies, "curved").otherwise("perspective"),
    }


def correction_result(type_: Column, has_corners: Column, perspective_ok: Column, ok: Column, keeps_canvas: Column, failure: Column) -> dict[str, Column]:
    """Outcome of a correction: a curved one first secures a perspective picture, which stays if the curved one fails."""
    curved = type_ == "curved"
    secured = curved & has_corners & perspective_ok
    accepted = has_corners & ok & (~curved | (perspective_ok & keeps_canvas))
    return {
        "status": F.when(accepted, "completed").otherwise("failed"),
        "path": cascade((accepted, type_), (secured, "perspective"), otherwise=F.lit(None)),
        "outcome": cascade((accepted, "completed"), (~has_corners, "none"), (secured & ok & ~keeps_canvas, "unsafeDeformation"), (curved, "lowConfidence"), otherwise="none"),
        "reason": cascade((accepted | ~has_corners, F.lit(None)), (secured & ok & ~keeps_canvas, "canvas_changed"), otherwise=F.coalesce(failure, F.lit("correction_failed"))),
        "enhance": accepted | secured,
    }


def spread_result(has_corners: Column, crop_source: Column, corrected: Column, cropped: Column) -> Column:
    """How a half of a spread comes to its picture: by correction, by the safe crop of its region, or not at all."""
    found = has_corners & (crop_source != "guideFallback")
    return cascade((found & corrected, "corrected"), (cropped, "safeCrop"), otherwise="failed")


def curve_boundary(contour_points: Column, contour_ok: Column, has_corners: Column, top_points: Column, bottom_points: Column) -> Column:
    """Which outline a page's curvature is read from."""
    by_contour = has_corners & (contour_points > 0) & contour_ok
    return cascade((by_contour, "contour"), ((top_points >= 4) | (bottom_points >= 4), "existing"), otherwise="none")


def curve_improves(state: Column, before: Column, after: Column, profile: Column, effective: Column, strength: Column, least: float = 0.0015) -> Column:
    """Whether a flattened picture is adopted: its lines are straighter, or a mild curve's profile is flatter."""
    straighter = (before > 0) & (after >= before * F.when(state == "mildCurve", 1.0005).otherwise(1.005))
    left = F.greatest(F.lit(0.0), profile - F.coalesce(effective, profile * F.coalesce(strength, F.lit(1.0))))
    return straighter | ((state == "mildCurve") & (profile >= least) & (left <= profile * 0.995))


def enhancement_problem(mode: Column, decoded: Column, source: tuple[Column, Column], output: tuple[Column, Column], path: Column) -> Column:
    """Why an enhanced picture is not taken; null if it is."""
    return cascade(
        (~decoded, "not_decoded"), (~mode.isin(*MODES), "unknown_mode"), ((source[0] != output[0]) | (source[1] != output[1]), "resolution_changed"), (~F.lower(path).endswith(LOSSLESS), "lossy_file"),
    )


def policy_problem(values: dict[str, Column]) -> Column:
    """The first parameter that is missing, not finite or out of its range; ``order`` if the least deformation is not below the most."""
    bad = [(v.isNull() | F.isnan(v) | ~v.between(*POLICY_RANGES[name]), name) for name, v in values.items()]
    return cascade(*bad, (values["least_deformation"] >= values["most_deformation"], "order"))


def kind_of(json: Column, field: str) -> Column:
    """int, number, bool, string, list or object: what kind of value a JSON object has under a name; null for none."""
    name = F.schema_of_variant(F.try_variant_get(json, f"$.{field}", "variant"))
    return cascade(
        (name == "BIGINT", "int"), (name.rlike("^(DOUBLE|FLOAT|DECIMAL.*)$"), "number"), (name == "BOOLEAN", "bool"), (name == "STRING", "string"), (name.startswith("ARRAY"), "list"), (name.startswith("OBJECT"), "object"),
    )


def detection_problem(json: Column) -> Column:
    """Why a detector's answer is not taken; null if it is."""
    def is_(field: str, *kinds: str) -> Column:
        return F.coalesce(kind_of(json, field).isin(*kinds), F.lit(False))

    fine = is_("sourceWidth", "int") & is_("sourceHeight", "int") & is_("confidence", "int", "number") & is_("detected", "bool")
    return F.when(~fine, "invalid_detection")


def enhancer_problem(json: Column, timings: tuple[str, ...]) -> Column:
    """Why an enhancer's answer is not taken: sizes have to be positive, times not negative."""
    def whole(field: str, least: int) -> Column:
        return F.coalesce((kind_of(json, field) == "int") & (F.try_variant_get(json, f"$.{field}", "long") >= least), F.lit(False))

    output = whole("outputWidth", 1) & whole("outputHeight", 1) & whole("processingMilliseconds", 0)
    timed = F.lit(True)
    for t in timings:
        timed = timed & (kind_of(json, t).isNull() | whole(t, 0))
    return cascade((~output, "invalid_output"), (~timed, "invalid_timing"))


def recognition_problem(json: Column) -> Column:
    """Why a text recogniser's answer is not taken."""
    def is_(field: str, kind: str) -> Column:
        return F.coalesce(kind_of(json, field) == kind, F.lit(False))

    sizes = [is_(f, "int") & F.coalesce(F.try_variant_get(json, f"$.{f}", "long") > 0, F.lit(False)) for f in ("sourceWidth", "sourceHeight")]
    return F.when(~(is_("fullText", "string") & is_("sourcePageId", "string") & sizes[0] & sizes[1] & is_("blocks", "list")), "invalid_result")


def inset_region(width: Column, height: Column, detected: Column, inset: float = 0.04) -> list[Column]:
    """x, y, width and height of the part of a picture that a curve is read from."""
    def half_up(x: Column) -> Column:
        return F.floor(x + 0.5).cast("int")

    x, y = half_up(width * inset), half_up(height * inset)
    inner = [x, y, F.greatest(F.lit(1), half_up(width) - x * 2), F.greatest(F.lit(1), half_up(height) - y * 2)]
    return [F.when(detected, whole).otherwise(part) for whole, part in zip((F.lit(0), F.lit(0), half_up(width), half_up(height)), inner, strict=True)]


def with_ends(points: Column, start: Column, end: Column) -> Column:
    """An edge's points with other ends."""
    return F.concat(F.array(start), F.slice(points, F.lit(2), F.greatest(F.size(points) - 2, F.lit(0))), F.array(end))


def scaled_points(points: Column, from_width: Column, from_height: Column, width: Column, height: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] / from_width * width).alias("x"), (p["y"] / from_height * height).alias("y")))


def content_safe(found: Column, scale: Column, numbers: dict[str, Column]) -> dict[str, Column]:
    """Numbers of a safe crop, points in the source's pixels; zeros where no crop was found."""
    return {name: F.when(found, (v / scale) if name in ("left", "top", "right", "bottom") else v).otherwise(F.lit(None) if name in ("left", "top", "right", "bottom") else F.lit(0.0)) for name, v in numbers.items()}


def failure_record(reason: Column, side: Column, numbers: dict[str, Column]) -> dict[str, Column]:
    """The record of a run that failed: what is not known is 0, a page without side is single."""
    return {"success": F.lit(False), "failure_reason": reason, "page_side": F.coalesce(side, F.lit("single")), **{n: F.coalesce(v, F.lit(0).cast("double")) for n, v in numbers.items()}}


def session_fate(event: Column, active: Column, created: Column, pages: Column) -> Column:
    """What becomes of a session: kept, deleted, or an error where another one is active."""
    return cascade(
        ((event == "restore") & active, "error"),
        (event == "restore", "active"),
        ((event == "discard") & created & (pages == 0), "deleted"),
        (event == "discard", "kept"),
        (event.isin("cancel", "exported", "delete"), "deleted"),
        otherwise="active",
    )


def scene_scale(width: Column, height: Column, longest: float = 1200.0) -> Column:
    """By how much a picture shrinks so that its longer edge fits a scene; never grows."""
    edge = F.greatest(width, height).cast("double")
    return F.when(edge <= longest, 1.0).otherwise(F.lit(longest) / edge)


def to_scene(x: Column, y: Column, scale: Column) -> tuple[Column, Column]:
    return x * scale, y * scale


def to_source(x: Column, y: Column, scale: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Back from the scene; what lies beside the picture comes to its border."""
    return clamp(x / scale, 0.0, width.cast("double")), clamp(y / scale, 0.0, height.cast("double"))
