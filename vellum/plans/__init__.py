"""The query catalog: every query by name, and its SQL for comparison where SQL can express it."""

from __future__ import annotations

from vellum.plans import boundaries, candidates, edits, evidence, frames, masks, names, native, outlines, pages, polygons, priors, refinement, reports, scans, signals, titles, transitions

PARTS = (titles, candidates, refinement, boundaries, pages, signals, frames, native, outlines, transitions, evidence, scans, edits, names, masks, priors, reports, polygons)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: text for part in PARTS for name, text in part.ORACLE.items()}
