"""Whether files may share one coordinate space: a fixed order of findings, the first that applies decides.

Works on the metadata records of the files a user selected: a handful, on the driver.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable
from typing import Any

Matrix = list[list[float]]
FRAME, PLACEMENT = 1e-6, 0.02  # metres
# Labels that identify nothing.
NOT_IDENTIFYING = frozenset({"building", "default building", "default project", "project", "site", "unnamed"}) | {""}


def label(text: Any) -> str:
    return re.sub(r"\W+", " ", str(text or "").casefold()).strip()


def matrix(value: Any, scale: float) -> Matrix | None:
    """A rectangular matrix of finite numbers; the translation of a 4 x 4 one in metres."""
    try:
        rows = [[float(x) for x in row] for row in value]
    except (TypeError, ValueError):
        return None
    if not rows or not rows[0] or len({len(r) for r in rows}) > 1 or not all(math.isfinite(x) for r in rows for x in r):
        return None
    if len(rows) == len(rows[0]) == 4:
        for r in rows[:3]:
            r[3] *= scale
    return rows


def close(a: Matrix, b: Matrix, shift: float = FRAME) -> bool:
    if [len(r) for r in a] != [len(r) for r in b]:
        return False
    square = len(a) == len(a[0]) == 4
    return all(
        math.isclose(x, y, rel_tol=1e-9, abs_tol=shift if square and j == 3 and i < 3 else FRAME)
        for i, (r, s) in enumerate(zip(a, b, strict=True))
        for j, (x, y) in enumerate(zip(r, s, strict=True))
    )


def agree(groups: list[list], same: Callable[[Any, Any], bool]) -> bool:
    """Some member of the first group has a match in every other; no group may be empty."""
    return all(groups) and any(all(any(same(first, x) for x in group) for group in groups[1:]) for first in groups[0]) if groups else False


def shared(groups: Iterable[set]) -> set:
    groups = list(groups)
    return set.intersection(*groups) if groups and all(groups) else set()


def records(meta: dict, key: str) -> list[dict]:
    found = meta.get(key)
    return [x for x in found if isinstance(x, dict)] if isinstance(found, (list, tuple)) else []


def matrices(meta: dict, key: str, field: str) -> list[Matrix]:
    out: list[Matrix] = []
    for r in records(meta, key):
        m = matrix(r.get(field), float(meta["unit_scale_to_metre"]))
        if m is not None and not any(close(m, other) for other in out):
            out.append(m)
    return out


def norths(meta: dict) -> list[list[float]]:
    return [m[0] for r in records(meta, "contexts") if r.get("true_north") and (m := matrix([r["true_north"]], 1.0))]


def labels(meta: dict, key: str) -> set[str]:
    return {label(r.get(f)) for r in records(meta, key) for f in ("name", "long_name")} - NOT_IDENTIFYING


def texts(meta: dict, key: str) -> set[str]:
    found = meta.get(key)
    return {str(x) for x in found if x} if isinstance(found, (list, tuple, set)) else set()


def verdict(files: list[dict | None]) -> tuple[bool, str, str | None]:
    """(compatible, status, basis) of the files' metadata; None where a file has none."""
    if len(files) < 2:
        return (False, "empty", None) if not files else (True, "single_model", None)
    if not all(files):
        return False, "missing_coordinate_metadata", None
    try:
        scales = [float(m["unit_scale_to_metre"]) for m in files]
    except (KeyError, TypeError, ValueError):
        return False, "invalid_coordinate_metadata", None
    if not all(math.isfinite(s) and s > 0 for s in scales):
        return False, "invalid_coordinate_metadata", None
    maps = [{json.dumps(x, sort_keys=True) for x in records(m, "map_conversions") if x} for m in files]
    frames = [matrices(m, "contexts", "wcs") for m in files]
    north = [g for g in map(norths, files) if g]
    same_way = lambda a, b: len(a) == len(b) and all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip(a, b, strict=True))

    def placed_apart(key: str) -> bool:
        known = [g for g in (matrices(m, key, "placement") for m in files) if g]
        return len(known) > 1 and not agree(known, lambda a, b: close(a, b, PLACEMENT))

    known_maps = [g for g in maps if g]
    against = (
        ("unit_mismatch", lambda: any(not math.isclose(scales[0], s, rel_tol=1e-9, abs_tol=1e-12) for s in scales)),
        ("ambiguous_coordinate_frame", lambda: any(len(g) > 1 for g in frames)),
        ("coordinate_frame_mismatch", lambda: not agree(frames, close)),
        ("true_north_mismatch", lambda: len(north) > 1 and not agree(north, same_way)),
        ("map_conversion_mismatch", lambda: len(known_maps) > 1 and not shared(known_maps)),
        ("spatial_placement_mismatch", lambda: placed_apart("sites") or placed_apart("buildings")),
    )
    for status, applies in against:
        if applies():
            return False, status, None
    for_it = (
        ("shared_project_guid", shared(texts(m, "project_guids") for m in files)),
        ("shared_site_guid", shared(texts(m, "site_guids") for m in files)),
        ("shared_building_guid", shared({r["guid"] for r in records(m, "buildings") if r.get("guid")} for m in files)),
        ("shared_map_conversion", shared(maps)),
        ("shared_project_and_building_identity", shared(labels(m, "projects") for m in files) and shared(labels(m, "buildings") for m in files)),
    )
    basis = next((name for name, found in for_it if found), None)
    return (True, "verified", basis) if basis else (False, "unverified_alignment", None)
