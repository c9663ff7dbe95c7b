"""The contract of a run's settings: sections that must be there, and rules that their values keep."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Callable
from datetime import date

#: Sections, sizes and names that a run's settings must have.
SECTIONS = ("date_window", "cities", "grid", "sources", "quality", "kernels", "validation", "outputs")
DAYS, SIDE_KM, RESOLUTION_M, LEAST_HALO_M = 100, 50.0, 10, 500.0
CRS, CONTINUOUS, CATEGORICAL = "per_city_utm", "bilinear", "nearest"

EXAMPLE = {
    "date_window": {"start": "2024-01-11", "end_exclusive": "2024-04-20", "center": "2024-03-01"},
    "cities": {"selected_city_ids": ["usa_new_york", "india_delhi"], "side_length_km": 50.0, "source_halo_m": 1000.0},
    "grid": {"resolution_m": 10, "crs_strategy": CRS, "continuous": CONTINUOUS, "categorical": CATEGORICAL},
    "sources": {"clear_threshold": 0.6},
    "quality": {"strict_least": 15, "broad_least": 5},
    "kernels": {"fwhm_m": [750.0, 1000.0, 1500.0]},
    "validation": {"folds": 5, "neighbours": 12, "buffer_m": 2550.0},
    "outputs": {"rasters": "out"},
}


def _days(window: dict) -> int:
    return (date.fromisoformat(window["end_exclusive"]) - date.fromisoformat(window["start"])).days


#: Name of a rule, and whether settings keep it.
RULES: list[tuple[str, Callable[[dict], bool]]] = [
    ("window_order", lambda c: _days(c["date_window"]) > 0),
    ("window_center", lambda c: c["date_window"]["start"] <= c["date_window"]["center"] < c["date_window"]["end_exclusive"]),
    ("window_length", lambda c: _days(c["date_window"]) == DAYS),
    ("cities", lambda c: len(c["cities"]["selected_city_ids"]) == len(set(c["cities"]["selected_city_ids"])) > 0),
    ("side_length", lambda c: float(c["cities"]["side_length_km"]) == SIDE_KM),
    ("source_halo", lambda c: float(c["cities"]["source_halo_m"]) >= LEAST_HALO_M),
    ("resolution", lambda c: int(c["grid"]["resolution_m"]) == RESOLUTION_M),
    ("crs_strategy", lambda c: c["grid"]["crs_strategy"] == CRS),
    ("resampling", lambda c: (c["grid"]["continuous"], c["grid"]["categorical"]) == (CONTINUOUS, CATEGORICAL)),
    ("clear_threshold", lambda c: 0 <= float(c["sources"]["clear_threshold"]) <= 1),
    ("least_counts", lambda c: int(c["quality"]["strict_least"]) >= int(c["quality"]["broad_least"]) >= 1),
    ("kernel_widths", lambda c: bool(c["kernels"]["fwhm_m"]) and all(float(w) > 0 for w in c["kernels"]["fwhm_m"])),
    ("folds", lambda c: int(c["validation"]["folds"]) >= 2 and int(c["validation"]["neighbours"]) >= 1 and float(c["validation"]["buffer_m"]) >= 0),
]


def validate(config: dict) -> None:
    """Raises ValueError that names the missing sections, or the first rule that isn't kept."""
    if not isinstance(config, dict):
        raise TypeError("settings must be a mapping")
    missing = [s for s in SECTIONS if s not in config]
    if missing:
        raise ValueError("missing " + " ".join(missing))
    for name, kept in RULES:
        try:
            ok = kept(config)
        except (KeyError, TypeError, ValueError):
            ok = False
        if not ok:
            raise ValueError(name)


def load(path: str) -> dict:
    """Settings of a JSON file, after validation."""
    with open(path, encoding="utf-8") as source:
        config = json.load(source)
    validate(config)
    return config


def digest(config: dict) -> str:
    """SHA-256 of settings, whatever the order of their keys: the identity that a run's records carry."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def verdict(config: dict) -> tuple[bool, str | None]:
    try:
        validate(config)
    except ValueError as problem:
        return False, str(problem)
    return True, None


def variants(config: dict) -> list[tuple[str, dict]]:
    """The settings as they are, and with one change each."""
    changes = {
        "no_grid": lambda c: c.pop("grid"),
        "reversed": lambda c: c["date_window"].update(end_exclusive="2024-01-01"),
        "late_center": lambda c: c["date_window"].update(center="2024-04-20"),
        "short": lambda c: c["date_window"].update(end_exclusive="2024-04-19"),
        "no_city": lambda c: c["cities"].update(selected_city_ids=[]),
        "narrow": lambda c: c["cities"].update(side_length_km=40),
        "thin_halo": lambda c: c["cities"].update(source_halo_m=499),
        "coarse": lambda c: c["grid"].update(resolution_m=20),
        "unclear": lambda c: c["sources"].update(clear_threshold=1.5),
        "flat_kernel": lambda c: c["kernels"].update(fwhm_m=[0]),
        "one_fold": lambda c: c["validation"].update(folds=1),
    }
    out = [("as_it_is", copy.deepcopy(config))]
    for name, change in changes.items():
        held = copy.deepcopy(config)
        change(held)
        out.append((name, held))
    return out


VERDICTS_SQL = "SELECT variant, problem IS NULL AS valid, problem FROM (VALUES ('as_it_is', NULL), ('no_grid', 'missing grid'), ('reversed', 'window_order'), ('late_center', 'window_center'), ('short', 'window_length'), ('no_city', 'cities'), ('narrow', 'side_length'), ('thin_halo', 'source_halo'), ('coarse', 'resolution'), ('unclear', 'clear_threshold'), ('flat_kernel', 'kernel_widths'), ('one_fold', 'folds')) AS v(variant, problem)"
