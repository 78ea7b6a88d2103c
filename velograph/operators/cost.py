"""Routing profiles, preferences and edge costs."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocab as V
from ..functions.exprs import lookup


def validate(*tables: Mapping[str, float]) -> None:
    if any(not math.isfinite(v) or v <= 0 for t in tables for v in t.values()):
        raise ValueError("a profile has a multiplier that isn't positive and finite")


def effective(profile: str, surface: str = "any", avoid_steps: bool = False, avoid_busy: bool = False) -> dict[str, dict[str, float]]:
    """A profile's kind, hazard and surface multipliers under preferences, which compose by multiplication."""
    if profile not in V.KIND_COSTS:
        raise ValueError(f"no profile {profile}")
    kinds = dict(V.KIND_COSTS[profile])
    for wanted, extra in ((avoid_steps, V.STEPS_PENALTY), (avoid_busy, V.BUSY_PENALTY)):
        if wanted:
            kinds = {k: v * extra.get(k, 1.0) for k, v in kinds.items()}
    surfaces = {k: v * V.SURFACE_PENALTIES[surface].get(k, 1.0) for k, v in V.SURFACE_COSTS[profile].items()}
    out = {"kind": kinds, "hazard": dict(V.HAZARD_COSTS[profile]), "surface": surfaces}
    validate(*out.values())
    return out


def least_per_metre(tables: Mapping[str, Mapping[str, float]]) -> float:
    """A bound that no edge's cost per metre falls below."""
    return min(tables["kind"].values()) * math.prod(v for v in tables["hazard"].values() if v < 1) * min(tables["surface"].values())


def edge_cost(length: Column, kind: Column, hazards: Column, surface: Column, tables: Mapping[str, Mapping[str, float]]) -> Column:
    one = F.lit(1.0)
    risk = F.aggregate(hazards, one, lambda a, h: a * F.coalesce(lookup(h, tables["hazard"]).cast("double"), one)) if tables["hazard"] else one
    return length * lookup(kind, tables["kind"]) * risk * lookup(surface, tables["surface"])


def preferences_key(surface: Column, avoid_steps: Column, avoid_busy: Column) -> Column:
    return F.concat_ws(",", F.concat(F.lit("surface="), surface), F.when(avoid_steps, "steps"), F.when(avoid_busy, "busy_roads"))


def avoided(surface_preference: str) -> list[str]:
    return [s for s, f in V.SURFACE_PENALTIES[surface_preference].items() if f >= 3 and s != "unknown"]
