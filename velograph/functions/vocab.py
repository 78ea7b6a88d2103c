"""Closed vocabularies and model tables of the path network."""

from __future__ import annotations

# These must equal the data that results are compared with. Order is part of the value.
CATEGORIES = (
    "shared_use_path", "separated_path", "protected_lane", "buffered_lane", "painted_lane", "shared_parking_lane", "shared_street", "informal",
    "footpath", "trail", "track", "steps", "quiet_street", "road", "busy_road", "unknown",
)
KINDS = (*CATEGORIES, "connector")
INFRA_LABELS = {
    "Shared use path (off-road)": "shared_use_path",
    "Separated path (off-road)": "separated_path",
    "Protected bike lane (on-road)": "protected_lane",
    "Buffered painted lane": "buffered_lane",
    "Basic painted lane": "painted_lane",
    "Shared bike/parking lane": "shared_parking_lane",
    "Shared street (sharrows)": "shared_street",
    "Intermittent/informal (on-road)": "informal",
}
HAZARDS = {"parking": "parking", "traffic merging": "traffic_merging", "tram line": "tram_line"}
#: From best to worst.
SURFACES = ("smooth", "paved", "rough_paved", "compacted", "gravel", "unpaved", "unknown")
RAW_SURFACES = {
    "smooth": ("asphalt", "concrete", "tartan", "rubber", "acrylic"),
    "paved": ("paved", "chipseal"),
    "rough_paved": (
        "concrete:lanes", "concrete:plates", "paving_stones", "paving_stones:lanes", "bricks", "brick", "sett", "cobblestone",
        "unhewn_cobblestone", "grass_paver", "wood", "boardwalk", "metal", "metal_grid",
    ),
    "compacted": ("compacted", "fine_gravel"),
    "gravel": ("gravel", "pebblestone", "rock", "shells"),
    "unpaved": ("unpaved", "dirt", "earth", "ground", "soil", "mud", "sand", "grass", "woodchips"),
}
SEALED = ("protected_lane", "buffered_lane", "painted_lane", "shared_parking_lane", "shared_street", "informal", "quiet_street", "road", "busy_road")
SMOOTHNESS = ("excellent", "good", "intermediate", "bad", "very_bad", "horrible", "very_horrible", "impassable")
DIRECTIONS = ("both", "forward", "reverse")
OFFICIAL, COMMUNITY = "vic_dtp_bin", "osm"
REGION = {"min_lng": 140.9, "max_lng": 150.1, "min_lat": -39.3, "max_lat": -33.9}

ALLOWED = ("yes", "designated", "permissive", "official")
DENIED = ("no", "private", "use_sidepath")
EXCLUDED_SERVICE = ("driveway", "parking_aisle", "drive-through", "emergency_access")
FOOT_WAYS, TRACKS, SEALED_PATHS = ("footway", "pedestrian"), ("track", "bridleway"), ("asphalt", "concrete", "paved")
ONE_WAY, WIDTH_UNITS = {"forward": ("yes", "1", "true"), "reverse": ("-1", "reverse")}, ("", "m", "meter", "meters", "metre", "metres")
QUIET_STREETS = ("living_street", "residential", "service", "unclassified", "road")
ROADS = ("tertiary", "tertiary_link")
BUSY_ROADS = ("secondary", "secondary_link", "primary", "primary_link", "trunk", "trunk_link")
CANDIDATES = ("cycleway", "footway", "pedestrian", "path", "track", "bridleway", "steps", *QUIET_STREETS, *ROADS, *BUSY_ROADS)

SHORTEST, PREFER_PATHS = "shortest", "prefer_paths"
KIND_COSTS = {
    SHORTEST: dict.fromkeys(KINDS, 1.0),
    PREFER_PATHS: {
        "shared_use_path": 1.0, "separated_path": 1.0, "protected_lane": 1.2, "buffered_lane": 1.5, "painted_lane": 1.8, "shared_parking_lane": 2.0,
        "shared_street": 2.0, "informal": 2.5, "trail": 1.3, "footpath": 1.5, "quiet_street": 1.6, "track": 1.8, "road": 2.5, "busy_road": 4.0,
        "steps": 6.0, "unknown": 2.0, "connector": 3.0,
    },
}
HAZARD_COSTS = {SHORTEST: {}, PREFER_PATHS: {"parking": 1.1, "traffic_merging": 1.3, "tram_line": 1.5}}
SURFACE_COSTS = {
    SHORTEST: dict.fromkeys(SURFACES, 1.0),
    PREFER_PATHS: {"smooth": 1.0, "paved": 1.05, "rough_paved": 1.2, "compacted": 1.3, "gravel": 1.7, "unpaved": 2.0, "unknown": 1.1},
}
SURFACE_PENALTIES = {
    "any": {},
    "avoid_loose": {"compacted": 3.0, "gravel": 10.0, "unpaved": 10.0, "unknown": 1.5},
    "smooth_only": {"paved": 1.2, "rough_paved": 4.0, "compacted": 10.0, "gravel": 15.0, "unpaved": 15.0, "unknown": 2.0},
}
STEPS_PENALTY = {"steps": 20.0}
BUSY_PENALTY = {"busy_road": 3.0, "road": 1.5}

SURFACE_SCORES = {
    "skate": {"smooth": 1.0, "paved": 0.85, "rough_paved": 0.35, "compacted": 0.1, "gravel": 0.0, "unpaved": 0.0, "unknown": 0.5},
    "run": {"smooth": 0.9, "paved": 0.9, "rough_paved": 0.85, "compacted": 1.0, "gravel": 0.8, "unpaved": 0.85, "unknown": 0.85},
}
SMOOTHNESS_SCORES = {"excellent": 1.0, "good": 0.9, "intermediate": 0.55, "bad": 0.2, "very_bad": 0.05, "horrible": 0.0, "very_horrible": 0.0, "impassable": 0.0}
KIND_SCORES = {
    "skate": {
        "shared_use_path": 1.0, "separated_path": 1.0, "protected_lane": 0.95, "buffered_lane": 0.85, "painted_lane": 0.7, "shared_parking_lane": 0.6,
        "shared_street": 0.65, "informal": 0.55, "footpath": 0.8, "trail": 0.9, "track": 0.8, "steps": 0.0, "quiet_street": 0.75, "road": 0.5,
        "busy_road": 0.25, "unknown": 0.6, "connector": 0.7,
    },
    "run": {
        "shared_use_path": 1.0, "separated_path": 1.0, "footpath": 0.9, "trail": 1.0, "track": 0.95, "steps": 0.7, "quiet_street": 0.8,
        "shared_street": 0.7, "protected_lane": 0.7, "buffered_lane": 0.65, "painted_lane": 0.6, "shared_parking_lane": 0.6, "informal": 0.55,
        "road": 0.6, "busy_road": 0.45, "unknown": 0.7, "connector": 0.8,
    },
}
HAZARD_SCORES = {"skate": {"tram_line": 0.4, "traffic_merging": 0.7, "parking": 0.85}, "run": {"tram_line": 0.95, "traffic_merging": 0.85, "parking": 1.0}}
SURFACE_PHRASES = {
    "smooth": "smooth surface", "paved": "coarse or unspecified sealed surface", "rough_paved": "pavers, bricks or boardwalk", "compacted": "compacted gravel",
    "gravel": "loose gravel", "unpaved": "dirt, grass or sand", "unknown": "unknown surface",
}
RUN_SURFACE_PHRASES = {"smooth": "hard asphalt or concrete", "paved": "hard sealed surface"}
KIND_PHRASES = {
    "footpath": "on footpaths shared with pedestrians", "quiet_street": "on quiet streets", "road": "on roads", "busy_road": "along busy roads",
    "steps": "of steps", "painted_lane": "in painted on-road bike lanes", "buffered_lane": "in buffered on-road bike lanes",
    "protected_lane": "in protected on-road bike lanes", "shared_parking_lane": "in bike lanes beside parked cars",
    "shared_street": "on streets shared with cars", "informal": "on informal on-road routes", "trail": "on trails", "track": "on tracks",
    "connector": "of road crossings and gaps", "unknown": "of unclassified paths",
}
HAZARD_PHRASES = {"tram_line": "alongside tram tracks", "traffic_merging": "where traffic merges", "parking": "beside parked cars"}
OFF_ROAD = ("shared_use_path", "separated_path", "trail", "track")
EXCLUDED_PLACES = ("highway=bus_stop", "railway=tram_stop", "railway=platform")


def raw_to_class() -> dict[str, str]:
    return {raw: cls for cls, values in RAW_SURFACES.items() for raw in values}
