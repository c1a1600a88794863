"""Settings of the operators, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    gain_threshold_m: float = 10.0
    sample_interval_m: float = 25.0
    smooth_window: int = 3
    loop_tolerance_m: float = 150.0
    car_radius_m: float = 300.0
    lift_radius_m: float = 400.0
    transit_rail_radius_m: float = 1000.0
    transit_stop_radius_m: float = 400.0
    max_route_factor: float = 4.0
    near_miss_gain_frac: float = 0.2
    near_miss_dist_km: float = 2.0
    near_miss_radius_frac: float = 0.5
    near_miss_trigger: int = 3
    compose_min_km: float = 3.0
    compose_max_km: float = 15.0
    compose_max_segments: int = 12
    compose_overlap_frac: float = 0.6
    compose_max_loops: int = 15
    compose_min_compactness: float = 0.05
    around_radius_m: float = 1000.0
    routes_k: int = 3
    routes_overlap_frac: float = 0.6
    routes_max_factor: float = 3.0
    routes_max_snap_km: float = 2.0
    routes_max_paths: int = 200
    routes_pad_km: float = 2.0
    routes_pad_frac: float = 0.4
    poi_radius_m: float = 250.0
    poi_search_radius_m: float = 3000.0
    place_ttl_days: float = 365.0


@dataclass(frozen=True)
class Criteria:
    """A conjunctive filter; None leaves a field out."""

    min_distance_km: float | None = None
    max_distance_km: float | None = None
    circular: bool | None = None
    car_access: bool | None = None
    chairlift_access: bool | None = None
    transit_access: bool | None = None
    poi_kinds: tuple[str, ...] = ()
    ferrata: bool | None = None
    min_gain_m: float | None = None
    max_gain_m: float | None = None
