"""Settings of the monitoring engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Scene classes that hide the ground, indicator order, fusion weights and cuts.
HIDDEN_CLASSES = (0, 1, 3, 8, 9, 10, 11)
INDICATORS = ("extent", "turbidity", "transparency", "chlorophyll")
WEIGHTS = {"extent": 0.25, "turbidity": 0.40, "transparency": 0.0, "chlorophyll": 0.35}


@dataclass(frozen=True)
class Settings:
    grid_minimum: float = 0.4
    aoi_minimum: float = 0.60
    ndwi_threshold: float = 0.0
    agreement_minimum: float = 0.7
    disagreement_limit: float = 0.25
    sigma: float = 3.0
    z_cap: float = 6.0
    min_samples: int = 8
    pixel_area: float = 100.0
    intake_weight: float = 0.7
    settlement_weight: float = 0.3
    scale_m: float = 5000.0
    credits: int = 10
    bump: float = 0.15
    bump_max: float = 0.45
    duplicate_m: float = 25.0
    duplicate_s: float = 3600.0


DEFAULTS = Settings()
