"""Every rule of the panel analysis as a value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PanelConfig:
    """Thresholds and windows; the defaults suit hourly ozone and daily maxima of temperature."""

    early: tuple[int, int] = (2015, 2019)
    transition: int = 2020
    later: tuple[int, int] = (2021, 2025)
    threshold: float = 70.0
    window_hours: int = 8
    min_hours: int = 6
    min_windows: int = 13
    first_hour: int = 7
    max_distance_km: float = 50.0
    min_overlap: float = 0.90
    min_coverage: float = 0.75
    min_years: int = 4
    bin_width: float = 2.0
    min_days: int = 30
    min_sites: int = 20
    min_retention: float = 0.80
    quality_year: int = 2025


#: Values under which the rules discriminate on the driver's tables.
SAMPLE = PanelConfig(
    early=(1995, 1997), transition=1998, later=(1999, 2001), max_distance_km=150.0, min_overlap=0.005, min_coverage=0.20, min_years=2, min_days=75, min_sites=8, quality_year=2001,
)
