"""Choices in which the analyses differ."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class PanelRules:
    """Parameters of a site by year panel.

    winter_shift: count November and December towards the next year's winter.
    winter_season: "calendar" or "contiguous" winter rain totals.
    rain_scale: divisor of rain totals, ten for millimetres to centimetres.
    min_year, max_year: exclusive cut-offs for incomplete water years.
    collapse: statistic that reduces several surveys of a site and year.
    lag_mode: "calendar" completes missing years first, "observed" lags the
        previous survey year, whole or not, "complete" drops incomplete rows
        before it lags.
    min_years: survey years a site needs.
    min_span: years between a site's first and last survey.
    """

    winter_shift: bool = True
    winter_season: str = "calendar"
    rain_scale: float = 1.0
    min_year: int | None = None
    max_year: int | None = None
    collapse: str = "min"
    lag_mode: str = "calendar"
    min_years: int = 5
    min_span: int = 5
    excluded_sites: Sequence[str] = ()


# Measures of a survey.
COVER = ("target_weed", "other_weed", "forbs", "grass", "bare_ground")
RESPONSES = (*COVER, "moss")  # modelled one by one; the total has the five classes above
GROWN = ("target_weed", "other_weed", "forbs", "grass")
COUNTS = ("stems", "insects")
