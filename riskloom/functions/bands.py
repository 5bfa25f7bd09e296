"""Named bands over a number. Every band is closed on the left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper limits and names, as published for each measure.
IV_BANDS = [(0.02, "useless"), (0.1, "weak"), (0.3, "medium"), (0.5, "strong")]
IV_TOP = "suspicious"
KS_BANDS = [(20.0, "poor"), (40.0, "average"), (50.0, "good"), (60.0, "very_good")]
KS_TOP = "excellent_check_overfit"
PSI_BANDS = [(0.10, "stable"), (0.25, "moderate_shift")]
PSI_TOP = "significant_shift"
SCORE_BANDS = [(580, "poor"), (670, "fair"), (740, "good"), (800, "very_good")]
SCORE_TOP = "excellent"


def band(x: Column, limits: Sequence[tuple[float, str]], top: str) -> Column:
    """Name of the first limit above x, else ``top``; null stays null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for limit, name in limits:
        out = out.when(x < F.lit(limit), name)
    return out.otherwise(top)


def iv_strength(x: Column) -> Column:
    return band(x, IV_BANDS, IV_TOP)


def ks_quality(x: Column) -> Column:
    return band(x, KS_BANDS, KS_TOP)


def psi_status(x: Column) -> Column:
    return band(x, PSI_BANDS, PSI_TOP)


def score_band(x: Column) -> Column:
    return band(x, SCORE_BANDS, SCORE_TOP)


def traffic_light(x: Column) -> Column:
    """Metric colour: 0.75 and above good, 0.60 and above warn, else bad."""
    return F.when(x >= 0.75, "good").when(x >= 0.60, "warn").otherwise("bad")


def decay_alert(drop: Column, baseline: Column) -> Column:
    """Relative loss against the baseline: above 20 % act, above 10 % warn."""
    share = F.try_divide(drop, baseline)
    return F.when(share > 0.20, "act").when(share > 0.10, "warn").otherwise("ok")
