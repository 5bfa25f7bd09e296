"""Credit, retail and inventory feature formulas as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clip(x, low=None, high=None) -> Column:
    """Bound x; a null stays null."""
    x = _c(x)
    out = x
    if low is not None:
        out = F.greatest(out, _c(low))
    if high is not None:
        out = F.least(out, _c(high))
    return F.when(x.isNotNull(), out)


def bounded_ratio(a, b, low: float = 0.0, high: float = 1.0, floor: float = 1.0) -> Column:
    """``a / max(b, floor)`` held between two bounds; the floor keeps it defined."""
    quotient = _c(a).cast("double") / F.greatest(_c(b).cast("double"), F.lit(float(floor)))
    return clip(F.when(_c(b).isNotNull(), quotient), float(low), float(high))


# -- sums and differences ---------------------------------------------------------

def total(*parts) -> Column:
    out = _c(parts[0])
    for p in parts[1:]:
        out = out + _c(p)
    return out


def available_credit(limit, balance) -> Column:
    return F.greatest(_c(limit) - _c(balance), F.lit(0.0))


def net_worth(liquid, debt) -> Column:
    return _c(liquid) - _c(debt)


def monthly(annual) -> Column:
    return _c(annual) / F.lit(12.0)


def secured_share(mortgage, installment, debt) -> Column:
    """Mortgage and 30 % of instalment loans, over all debt."""
    return bounded_ratio(_c(mortgage) + _c(installment) * 0.3, debt, 0, 1)


# -- transforms -------------------------------------------------------------------

def signed_free_log(x, fill: float | None = None) -> Column:
    """``ln(1 + |x|)`` after filling nulls."""
    x = _c(x) if fill is None else F.coalesce(_c(x), F.lit(float(fill)))
    return F.log1p(F.abs(x))


def root_of_size(x, fill: float | None = None) -> Column:
    x = _c(x) if fill is None else F.coalesce(_c(x), F.lit(float(fill)))
    return F.sqrt(F.abs(x))


def z_score(x, mean: float, std_pop: float, eps: float = 1e-8) -> Column:
    return (_c(x) - F.lit(float(mean))) / F.lit(float(std_pop) + eps)


def sigmoid(z, limit: float | None = None) -> Column:
    z = _c(z)
    if limit is not None:
        z = clip(z, -float(limit), float(limit))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def powers(x, prefix: str, fill: float | None = 0.0) -> dict[str, Column]:
    v = _c(x) if fill is None else F.coalesce(_c(x), F.lit(float(fill)))
    return {f"{prefix}_squared": v * v, f"{prefix}_cubed": v * v * v}


# -- interactions -----------------------------------------------------------------

def pair_interactions(pairs: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """Product, ratio, sum, difference, larger and smaller of each pair; nulls count as 0."""
    out: dict[str, Column] = {}
    for a, b in pairs:
        x = F.coalesce(F.col(a).cast("double"), F.lit(0.0))
        y = F.coalesce(F.col(b).cast("double"), F.lit(0.0))
        out |= {
            f"{a}_x_{b}": x * y,
            f"{a}_div_{b}": x / F.greatest(y, F.lit(1e-8)),
            f"{a}_plus_{b}": x + y,
            f"{a}_minus_{b}": x - y,
            f"{a}_max_{b}": F.greatest(x, y),
            f"{a}_min_{b}": F.least(x, y),
        }
    return out


def risk_triple(util, dti, score) -> dict[str, Column]:
    """Three-way product and weighted sum; fills 0.3, 0.3 and 680."""
    u = F.coalesce(_c(util), F.lit(0.3))
    d = F.coalesce(_c(dti), F.lit(0.3))
    gap = (F.lit(850.0) - F.coalesce(_c(score), F.lit(680.0))) / 850.0
    return {"risk_triple_product": u * d * gap, "risk_weighted_sum": u * 0.3 + d * 0.3 + gap * 0.4}


# -- credit behaviour -------------------------------------------------------------

def delinquency_intensity(d30, d60, d90) -> Column:
    return _c(d30) + _c(d60) * 2 + _c(d90) * 4


def composite_score(credit, payment, util) -> Column:
    return _c(credit) * 0.4 + _c(payment) * 6 * 0.3 + (F.lit(1.0) - _c(util)) * 850 * 0.3


def account_velocity(new_accounts, tenure_months) -> Column:
    return _c(new_accounts) / F.greatest(_c(tenure_months) / 12.0, F.lit(1.0))


def credit_age(months) -> Column:
    return clip(_c(months) / 12.0, 0.0, 30.0)


def inquiry_intensity(count) -> Column:
    return clip(_c(count) / 6.0, 0.0, 3.0)


def on_time_rate(d30, d60, months: int = 24) -> Column:
    return clip(F.lit(1.0) - (_c(d30) * 2 + _c(d60)) / float(months), 0.5, 1.0)


def amount_if_any(count, amount, none=0) -> Column:
    """The amount where there was an event, else the stated value (0, or 999 for never)."""
    return F.when(_c(count) > 0, _c(amount)).otherwise(F.lit(none))


@dataclass(frozen=True)
class ScorecardLine:
    """One line of a scorecard: weight x transform(filled column - offset), plus a jump above a limit."""

    column: str
    fill: float
    weight: float
    offset: float = 0.0
    log: bool = False
    limit: float | None = None
    jump: float = 0.0

    def points(self) -> Column:
        x = F.coalesce(F.col(self.column).cast("double"), F.lit(float(self.fill)))
        y = F.log1p(x) if self.log else x - self.offset
        out = y * self.weight
        return out if self.limit is None else out + F.when(x > self.limit, self.jump).otherwise(0.0)


def scorecard(lines: Sequence[ScorecardLine]) -> Column:
    """Log-odds of a scorecard: the sum of its lines."""
    return total(F.lit(0.0), *[line.points() for line in lines])


# -- calendar ---------------------------------------------------------------------

@dataclass(frozen=True)
class CalendarRules:
    """Which days count as what. Months are 1 to 12; seasons name the months they hold."""

    holiday_months: tuple[int, ...] = ()
    holiday_days: tuple[int, ...] = ()
    new_year_days: int = 0
    festival_months: tuple[int, ...] = ()
    term: tuple[int, int] = (1, 12)
    payday_cycle: int = 4
    payday_weeks: tuple[int, ...] = ()
    seasons: Mapping[str, tuple[int, ...]] = field(default_factory=dict)


def calendar_parts(day, start: str, rules: CalendarRules) -> dict[str, Column]:
    """Parts of a date under the given rules; ``start`` is the ISO date from which days are counted."""
    d = _c(day).cast("date")
    named = {"day_of_week": F.weekday(d), "month": F.month(d), "quarter": F.quarter(d), "week_of_year": F.weekofyear(d)}
    free = named["month"].isin(*rules.holiday_months) | F.dayofmonth(d).isin(*rules.holiday_days) | (F.dayofyear(d) <= rules.new_year_days)
    flags = {
        "is_weekend": named["day_of_week"].isin(5, 6),
        "is_holiday": free,
        "payday_week": (named["week_of_year"] % rules.payday_cycle).isin(*rules.payday_weeks),
        "festival_period": free | named["month"].isin(*rules.festival_months),
        "school_term": named["month"].between(*rules.term),
    }
    season_of = F.create_map(*[F.lit(x) for season, months in rules.seasons.items() for m in months for x in (m, season)])
    return {
        **named, **{k: v.cast("int") for k, v in flags.items()},
        "season": F.try_element_at(season_of, named["month"]), "days_since_start": F.datediff(d, F.lit(start).cast("date")),
    }


# -- stock and basket -------------------------------------------------------------

def safety_stock(demand, lead_days, factor: float = 1.0) -> Column:
    return F.round(_c(demand) * (_c(lead_days) / 7.0) * factor, 0)


def reorder_point(safety, demand, lead_days) -> Column:
    return F.round(_c(safety) + _c(demand) * (_c(lead_days) / 7.0), 0)


def order_quantity(demand, price, storage_cost) -> Column:
    """Economic order quantity with 3 % of the price as ordering cost."""
    return F.round(F.sqrt(_c(demand) * 2.0 * 52.0 * _c(price) * 0.03 / (_c(storage_cost) + 0.01)) + 1, 0)


def days_of_cover(stock, weekly_demand) -> Column:
    return clip(F.round(_c(stock) / (_c(weekly_demand) / 7.0 + 0.1), 1), 0.0, 365.0)


def overstock(stock, reorder) -> Column:
    return F.round(F.greatest(_c(stock) - _c(reorder) * 2, F.lit(0.0)), 0)


def trend_label(value, mean, share: float = 0.10) -> Column:
    gap = _c(value) - _c(mean)
    return (
        F.when(gap > _c(mean) * share, "increasing")
        .when(gap < -_c(mean) * share, "decreasing").otherwise("stable")
    )


def basket(amount, items, discount_pct, tax_rate: float = 0.18) -> dict[str, Column]:
    a = _c(amount)
    return {
        "avg_item_price": F.round(a / _c(items), 2),
        "tax_amount": F.round(a * tax_rate, 2),
        "net_amount": F.round(a - a * _c(discount_pct) / 100.0, 2),
    }


def categories_present(counts: Sequence, low: int = 1, high: int = 5) -> Column:
    """How many of the per-category counts are positive, held between two bounds."""
    return clip(total(*[(_c(c) > 0).cast("int") for c in counts]), low, high)


def share_pct(part, whole) -> Column:
    return clip(F.round(_c(part) / _c(whole) * 100, 1), 0.0, 100.0)


def weighted_risk(terms: Sequence[tuple[float, Column]], threshold: float = 0.5) -> dict[str, Column]:
    """Score ``sum(w * term)`` and the flag ``sigmoid(score) > threshold``, bounded at 15."""
    score = total(*[x * w for w, x in terms])
    return {"risk_score": score, "risk_flag": (sigmoid(score, 15.0) > threshold).cast("int")}
