"""Column formulas: day and month tables, evapotranspiration, decay-rate modifiers, residues and map projection.

NULL stands for a missing value and propagates; divisions by zero give NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the methods.
MID_MONTH = (15, 45, 74, 105, 135, 162, 198, 228, 258, 288, 318, 344)
MONTH_STARTS = (1, 32, 60, 91, 121, 152, 182, 213, 244, 274, 305, 335)
DECAY = {"dpm": 10.0, "rpm": 0.3, "bio": 0.66, "hum": 0.02}
#: Reduced-tillage modifiers of the four pools: light band of sand, and elsewhere.
TILLAGE_BAND = {"dpm": 1.54, "rpm": 2.15, "bio": 2.38, "hum": 2.93}
TILLAGE_ELSE = {"dpm": 0.72, "rpm": 0.97, "bio": 0.99, "hum": 0.94}
EARTH_RADIUS = 6378137.0
CARBON_SHARE = 0.5
TO_STABLE = 1.44


def pick(values: tuple, place: Column) -> Column:
    """The value at a place counted from 1; NULL outside."""
    return F.try_element_at(F.array(*[F.lit(v) for v in values]), place.cast("int"))


def month_of_day(day: Column) -> Column:
    """Month of a day number; an error outside 1 to 365."""
    month = F.size(F.filter(F.array(*[F.lit(s) for s in MONTH_STARTS]), lambda s: s <= day))
    return F.when(day.between(1, 365), month).otherwise(F.raise_error(F.lit("day number outside 1..365")).cast("int"))


def to_celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def wrap_day(day: Column) -> Column:
    return F.when(day > 365, day - 365).otherwise(day)


def daylight_hours(latitude: Column, month: Column) -> Column:
    """Hours of daylight in the middle of a month."""
    tilt = F.radians(F.lit(23.44)) * F.sin(F.radians(360.0 / 365.0 * (pick(MID_MONTH, month) - 81)))
    c = -F.tan(F.radians(latitude)) * F.tan(tilt)
    inner = F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))
    return F.when(c >= 1, 0.0).when(c <= -1, 24.0).otherwise(F.degrees(inner) * 2 / 15)


def heat_index(temperature: Column) -> Column:
    """A month's share of the annual heat index."""
    return F.pow(F.greatest(F.lit(0.0), temperature) / 5, F.lit(1.514))


def thornthwaite_a(index: Column) -> Column:
    return 6.75e-7 * index * index * index - 7.71e-5 * index * index + 0.01792 * index + 0.49239


def pet(temperature: Column, daylight: Column, days: Column, index: Column) -> Column:
    """Potential evapotranspiration of a month, mm."""
    warm = 16 * (daylight / 12) * (days / 30) * F.pow(F.try_divide(10 * temperature, index), thornthwaite_a(index))
    return F.when(temperature <= 0, 0.0).otherwise(warm)


def crop_stage(offset: Column, ini: Column, dev: Column, mid: Column, late: Column) -> Column:
    """Stage of a day by its offset from planting: 0 off season, 1 planting day, 2 to 5 the four stages."""
    return (
        F.when(offset < 0, 0).when(offset == 0, 1).when(offset <= ini, 2).when(offset <= ini + dev, 3)
        .when(offset <= ini + dev + mid, 4).when(offset <= ini + dev + mid + late, 5).otherwise(0)
    )


def crop_coefficient(offset: Column, k: tuple[Column, Column, Column], days: tuple[Column, Column, Column, Column]) -> Column:
    """Daily crop coefficient: flat, rising, flat, falling; a one-day slope takes its end value."""
    (k_ini, k_mid, k_late), (ini, dev, mid, late) = k, days
    stage = crop_stage(offset, ini, dev, mid, late)
    slope = lambda a, b, start, n: F.when(n == 1, b).otherwise(a + (b - a) * F.try_divide(offset - start - 1, n - 1))
    return (
        F.when(stage.isin(1, 2), k_ini).when(stage == 3, slope(k_ini, k_mid, ini, dev)).when(stage == 4, k_mid)
        .when(stage == 5, slope(k_mid, k_late, ini + dev + mid, late)).otherwise(0.0)
    )


def temperature_modifier(t: Column) -> Column:
    return F.when(t < -5, 0.0).otherwise(47.91 / (F.exp(F.try_divide(F.lit(106.06), t + 18.27)) + 1))


def deficit_bounds(clay: Column, depth: float = 23.0) -> tuple[Column, Column, Column]:
    """Largest deficit of soil water under cover, the one-bar deficit and the one of bare soil; all negative, mm."""
    most = -(20 + 1.3 * clay - 0.01 * clay * clay) * depth / 23
    return most, 0.444 * most, 0.556 * most


def next_deficit(deficit: Column, water: Column, evaporation: Column, covered: Column, most: Column, bare: Column) -> Column:
    """The deficit after a month; bare soil neither dries beyond its bound nor gets wetter than before."""
    x = deficit + water - 0.75 * evaporation
    return F.when(covered == 1, F.least(F.lit(0.0), F.greatest(most, x))).otherwise(F.least(deficit, F.greatest(bare, x)))


def moisture_modifier(deficit: Column, most: Column, one_bar: Column) -> Column:
    return F.when(deficit > one_bar, 1.0).otherwise(0.2 + 0.8 * F.try_divide(most - deficit, most - one_bar))


def cover_modifier(covered: Column) -> Column:
    return F.when(covered == 0, 1.0).otherwise(0.6)


def tillage_modifier(sand: Column, pool: str) -> Column:
    """Reduced-tillage factor of a pool's decay; missing sand counts as outside the band."""
    return F.when((sand > 35) & (sand <= 37.6), TILLAGE_BAND[pool]).otherwise(TILLAGE_ELSE[pool])


def initial_pools(soc: Column, clay: Column) -> dict[str, Column]:
    """Pools of a stock of carbon; the decomposable one takes what the others leave."""
    iom = 0.049 * F.pow(soc, F.lit(1.139))
    rpm = (0.1847 * soc + 0.1555) * F.pow(clay + 1.275, F.lit(-0.1158))
    hum = 0.7148 * soc * F.pow(clay + 0.3421, F.lit(0.0184))
    bio = (0.014 * soc + 0.0075) * F.pow(clay + 8.8473, F.lit(0.0567))
    return {"dpm": soc - iom - rpm - hum - bio, "rpm": rpm, "bio": bio, "hum": hum, "iom": iom}


def respired_ratio(clay: Column) -> Column:
    """Carbon dioxide to stable products, by clay."""
    return 1.67 * (1.85 + 1.6 * F.exp(-0.0786 * clay))


def residues(yields: Column, p: dict[str, Column], scaled: bool = False) -> dict[str, Column]:
    """Above-ground, below-ground and total residue carbon of a yield, by the branch that the parameters allow.

    A regression (slope and intercept) comes first, then the ratio to yield with roots, then the total ratio alone.
    ``scaled`` turns the first two to dry carbon as well and gives no residue where the regression is not positive.
    """
    regress, ratio = p["slope"].isNotNull() & p["intercept"].isNotNull(), F.coalesce(p["rs"], F.lit(0.0)) > 0
    above = F.when(regress, p["slope"] * yields + p["intercept"]).when(ratio, p["r_ag"] * yields)
    below = F.coalesce(p["rs"], F.lit(0.0)) * above
    dry = p["dry"] * CARBON_SHARE
    total = F.when(regress | ratio, (above + below) * dry).otherwise(p["r_t"] * yields * dry)
    if scaled:
        none = (regress | ratio) & (above <= 0)
        above, below = F.when(~none, above * dry), F.when(~none, below * dry)
        total = F.when(none, 0.0).otherwise(total)
    return {"abg": above, "bg": below, "res": total}


def plant_cover(month: Column, start: Column, end: Column) -> Column:
    return ((month >= start) & (month <= end)).cast("int")


def mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Spherical Mercator of longitude and latitude; the poles give NULL."""
    north = EARTH_RADIUS * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(y) / 2))
    return EARTH_RADIUS * F.radians(x), F.when(F.abs(y) < 90, north)


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH_RADIUS), F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS)) - 1.5707963267948966)


def finite(v: Column, nodata: Column | float | None = None) -> Column:
    """The value, NULL for NaN, the infinities and the layer's nodata value."""
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(ok if nodata is None else ok & (v != nodata), v)
