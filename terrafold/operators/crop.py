"""Crop water demand, yields with layered filling, plant cover and residues.

Layers meet by cell with a merge hint: their files pack so well that the planner would broadcast them by the size on disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas
from ..sources.layers import materialized
from . import regrid
from .lookups import guarded


def valid_crops(crops: DataFrame, strict: bool = False) -> DataFrame:
    """Crop rows whose season ends within the year of planting; in strict mode others raise."""
    ends = F.col("plant_day") + F.col("d_ini") + F.col("d_dev") + F.col("d_mid") + F.col("d_late")
    if strict:
        return crops.where(F.when(ends > 365, F.raise_error(F.lit("a season runs beyond day 365")).cast("boolean")).otherwise(True))
    return crops.where(ends <= 365)


def rejected_crops(crops: DataFrame) -> DataFrame:
    return crops.join(valid_crops(crops), crops.columns, "left_anti")


def with_kc(rows: DataFrame) -> DataFrame:
    """Rows of crop columns and day_num with the crop's stage and coefficient of that day."""
    offset, c = F.col("day_num") - F.col("plant_day"), F.col
    lengths = (c("d_ini"), c("d_dev"), c("d_mid"), c("d_late"))
    return rows.withColumns({
        "stage": formulas.crop_stage(offset, *lengths), "kc": formulas.crop_coefficient(offset, (c("k_ini"), c("k_mid"), c("k_late")), lengths),
    })


def daily_kc(crops: DataFrame, days: DataFrame) -> DataFrame:
    """(zone_group, crop, day_num, month, stage, kc) for each day of each valid crop row."""
    return with_kc(valid_crops(crops).crossJoin(F.broadcast(days))).select("zone_group", "crop", "day_num", "month", "stage", "kc")


def observed_kc(observations: DataFrame, crops: DataFrame) -> DataFrame:
    """Observations (zone_group, day_num and more) with crop, stage and kc of every valid crop of their zone group."""
    return with_kc(observations.join(F.broadcast(valid_crops(crops)), "zone_group"))


def local_monthly_kc(plantings: DataFrame, key: str = "cell_id") -> DataFrame:
    """(key, crop, month, kc): monthly means of valid crop rows that each key has on its own planting day."""
    rows, season = valid_crops(plantings), ["crop", "plant_day", "d_ini", "d_dev", "d_mid", "d_late", "k_ini", "k_mid", "k_late"]
    # A season's curve does not depend on the place: days are told out once for each season and planting day, not for each key.
    days = rows.select(*season).distinct().withColumn("day_num", F.explode(F.sequence(F.lit(1), F.lit(365))))
    curves = with_kc(days).groupBy(*season, formulas.month_of_day(F.col("day_num")).alias("month")).agg(F.avg("kc").alias("kc"))
    return rows.select(key, *season).join(curves, season).groupBy(key, "crop", "month").agg(F.avg("kc").alias("kc"))


def monthly_kc(crops: DataFrame, days: DataFrame) -> DataFrame:
    """(zone_group, crop, month, kc): monthly means, off-season zeros included."""
    return daily_kc(crops, days).groupBy("zone_group", "crop", "month").agg(F.avg("kc").alias("kc"))


def location_pet(monthly: DataFrame, months: DataFrame, key: str = "cell_id") -> DataFrame:
    """(key, month, pet) from monthly temperature and latitude; a location without twelve months raises."""
    own = Window.partitionBy(key)  # the year's heat beside each month, so the months are shuffled once and not joined
    rows = monthly.withColumns({"heat": F.sum(formulas.heat_index(F.col("tmp"))).over(own), "_n": F.count("tmp").over(own)})
    rows = rows.where(F.when(F.col("_n") != 12, F.raise_error(F.lit("twelve temperatures are needed")).cast("boolean")).otherwise(True))
    rows = rows.join(F.broadcast(months.select("month", "n_days")), "month")
    light = formulas.daylight_hours(F.col("y"), F.col("month"))
    return rows.select(key, "month", formulas.pet(F.col("tmp"), light, F.col("n_days"), F.col("heat")).alias("pet"))


def crop_pet_table(pet: DataFrame, crops: DataFrame, days: DataFrame, months: DataFrame, crop: str, key: str = "cell_id") -> DataFrame:
    """(key, zone_group, month, pet): daily crop demand summed by month, one location at a time."""
    kc = daily_kc(crops.where(F.col("crop") == crop), days)
    per_month = kc.groupBy("zone_group", "month").agg(F.sum("kc").alias("kc_days"))  # demand is linear in the coefficient
    rows = pet.join(F.broadcast(months.select("month", "n_days")), "month").join(F.broadcast(per_month), "month")
    return rows.select(key, "zone_group", "month", (F.col("kc_days") * F.col("pet") / F.col("n_days")).alias("pet"))


def crop_pet_grid(cells: DataFrame, pet: DataFrame, kc: DataFrame, zones: DataFrame, crop: str) -> DataFrame:
    """(cell_id, month, pet) of cells in the land use; NULL where the zone has no group or crop row."""
    inside = cells.where("lu = 1").select("cell_id", "zone_id")
    curves = F.broadcast(kc.where(F.col("crop") == crop).select("zone_group", "month", "kc").join(zones, "zone_group"))
    rows = inside.join(pet.hint("merge"), "cell_id").join(curves.select("zone_id", "month", "kc"), ["zone_id", "month"], "left")
    return rows.select("cell_id", "month", (F.col("pet") * F.col("kc")).alias("pet"))


def annual_sum(monthly: DataFrame, value: str = "pet") -> DataFrame:
    """Months and the year (month 0) by one rollup; all missing gives missing."""
    rolled = monthly.rollup("cell_id", "month").agg(F.sum(value).alias(value)).where("cell_id is not null")
    return rolled.select("cell_id", F.coalesce("month", F.lit(0)).alias("month"), value)


def irrigation_need(evap: Column, rain: Column, dry: Column | None = None) -> Column:
    """Evaporation beyond rain; ``dry`` (0 or NULL) elsewhere."""
    return F.when(evap > rain, evap - rain).otherwise(F.lit(0.0) if dry is None else dry)


def watering_ratio(technology: str) -> Column:
    """Technology over all, where both are there and not zero."""
    return F.when((F.col("y_all") != 0) & (F.col(technology) != 0), F.try_divide(F.col(technology), F.col("y_all")))


def watering_ratios(spam: DataFrame) -> DataFrame:
    """(cell_id, irr_ratio, rf_ratio) of each cell."""
    return spam.select("cell_id", watering_ratio("y_irr").alias("irr_ratio"), watering_ratio("y_rf").alias("rf_ratio"))


def zone_averages(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Means of column v by zone and, over cells, by group of zones, from one grouping."""
    both = cells.where("v is not null and poly_id is not null").groupingSets([["poly_id", "biome_id"], ["biome_id"]], "poly_id", "biome_id").agg(
        F.avg("v").alias("mean"), F.grouping("poly_id").alias("g")
    )
    return both.where("g = 0").select("poly_id", F.col("mean").alias("zone_mean")), both.where("g = 1").select("biome_id", F.col("mean").alias("biome_mean"))


def yield_grid(cells: DataFrame, spam: DataFrame, country: DataFrame, technology: str | None) -> DataFrame:
    """(cell_id, yield) by the order of sources: cell by country ratio, all-technology cell by mean watering ratio, country
    mean by the cell's (gap-filled) or the mean watering ratio, cell by global ratio, zone mean, group mean, global ratio
    itself, and the nearest valid cell; outside the land use nothing.

    ``cells`` has cell_id, row_i, col_i, lu, poly_id, biome_id. ``technology`` is None (no scaling), "irr" or other.
    """
    source = {None: "y_all", "irr": "y_irr"}.get(technology, "y_rf")
    base = cells.join(spam.hint("merge"), "cell_id", "left").join(country.select("poly_id", "avg_yield", "yld_ratio"), "poly_id", "left")
    votes = country.agg(F.avg("yld_ratio").alias("global_ratio"))
    base = base.crossJoin(F.broadcast(votes))
    spam_value = F.when(F.col(source) != 0, F.col(source)) if technology else F.col(source)
    value = spam_value * F.col("yld_ratio")
    plain = F.col("avg_yield") / 1000
    if technology:
        ratio = "irr_ratio" if technology == "irr" else "rf_ratio"
        base = base.withColumn("ratio", watering_ratio(source))
        base = base.crossJoin(F.broadcast(watering_ratios(spam).agg(F.avg(ratio).alias("mean_ratio"))))
        value = F.coalesce(value, F.col("y_all") * F.col("mean_ratio"))
        base = regrid.with_near_mean(base, "ratio")
        near = F.coalesce(F.col("ratio"), F.when(F.col("lu") == 1, F.col("near")))
        plain = F.coalesce(plain * near, plain * F.col("mean_ratio"))
    inside = F.col("lu") == 1
    base = materialized(base, "yield-sources")  # read by both averages and the fill
    stepped = base.withColumn("v", F.coalesce(value, F.when(inside, F.coalesce(plain, spam_value * F.col("global_ratio")))))
    zone, biome = zone_averages(stepped)
    full = stepped.join(zone, "poly_id", "left").join(biome, "biome_id", "left")
    full = full.withColumn("v", F.coalesce("v", "zone_mean", "biome_mean", "global_ratio"))
    filled = regrid.nearest_valid(materialized(full.where(inside | F.col("v").isNotNull()).select("cell_id", "row_i", "col_i", "v"), "yield-steps"), "v")
    return filled.join(cells.where("lu = 1").select("cell_id").hint("merge"), "cell_id").select("cell_id", F.col("value").alias("yield"))


def yield_grid_simple(cells: DataFrame, spam: DataFrame, country: DataFrame) -> DataFrame:
    """(cell_id, yield): all-technology cell by country ratio, else country mean, else cell by global ratio."""
    base = cells.join(spam.hint("merge"), "cell_id", "left").join(country, "poly_id", "left").crossJoin(F.broadcast(country.agg(F.avg("yld_ratio").alias("global_ratio"))))
    value = F.coalesce(F.col("y_all") * F.col("yld_ratio"), F.col("avg_yield") / 1000, F.col("y_all") * F.col("global_ratio"))
    return base.where("lu = 1").select("cell_id", value.alias("yield"))


def country_yields(borders: DataFrame, yields: DataFrame, item: str) -> DataFrame:
    """Borders with avg_yield and yld_ratio of one crop, left-joined by name; an unknown crop raises."""
    mine = yields.where(F.col("item") == item)
    return guarded(borders, yields, "item", item, "crop").join(mine.select("area", "avg_yield", "yld_ratio"), borders["name"] == F.col("area"), "left")


def monthly_split(annual: DataFrame, shares: DataFrame, value: str) -> DataFrame:
    """The annual value by month, in proportion to a group's coefficients; groups without any raise."""
    total = shares.groupBy("zone_group").agg(F.sum("kc").alias("kc_sum"))
    total = total.where(F.when(F.col("kc_sum") <= 0, F.raise_error(F.lit("coefficients sum to nothing")).cast("boolean")).otherwise(True))
    curve = F.broadcast(shares.join(total, "zone_group").select("zone_group", "month", (F.col("kc") / F.col("kc_sum")).alias("share")))
    return annual.join(curve, "zone_group").select("cell_id", "month", (F.col(value) * F.col("share")).alias(value))


def plant_cover_grid(cells: DataFrame, crops: DataFrame, zones: DataFrame, months: DataFrame, crop: str, nodata: int = 255) -> DataFrame:
    """(cell_id, month, pc): cover of the cell's zone group, the nodata value where the zone is unmapped."""
    curve = crops.where(F.col("crop") == crop).join(zones, "zone_group").select("zone_id", "scp_start", "scp_end")
    rows = cells.select("cell_id", "zone_id").join(F.broadcast(curve), "zone_id", "left").crossJoin(F.broadcast(months.select("month")))
    cover = formulas.plant_cover(F.col("month"), F.col("scp_start"), F.col("scp_end"))
    return rows.select("cell_id", "month", F.coalesce(cover, F.lit(nodata)).alias("pc"))


def residues(rows: DataFrame, params: DataFrame, crop: str, scaled: bool = False) -> DataFrame:
    """(cell_id, abg, bg, res) of column yield; an unknown crop raises."""
    mine = params.where(F.col("crop") == crop)
    if mine.isEmpty():
        raise ValueError(f"unknown crop: {crop}")
    names = ("dry", "rs", "r_ag", "r_t", "slope", "intercept")
    out = formulas.residues(F.col("yield"), {n: F.col(n) for n in names}, scaled)
    return rows.crossJoin(F.broadcast(mine.select(*names))).select("cell_id", *[c.alias(n) for n, c in out.items()])
