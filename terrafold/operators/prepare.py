"""The crop inputs of a scenario table, step by step in a batch that can be resumed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.batch import Batch, Step
from . import crop
from .lookups import guarded


@dataclass
class CropLayers:
    """What the steps read, and ``key``, the state of the sources.

    cells: cell_id, row_i, col_i, y, lu, zone_id, poly_id, biome_id; monthly: cell_id, month, tmp, rain; spam: cell_id, y_all,
    y_irr, y_rf; country: poly_id, avg_yield, yld_ratio; lookups: crops, zones, days, months, residues.
    """

    cells: DataFrame
    monthly: DataFrame
    spam: DataFrame
    country: DataFrame
    crops: DataFrame
    zones: DataFrame
    days: DataFrame
    months: DataFrame
    residues: DataFrame
    key: str = ""


def inputs_of(batch: Batch, layers: CropLayers, name: str, technology: str | None) -> Step:
    """cell_id, month, pet, irrigation, yield, pc and res of one crop and technology over its land use.

    Steps that do not depend on the technology are shared by all scenarios of a crop.
    """
    crops, source, zoned = layers.crops.where(F.col("crop") == name), [layers.key], layers.zones
    cells = guarded(layers.cells, layers.crops, "crop", name, "crop")

    def demand() -> DataFrame:
        inside = cells.where("lu = 1").select("cell_id", "y")
        pet = crop.location_pet(layers.monthly.select("cell_id", "month", "tmp").join(inside.hint("merge"), "cell_id"), layers.months)
        return crop.crop_pet_grid(cells, pet, crop.monthly_kc(crops, layers.days), zoned, name)

    pet = batch.step("pet", demand, source, crop=name)
    need = lambda p: crop.irrigation_need(F.coalesce("pet", F.lit(0.0)), F.col("rain"))
    irrigation = batch.step(
        "irrigation", lambda: pet.df.join(layers.monthly.select("cell_id", "month", "rain").hint("merge"), ["cell_id", "month"]).select("cell_id", "month", need(pet).alias("irrigation")), [pet]
    )
    yields = batch.step("yield", lambda: crop.yield_grid(layers.cells.drop("y", "zone_id"), layers.spam, layers.country, technology), source, technology=technology)
    cover = batch.step("cover", lambda: crop.plant_cover_grid(cells.where("lu = 1"), crops, zoned, layers.months, name), source, crop=name)

    def left() -> DataFrame:
        groups = layers.cells.select("cell_id", "zone_id").join(F.broadcast(zoned), "zone_id").select("cell_id", "zone_group")
        rows = crop.residues(yields.df, layers.residues, name).join(groups.hint("merge"), "cell_id").select("cell_id", "zone_group", "res")
        return crop.monthly_split(rows, crop.monthly_kc(crops, layers.days), "res")

    res = batch.step("residues", left, [yields, layers.key], crop=name)
    both = ["cell_id", "month"]

    def together() -> DataFrame:
        met = pet.df.hint("merge").join(irrigation.df, both)  # layers of all cells, however small their files are
        met = met.join(cover.df.hint("merge"), both).join(res.df.hint("merge"), both, "left")
        rows = met.join(yields.df.hint("merge"), "cell_id")
        return rows.select(*both, "pet", "irrigation", "yield", "pc", "res")

    return batch.step("inputs", together, [pet, irrigation, yields, cover, res])


def run_scenarios(batch: Batch, layers: CropLayers, scenarios: DataFrame) -> DataFrame:
    """The inputs of every row (scenario, crop, technology) of a scenario table, under its name; steps in common run once."""
    out = None
    for s in scenarios.orderBy("scenario").collect():  # a few rows that a person has written
        rows = inputs_of(batch, layers, s.crop, s.technology).df.select(F.lit(s.scenario).alias("scenario"), "*")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("the scenario table is empty")
    return out
