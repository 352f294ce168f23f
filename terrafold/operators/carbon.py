"""Per-cell carbon balance as an ordered fold over packed monthly drivers: narrow, no shuffle, one row a year out.

Soil water does not depend on carbon, so a first fold gives the deficits, projections turn them into decay factors, and
a second, linear fold moves the pools. States are kept by year, not by month, so long runs do not copy long arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formulas

POOLS = ("dpm", "rpm", "bio", "hum")
DRIVERS = ("tmp", "water", "evap", "pc", "c_inp", "fym")
Modifier = Callable[[Column, str], Column]


def pack(monthly: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row a key with an array of twelve (ordered by month) for each driver."""
    rows = F.array_sort(F.collect_list(F.struct("month", *columns)))
    packed = monthly.groupBy(*keys).agg(rows.alias("_m"))
    return packed.select(*keys, *[F.transform(F.col("_m")[c], lambda v: v.cast("double")).alias(c) for c in columns])


def check_cycle(array: Column, n_years: Column) -> Column:
    """The array, or an error unless it holds one year or all years."""
    ok = (F.size(array) == 12) | (F.size(array) == 12 * n_years)
    return F.when(ok, array).otherwise(F.raise_error(F.lit("drivers must hold 12 or 12 * n_years months")))


def at(array: Column, year: Column, month: Column) -> Column:
    """The driver of a month (from 0) of a year (from 1); one-year drivers repeat."""
    return array[((year - 1) * 12 + month) % F.size(array)]


def deficits(df: DataFrame, depth: float = 23.0) -> DataFrame:
    """Adds ``deficit``: for each year an array of the twelve soil-water deficits, from none at the start."""
    most, one_bar, bare = formulas.deficit_bounds(F.col("clay"), depth)
    df = df.withColumns({"_most": most, "_one_bar": one_bar, "_bare": bare})
    months = F.sequence(F.lit(0), F.lit(11))

    def year(state: Column, y: Column) -> Column:
        def step(s: Column, m: Column) -> Column:
            new = formulas.next_deficit(
                s["swc"], at(F.col("water"), y, m), at(F.col("evap"), y, m), at(F.col("pc"), y, m).cast("int"), F.col("_most"), F.col("_bare")
            )
            return F.struct(new.alias("swc"), F.concat(s["out"], F.array(new)).alias("out"))

        start = F.struct(state["swc"].alias("swc"), F.expr("cast(array() as array<double>)").alias("out"))
        inner = F.aggregate(months, start, step)
        joined = F.transform(F.array(inner), lambda i: F.struct(i["swc"].alias("swc"), F.concat(state["out"], F.array(i["out"])).alias("out")))
        return joined[0]

    start = F.struct(F.lit(0.0).alias("swc"), F.expr("cast(array() as array<array<double>>)").alias("out"))
    return df.withColumn("deficit", F.aggregate(F.sequence(F.lit(1), F.col("n_years").cast("int")), start, year, lambda s: s["out"]))


def prepared(df: DataFrame, modifier: Modifier | None) -> DataFrame:
    """Adds what stays the same in all months: initial pools, respired ratio, decay rates, and temperature times cover."""
    pools = formulas.initial_pools(F.col("soc0"), F.col("clay"))
    if "iom" in df.columns:
        pools["iom"] = F.coalesce(F.col("iom"), pools["iom"])
    x = formulas.respired_ratio(F.col("clay"))
    base = F.transform("tmp", lambda t, i: formulas.temperature_modifier(t) * formulas.cover_modifier(F.col("pc")[i].cast("int")))
    df = df.withColumns({f"_{p}": c for p, c in pools.items()} | {"_x": x, "_base": base})
    return df.withColumns({f"_k_{p}": (modifier(F.col("sand"), p) if modifier else F.lit(1.0)) * formulas.DECAY[p] / 12 for p in POOLS})


def annual(
    df: DataFrame, keep: list[str], *, modifier: Modifier | None = None, include_start: bool = True, depth: float = 23.0,
    fym_to_hum: bool = False, to_stable: float = formulas.TO_STABLE,
) -> DataFrame:
    """(keep, year, soc, co2) of rows with n_years, clay, soc0, iom (optional) and arrays tmp, water, evap, pc, c_inp, fym.

    ``modifier`` gives the tillage factor of a pool from the sand column. A site's own inert pool replaces the derived
    one without moving the others. ``fym_to_hum`` puts the two hundredths of manure into the humified pool.
    """
    df = df.withColumns({d: check_cycle(F.col(d), F.col("n_years")) for d in DRIVERS})
    df = prepared(deficits(df, depth), modifier)

    def month(d: Column, y: Column, m: Column) -> Column:
        rate = at(F.col("_base"), y, m) * formulas.moisture_modifier(d, F.col("_most"), F.col("_one_bar"))
        plant, manure = at(F.col("c_inp"), y, m), at(F.col("fym"), y, m)
        return F.struct(rate.alias("rate"), plant.alias("c"), manure.alias("f"))

    df = df.withColumn("_steps", F.transform("deficit", lambda ds, y: F.transform(ds, lambda d, m: month(d, y + 1, m))))
    decays = lambda s: F.struct(*[F.exp(-s["rate"] * F.col(f"_k_{p}")).alias(p) for p in POOLS], s["c"].alias("c"), s["f"].alias("f"))
    df = df.withColumn("_decay", F.transform("_steps", lambda ms: F.transform(ms, decays)))

    def step(s: Column, e: Column) -> Column:
        lost = sum((s[p] * (1 - e[p]) for p in POOLS), F.lit(0.0))
        share = to_stable / (to_stable + 1)
        return F.struct(
            (s["dpm"] * e["dpm"] + share * e["c"] + 0.49 * e["f"]).alias("dpm"),
            (s["rpm"] * e["rpm"] + (1 - share) * e["c"] + 0.49 * e["f"]).alias("rpm"),
            (s["bio"] * e["bio"] + lost * 0.46 / (F.col("_x") + 1)).alias("bio"),
            (s["hum"] * e["hum"] + lost * 0.54 / (F.col("_x") + 1) + (0.02 if fym_to_hum else 0.0) * e["f"]).alias("hum"),
            (s["co2"] + lost * F.col("_x") / (F.col("_x") + 1)).alias("co2"),
        )

    def year(state: Column, months: Column) -> Column:
        start = F.struct(*[state[p].alias(p) for p in POOLS], F.lit(0.0).alias("co2"))
        inner = F.aggregate(months, start, step)
        done = lambda i: F.struct(
            *[i[p].alias(p) for p in POOLS],
            F.concat(state["out"], F.array(F.struct((sum((i[p] for p in POOLS), F.col("_iom"))).alias("soc"), i["co2"].alias("co2")))).alias("out"),
        )
        return F.transform(F.array(inner), done)[0]

    start = F.struct(*[F.col(f"_{p}").alias(p) for p in POOLS], F.expr("cast(array() as array<struct<soc:double,co2:double>>)").alias("out"))
    years = F.aggregate("_decay", start, year, lambda s: s["out"])
    if include_start:
        years = F.concat(F.array(F.struct(F.col("soc0").alias("soc"), F.lit(0.0).alias("co2"))), years)
    out = df.select(*keep, F.posexplode(years).alias("_pos", "_y"))
    return out.select(*keep, (F.col("_pos") + (0 if include_start else 1)).alias("year"), F.col("_y.soc").alias("soc"), F.col("_y.co2").alias("co2"))


def reduced_tillage(df: DataFrame, keep: list[str], **options: object) -> DataFrame:
    """``annual`` with decay slowed or quickened by the sand band."""
    return annual(df, keep, modifier=formulas.tillage_modifier, **options)


def annual_blocks(df: DataFrame, keep: list[str], *, modifier: Modifier | None = None, depth: float = 23.0, to_stable: float = formulas.TO_STABLE) -> DataFrame:
    """``annual`` from year 0 with the fold run month by month over whole Arrow batches of cells: many times faster.

    Same result; the set-up stays in column expressions. Missing values come out missing.
    """
    most, one_bar, bare = formulas.deficit_bounds(F.col("clay"), depth)
    df = prepared(df, modifier).withColumns({"_most": most, "_one_bar": one_bar, "_bare": bare})
    arrays, singles = ["_base", "water", "evap", "pc", "c_inp", "fym"], ["_most", "_one_bar", "_bare", "_x", "_iom", "soc0"]
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            one = lambda name: batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)
            lengths = batch.column("_base").value_lengths().to_numpy(zero_copy_only=False)
            years = batch.column("_n").to_numpy(zero_copy_only=False)
            # Rows of one length and number of years go together, so none is carried on beyond its own years.
            kinds_of = np.stack([lengths, years], axis=1).astype(float)
            for size, last in np.unique(kinds_of[~np.isnan(kinds_of).any(axis=1)], axis=0).astype(int) if rows else ():
                at = np.flatnonzero((lengths == size) & (years == last))
                take = batch.take(pa.array(at))
                grid = {a: take.column(a).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size).T for a in arrays}
                base, water, evap, cover, plant, manure = (np.ascontiguousarray(grid[a]) for a in arrays)
                v = {c: one(c)[at] for c in [*singles, *(f"_{p}" for p in POOLS), *(f"_k_{p}" for p in POOLS)]}
                pools, k = np.array([v[f"_{p}"] for p in POOLS]), np.array([v[f"_k_{p}"] for p in POOLS])
                x1, share = v["_x"] + 1, to_stable / (to_stable + 1)
                to_bio, to_hum, to_air = 0.46 / x1, 0.54 / x1, v["_x"] / x1
                fresh = np.stack([share * plant + 0.49 * manure, (1 - share) * plant + 0.49 * manure], axis=1)
                # The part of each pool that a month leaves. With drivers of one year, a row whose soil water ends the year
                # as it began has the same parts in all years that follow, so only the others are reckoned again.
                stays, swc, moving = np.empty((12, len(POOLS), len(at))), np.zeros(len(at)), np.arange(len(at))
                out = [(0, v["soc0"], np.zeros(len(at)))]
                for year in range(1, last + 1):
                    if len(moving):
                        w, low, bar, dry, rate = swc[moving], *(v[c][moving] for c in ("_most", "_one_bar", "_bare")), k[:, moving]
                        for m in range(12):
                            t = ((year - 1) * 12 + m) % size
                            moved = w + water[t, moving] - 0.75 * evap[t, moving]
                            wet = np.minimum(0.0, np.maximum(low, moved))
                            w = np.where(cover[t, moving] == 1, wet, np.minimum(w, np.maximum(dry, moved)))
                            moist = np.where(w > bar, 1.0, 0.2 + 0.8 * (low - w) / (low - bar))
                            stays[m][:, moving] = np.exp(-(base[t, moving] * moist) * rate)
                        changed = (w != swc[moving]) | (size != 12)
                        swc[moving], moving = w, moving[changed]
                    co2 = np.zeros(len(at))
                    for m in range(12):
                        left = pools * stays[m]
                        lost = (pools - left).sum(0)
                        left[:2] += fresh[((year - 1) * 12 + m) % size]
                        left[2] += lost * to_bio
                        left[3] += lost * to_hum
                        co2 += lost * to_air
                        pools = left
                    out.append((year, pools.sum(0) + v["_iom"], co2))
                keys = take.select(keep)
                for year, soc, co2 in out:
                    values = [pa.array(np.full(len(at), year, np.int32)), pa.array(soc, from_pandas=True), pa.array(co2, from_pandas=True)]
                    yield pa.RecordBatch.from_arrays([*keys.columns, *values], [*keep, "year", "soc", "co2"])

    slim = df.select(*keep, F.col("n_years").cast("int").alias("_n"), *arrays, *dict.fromkeys([*singles, *(f"_{p}" for p in POOLS), *(f"_k_{p}" for p in POOLS)]))
    return slim.mapInArrow(fold, f"{kinds}, year int, soc double, co2 double")
